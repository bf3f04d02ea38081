"""Quality rules whose cutoffs are risk-controlled.

Each rule rejects a document whose measure exceeds a cutoff. Labelled documents are parted in two by their ids. For each
stratum (language) one half proposes a cutoff of a fixed grid for every rule: of those beyond which no more than RISK of
its good documents lie, the most lenient that rejects nearly all the bad documents that the strictest does. The other
half tests all rules together, from lenient to strict, every cutoff the same number of steps of the grid above its
proposal: the exact (Clopper-Pearson) upper bound of the share of good documents that any rule rejects must not exceed
RISK. Testing in fixed order stops at the first failure, and each stratum has an equal share of the error level
(Bonferroni), so that with probability 1 - LEVEL the rules together reject no more than RISK of the good documents of
any stratum. A stratum with too few labels to certify cutoffs has none: its documents are kept.

A null or empty text has no words and fails the base rules. A null language is a stratum of its own. Documents without
a label, with a null label or a null id count in no test. Repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsia.llm import kernels as K
from impulsia.llm.common import hot_from, place, prepare, resident, spread_join, written

RISK, LEVEL = 0.02, 0.05
#: Share of the strictest certified cutoff's true rejections that a more lenient one must reach.
NEARLY = 0.95
MIN_WORDS, MAX_REPEAT = 50, 50
#: Strata whose cutoffs are broadcast at most; those of more are joined by shuffle.
STRATA = 100_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: Measures that rules bound from above, of the counts.
RULES = {
    "symbols": "n_symbols / n_words",
    "marks": "n_marks / n_words",
    "upper": "n_upper / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "word_length": "word_chars / n_words / 40",
}
#: Cutoffs from lenient to strict, the same for every rule whatever the data.
GRID = [round(2.0 * 0.9**k, 6) for k in range(60)]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    starts, ends, bounds = K.spans(data, offsets)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    salt = K.mix(np.arange(n, dtype=np.uint64))
    solid = ~K.SPACE[data]
    breaks = np.flatnonzero(data == 10)
    begin = np.union1d(offsets[:-1], breaks + 1)
    begin = begin[begin < len(data)]
    close = np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin
    close = close - ((close > begin) & (data[np.maximum(close - 1, 0)] == 10)) if len(begin) else close
    full = np.concatenate([[0], np.cumsum(solid)])
    wordy = full[close] > full[begin]
    begin, close = begin[wordy], close[wordy]
    of = np.searchsorted(offsets, begin, "right") - 1
    line = K.span_hash(data, begin, close) + salt[of]
    n_lines = np.bincount(of, minlength=n)
    _, first = np.unique(line, return_index=True)
    n_dup = n_lines - np.bincount(of[first], minlength=n)
    words = K.span_hash(data, starts, ends)
    at, text = K.starts_of(bounds, 3)
    _, of_key, times = np.unique(K.windows(words, 3)[at] + salt[text], return_inverse=True, return_counts=True)
    again = K.covered(at[times[of_key] > 1], 3, len(starts))
    n_repeat = np.diff(np.concatenate([[0], np.cumsum(again)])[bounds])
    upper = (data >= 65) & (data <= 90)
    return [np.diff(bounds), per_text(solid & ((data & 0xC0) != 0x80)), per_text(_SYMBOL[data]), n_dup, n_repeat, n_lines, per_text(upper), per_text(data == 33)]


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the counts that the rules use."""
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c != text and c not in COUNTS]
    schema = docs.select(*rest, *(F.lit(0).cast("long").alias(c) for c in COUNTS)).schema

    def count(batches):
        resident()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi, data, offsets in K.chunks(column):
                own = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in rest]
                yield pa.RecordBatch.from_arrays(own + [pa.array(x, pa.int64()) for x in _counts(data, offsets)], names=rest + COUNTS)

    return docs.select(*rest, text).mapInArrow(count, schema)


def upper_bound(bad: int, n: int, level: float) -> float:
    """The largest share p for which as few as bad of n has probability level or more."""
    if bad >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(bad + 1)]

    def at_most(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        terms = [c + k * a + (n - k) * b for k, c in enumerate(logs)]
        top = max(terms)
        return math.exp(top) * math.fsum(math.exp(t - top) for t in terms)

    lo, hi = 1e-12, 1 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at_most(mid) > level else (lo, mid)
    return hi


def proposed(good: int, beyond: list[int], bad_beyond: list[int], risk: float = RISK) -> int | None:
    """The index of a rule's cutoff, from how many of the good and bad documents lie beyond each of the grid."""
    last = sum(k <= risk * good for k in beyond) - 1 if good else -1
    if last < 0 or not bad_beyond[last]:
        return None
    return next(i for i in range(last + 1) if bad_beyond[i] >= NEARLY * bad_beyond[last])


def certified(good: int, most: dict[int, int], level: float, risk: float = RISK) -> int | None:
    """The fewest steps above the proposals that are certified, from how many good documents are rejected up to how many steps at most."""
    found, k = None, 0
    for steps in range(len(GRID) - 1, -1, -1):
        k += most.get(steps, 0)
        # A share above the bound fails without computing it.
        if not good or k > risk * good or upper_bound(k, good, level) > risk:
            break
        found = steps
    return found


def _cut(rule: str) -> str:
    return f"cut_{rule}"


def _proposals(risk: float):
    """A stratum's proposals from its counts by quality, rule and cell: indices of the grid, null without one."""

    def propose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hist = {rule: [[0] * (len(GRID) + 1), [0] * (len(GRID) + 1)] for rule in RULES}
        for r in table.to_pylist():
            hist[r["rule"]][r["good"]][r["cell"]] += r["count"]
        found = []
        for bad, good in hist.values():
            beyond, bad_beyond = ([sum(h[: i + 1]) for i in range(len(GRID))] for h in (good, bad))
            found.append(proposed(sum(good), beyond, bad_beyond, risk))
        return pa.table([pa.array([key[0].as_py()]), *(pa.array([x], pa.int32()) for x in found)], names=["stratum", *RULES])

    return propose


def _certificates(level: float, risk: float):
    """How many steps above its proposals a stratum's cutoffs are certified, from the good documents rejected by steps; none if they are not."""

    def certify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        most = {r["steps"]: r["count"] for r in table.to_pylist()}
        return pa.table([pa.array([key[0].as_py()]), pa.array([certified(sum(most.values()), most, level, risk)], pa.int32())], names=["stratum", "above"])

    return certify


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum and, of each rule, its cutoff (cut_<rule>, null: none), for strata with any; from all labelled documents. A null stratum is the empty one. Strata are tested in tasks, each from counts of a bounded number of cells."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    rows = measured.where(~_base()).join(known, "doc_id").select(F.coalesce(stratum, F.lit("")).alias("stratum"), (F.col("quality") > 0).cast("int").alias("good"), half.alias("half"), *(_cell(F.expr(e)).alias(r) for r, e in RULES.items()))
    rows = written(rows, "measured")
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("cell")) for r in RULES)))
    counts = rows.where("half = 0").select("stratum", "good", cells.alias("c")).groupBy("stratum", "good", "c.rule", "c.cell").count()
    tried = counts.groupBy("stratum").applyInArrow(_proposals(risk), "stratum string, " + ", ".join(f"{r} int" for r in RULES))
    tried = written(tried.where(F.coalesce(*RULES).isNotNull()), "proposals")
    strata = tried.count()
    at = {r: f"at_{r}" for r in RULES}
    # Up to how many steps above the proposals some rule rejects the document; without a good document a stratum has one row, of none.
    steps = F.greatest(F.lit(-1), *(F.coalesce(F.col(at[r]) - F.col(r), F.lit(-1)) for r in RULES))
    good = rows.where("half = 1 AND good = 1").join(_small(tried.withColumnsRenamed(at), strata), "stratum")
    most = good.select("stratum", steps.alias("steps")).groupBy("stratum", "steps").count()
    above = most.groupBy("stratum").applyInArrow(_certificates(level / max(1, strata), risk), "stratum string, above int")
    grid = F.array(*map(F.lit, GRID))
    found = tried.join(above.where("above IS NOT NULL"), "stratum")
    found = found.select("stratum", *(F.when(F.col(r) >= F.col("above"), F.get(grid, F.col(r) - F.col("above"))).alias(_cut(r)) for r in RULES))
    return written(found.where(F.coalesce(*map(_cut, RULES)).isNotNull()), "cutoffs")


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= STRATA else table


def _cell(value):
    """The index of the most lenient cutoff of the grid that the value exceeds; their number if none."""
    grid = F.array(*map(F.lit, GRID))
    return F.size(F.filter(grid, lambda g: g >= F.coalesce(value, F.lit(0.0))))


def _base():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The counts of every document with base_failed and kept."""
    measured = written(counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).alias("stratum"), "text")), "counts")
    found = cutoffs(measured, labels, "stratum", risk, level)
    strata = found.count()
    rows = measured.withColumn("stratum", F.coalesce("stratum", F.lit("")))
    if strata <= STRATA:
        rows = rows.join(F.broadcast(found), "stratum", "left")
    else:
        hashed, own = F.xxhash64("stratum"), {"stratum": "of"}
        times = rows.groupBy(hashed.alias("key")).agg(F.count(F.lit(1)).alias("times"))
        cuts = found.withColumnsRenamed(own).withColumn("key", F.xxhash64("of")).join(times, "key")
        rows = spread_join(rows.withColumn("key", hashed), cuts, "key", "times", hot_from(measured.count()), place())
        rows = rows.select("doc_id", *COUNTS, *(F.when(F.col("of") == F.col("stratum"), F.col(_cut(r))).alias(_cut(r)) for r in RULES))
    beyond = (F.coalesce(F.expr(e) > F.col(_cut(r)), F.lit(False)) for r, e in RULES.items())
    fails = reduce(lambda a, b: a | b, beyond)
    return rows.select("doc_id", *COUNTS, _base().alias("base_failed"), (~_base() & ~fails).alias("kept"))
