"""Document fingerprints by a threshold-scaled sketch.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, so sketches of any two
documents, however unequal, are samples at one rate: their union is the sketch of the joined documents, and the share
of one's hashes that the other holds estimates containment. The FLOOR smallest hashes are kept besides, so that a short
document has a sketch too (up to FLOOR shingles, an exact one). A pair is compared below the hash up to which both
sketches are complete.

A null or empty text has no shingles: the likeness of two such is 1, of one to any other 0. A text of fewer words than
a shingle has its whole sequence as its only shingle. Equal texts have equal fingerprints. Repeated rows are
fingerprinted each; columns that aren't asked for are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impulsia.llm import kernels as K
from impulsia.llm.common import parts, prepare, resident

SHINGLE = 5
#: One of so many hashes lies below the threshold.
SCALE = 8
FLOOR = 32
#: Hashes are kept to so many bits; 5 bytes each.
BITS = 40
TOP = 1 << BITS
#: Neighbours by id are found within runs of ids and between the runs' ends: so many runs a partition of the shuffle, and so many runs in all at most.
RUNS, MOST_RUNS = 4, 1 << 14


class Sketches:
    """The sketches of a run of texts: hashes sorted by text and size, bounds, shingle counts and up to where each is complete."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        n = len(bounds) - 1
        self.counts = np.diff(bounds)
        text = np.repeat(np.arange(n), self.counts)
        hashes = hashes >> np.uint64(64 - BITS)
        keep = (hashes < np.uint64(TOP // SCALE)) | (np.arange(len(hashes)) - np.repeat(bounds[:-1], self.counts) < FLOOR)
        self.hashes, text = hashes[keep], text[keep]
        self.keys = (text.astype(np.uint64) << np.uint64(BITS)) | self.hashes
        self.bounds = np.searchsorted(text, np.arange(n + 1))
        kept = np.diff(self.bounds)
        self.upto = np.full(n, TOP, np.uint64)
        part = np.flatnonzero(kept < self.counts)
        self.upto[part] = np.maximum(np.uint64(TOP // SCALE), self.hashes[self.bounds[part + 1] - 1] + np.uint64(1))

    def strings(self) -> list[str]:
        raw = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes().hex()
        at = self.bounds * (BITS // 4)
        return [f"{c:x}.{raw[lo:hi]}" for c, lo, hi in zip(self.counts, at[:-1], at[1:], strict=True)]


def _below(s: Sketches, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = np.repeat(np.arange(len(upto)), np.diff(s.bounds))
    keep = s.hashes < upto[text]
    return s.keys[keep], text[keep]


def likeness(a: Sketches, b: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Estimates for each pair: Jaccard likeness, and the share of a's shingles that b has."""
    upto = np.minimum(a.upto, b.upto)
    (left, text), (right, other) = _below(a, upto), _below(b, upto)
    at = np.searchsorted(right, left)
    found = at < len(right)
    found[found] = right[at[found]] == left[found]
    n = len(upto)
    both, of_a, of_b = (np.bincount(x, minlength=n) for x in (text[found], text, other))
    union, empty = of_a + of_b - both, (a.counts == 0) & (b.counts == 0)
    return np.where(empty, 1.0, both / np.maximum(union, 1)), np.where(empty, 1.0, both / np.maximum(of_a, 1))


def sketch(column: pa.Array) -> Iterator[Sketches]:
    for _, _, data, offsets in K.chunks(column):
        yield Sketches(*K.shingle_sets(data, offsets, SHINGLE))


def _parse(strings: list[str]) -> Sketches:
    made = Sketches(np.empty(0, np.uint64), np.zeros(len(strings) + 1, np.int64))
    rows = [s.partition(".") for s in strings]
    made.counts = np.array([int(a, 16) for a, _, _ in rows], np.int64)
    wide = [np.frombuffer(bytes.fromhex(b), np.uint8).reshape(-1, BITS // 8) for _, _, b in rows]
    made.bounds = np.concatenate([[0], np.cumsum([len(w) for w in wide])])
    flat = np.concatenate(wide or [np.empty((0, BITS // 8), np.uint8)]).astype(np.uint64)
    made.hashes = np.zeros(len(flat), np.uint64)
    for j in range(BITS // 8):
        made.hashes = (made.hashes << np.uint64(8)) | flat[:, j]
    kept = np.diff(made.bounds)
    made.keys = (np.repeat(np.arange(len(rows)), kept).astype(np.uint64) << np.uint64(BITS)) | made.hashes
    made.upto = np.full(len(rows), TOP, np.uint64)
    part = np.flatnonzero(kept < made.counts)
    made.upto[part] = np.maximum(np.uint64(TOP // SCALE), made.hashes[made.bounds[part + 1] - 1] + np.uint64(1))
    return made


def compare(a: str, b: str) -> tuple[float, float]:
    """Likeness of two fingerprints, and the estimated share of the first's shingles that the second has."""
    j, c = likeness(_parse([a]), _parse([b]))
    return float(j[0]), float(c[0])


def merge(a: str, b: str) -> str:
    """The fingerprint of the union of both documents' shingles, whose count is then an estimate."""
    x, y = _parse([a]), _parse([b])
    upto = np.minimum(x.upto, y.upto)[0]
    hashes = np.union1d(x.hashes, y.hashes)
    hashes = hashes[hashes < upto]
    count = len(hashes) if upto == TOP else max(len(hashes) + 1, round(len(hashes) * TOP / int(upto)))
    return f"{count:x}." + hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint of each text, without a shuffle. A column of that name is replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop(column)
    schema = docs.select("*", F.lit("").alias(column)).schema

    def add(batches):
        for batch in batches:
            made = [s for part in sketch(batch.column(batch.schema.get_field_index(text))) for s in part.strings()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, column])

    return docs.mapInArrow(add, schema)


def _compared(batches):
    resident()
    for batch in batches:
        texts, edits, nexts = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "edited", "next_text"))
        n, out = batch.num_rows, []
        for lo in range(0, n, 256):
            own, edited, after = (Sketches(*_flat(x.slice(lo, 256))) for x in (texts, edits, nexts))
            near, inside = likeness(own, edited)
            out.append((own.strings(), edited.strings(), near, likeness(own, after)[0], inside, own.counts))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_chars", "edited_sha256"))]
            + [pa.array([s for x in cols[i] for s in x], pa.string()) for i in (0, 1)]
            + [pa.array(np.concatenate(cols[i]) if cols[i] else [], pa.float64()) for i in (2, 3, 4)]
            + [pa.array(np.concatenate(cols[5]) if cols[5] else [], pa.int64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "n_shingles"],
        )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of all texts of a short column, gathered from runs of bounded size."""
    hashes, bounds, at = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in K.chunks(column):
        h, b = K.shingle_sets(data, offsets, SHINGLE)
        hashes.append(h)
        bounds.append(b[1:] + at)
        at += len(h)
    return np.concatenate(hashes or [np.empty(0, np.uint64)]), np.concatenate(bounds)


def _in_runs(rows: DataFrame, runs: int) -> DataFrame:
    """rows with a run: even, consecutive ranges of descending ids, ascending from the largest ids to the null ones. An id that fills several of them has as many, over which its rows are dealt by a hash."""
    total, known = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    at = rows.approxQuantile("doc_id", [k / runs for k in range(1, runs)], 1 / (4 * runs)) if known else []
    times = Counter(at)
    wide = {x: k for x, k in times.items() if k > 1}
    cuts = sorted({*times, *(math.nextafter(x, math.inf) for x in wide)}) or [0.0]
    bucketizer = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_id", outputCol="_range", handleInvalid="keep")
    rows = bucketizer.transform(rows.withColumn("_id", F.col("doc_id").cast("double")))
    rows = rows.withColumn("_back", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_range").cast("long")))
    shares = {bisect_right(cuts, x): k for x, k in wide.items()}
    # Large ids that one double stands for lie in one range: the most frequent is dealt, others come before and after it.
    often = rows.where(F.col("_back").isin([*shares])).groupBy("_back", "doc_id").count().groupBy("_back").agg(F.max_by("doc_id", "count").alias("_hot")) if shares else None
    hot = {r["_back"]: r["_hot"] for r in often.collect()} if shares else {}
    table = [(x, k, hot.get(x)) for x, k in shares.items()] + [(-1, -(-(total - known) * runs // max(1, total)), None)]
    subs = rows.sparkSession.createDataFrame(table, "_back long, _subs long, _hot long")
    rows = rows.join(F.broadcast(subs), "_back", "left")
    dealt = F.pmod(F.xxhash64("tie", F.monotonically_increasing_id()), F.col("_subs"))
    sub = F.when(F.col("doc_id") > F.col("_hot"), 0).when(F.col("doc_id") < F.col("_hot"), F.col("_subs") - 1).when(F.col("_subs") > 1, dealt).otherwise(F.lit(0))
    return rows.withColumn("run", F.col("_back") * F.lit(-(1 << 32)) + sub).drop("_id", "_range", "_back", "_subs", "_hot")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last third is replaced by as much of the start of the next document by descending doc_id (after the last, the first).

    Rows of one id follow each other by text hash (an id so frequent that it fills several runs, run by run); null ids come last. The text is shuffled once, by runs of ids; the first row of the next run, found before the shuffle, joins each run as its end.
    """
    prepare(docs.sparkSession)
    n = parts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    rows = _in_runs(rows, max(2, min(RUNS * n, MOST_RUNS)))
    order = [F.desc_nulls_last("doc_id"), F.col("tie")]
    first = rows.select("*", F.row_number().over(Window.partitionBy("run").orderBy(*order)).alias("place")).where("place = 1")
    # A row a run, of which there are MOST_RUNS and a few at most: no window over documents.
    down = Window.orderBy("run")
    links = rows.select("run").distinct().select("run", F.coalesce(F.lead("run").over(down), F.min("run").over(Window.partitionBy())).alias("next_run"))
    ends = links.join(first.select(F.col("run").alias("next_run"), "text"), "next_run")
    ends = ends.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("tie"), "run", F.lit(1).alias("end"))
    after = Window.partitionBy("run").orderBy("end", *order)
    dealt = rows.select("*", F.lit(0).alias("end")).unionByName(ends).repartition(n, "run")
    pairs = dealt.select("*", F.lead("text").over(after).alias("next_text")).where("end = 0")
    n_chars = F.char_length("text").cast("long")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"), F.expr("substring(next_text, 1, cast(n_chars div 3 as int))"))
    pairs = pairs.select("*", n_chars.alias("n_chars")).select("*", edited.alias("edited"))
    pairs = pairs.select("*", F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, n_shingles long"
    return pairs.mapInArrow(_compared, schema)
