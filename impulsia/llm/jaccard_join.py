"""N-gram Jaccard join by a token-group matrix.

Two documents link when their sets of SHINGLE-word shingles have a Jaccard likeness of at least THRESHOLD percent; the
result is each document's component. Equal sets are one set from here on.

1. Tokens are ordered by hash (in step 3, the most frequent ones last). Sets that link share at least L of the first n - ceil(t n) + L tokens of both, for any
   L; with L a share of n, a set most of whose first tokens no other document has among its own is alone. This leaves
   the few sets that could link.
2. Those are parted into groups of similar ones by the commonest of their smallest tokens, a large group at random, twice over, into
   cells of about CELL, each with the group's hub (its smallest set id). A cell stores its token union; a member is
   compared with the members of its own cells, and each cell's local components are found at once. Components that
   share a set, as most of a large group do, are one.
3. For the links that remain, sets are queries against the cells that hold members of other components. The
   token-group matrix has a row for each token of a prefix and cell that has it in one: the number of rows that a query
   meets bounds its overlap with the cell's members, and no set travels to a cell where it is less than a link needs
   (as in step 1, MATRIX percent for L). A cell is then opened only if the query's overlap with its whole union reaches
   t n; members are compared exactly. The queries of a cell are dealt into parts of about QUERIES, each with the members.

What has a row a document, set or component is joined by spread_join(): a third of all rows may be copies of one text
or lie in one component.

A null or empty text, or one without words, has an empty set and links with nothing; a text of fewer words than a
shingle has its whole sequence as its set. A null id is a member like any other but never the smallest. Repeated rows
link as copies do; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsia.llm import exchange as X
from impulsia.llm import kernels as K
from impulsia.llm.common import discard, hot_from, parts, place, prepare, resident, spread_join, written
from impulsia.llm.components import components

SHINGLE, THRESHOLD = 5, 80
#: Sets of a cell, and how many of a set's smallest tokens may name its group.
CELL, SMALLEST = 64, 4
#: The most frequent tokens, so many at most, come last in step 3; counted are those that LOCAL sets of a partition have.
FREQUENT, LOCAL = 1 << 16, 4
#: Of a set's tokens, the share that step 1 looks at beyond those that a link must touch, in percent.
EXTRA = 30
#: The same in step 3.
MATRIX = 10
#: Queries of a cell that a task holds, about.
QUERIES = 2048


def least_overlap(n):
    """What a set of n shares at least with one it links to."""
    return -(-THRESHOLD * n // 100)


def prefix_length(n):
    return n - least_overlap(n) + 1


def sets_of(table: pa.Table):
    """Runs of (first row, token sets sorted by text, bounds) over a table's texts, lower-cased."""
    for lo, _, data, offsets in K.chunks(table.column("text")):
        yield lo, *K.shingle_sets(K.LOWER[data], offsets, SHINGLE)


def set_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))])[bounds]
    return K.mix(sums[1:] - sums[:-1] + np.diff(bounds).astype(np.uint64))


def _first(tokens: np.ndarray, bounds: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first count tokens of each set, and the set of each."""
    text = np.repeat(np.arange(len(count)), count)
    return np.arange(len(text)) + np.repeat(bounds[:-1] - np.cumsum(count) + count, count), text


def _looked_at(n: np.ndarray, extra: int = EXTRA) -> np.ndarray:
    return np.where(n > 0, np.minimum(n, prefix_length(n) - 1 + np.maximum(1, extra * n // 100)), 0)


def _send(slots: X.Slots):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        resident()
        seen: set[int] = set()
        found = []
        for _, tokens, bounds in sets_of(table):
            ids = set_ids(tokens, bounds)
            _, one = np.unique(ids, return_index=True)
            new = np.array([i for i in one if int(ids[i]) not in seen], np.int64)
            seen.update(ids[new].tolist())
            count = np.zeros(len(ids), np.int64)
            count[new] = _looked_at(np.diff(bounds)[new])
            at, _ = _first(tokens, bounds, count)
            found.append(tokens[at])
        once, many = X.once_and_many(np.concatenate([np.empty(0, np.uint64), *found]))
        return X.sent(key[0].as_py(), slots, once, many)

    return send


def _candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
    """A row for each document: its set's id and size; the tokens for the first of each set of the bucket that could link."""
    resident()
    known, seen = X.Known(answers.column("shared").to_pylist()), set()
    n_all, ids_all, blobs = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], []
    for _, tokens, bounds in sets_of(table):
        n, ids = np.diff(bounds), set_ids(tokens, bounds)
        at, text = _first(tokens, bounds, _looked_at(n))
        shared = np.bincount(text[known.has(tokens[at])], minlength=len(n))
        # A partner has at least t n tokens, so both prefixes share at least what the smaller one's size asks for.
        could = shared >= np.maximum(1, EXTRA * least_overlap(n) // 100)
        for i in range(len(n)):
            if n[i] and could[i] and int(ids[i]) not in seen:
                seen.add(int(ids[i]))
                blobs.append(tokens[bounds[i] : bounds[i + 1]].tobytes())
            else:
                blobs.append(None)
        n_all.append(n)
        ids_all.append(ids)
    return pa.table(
        [table.column("doc_id"), pa.array(np.concatenate(n_all), pa.int64()), pa.array(K.signed(np.concatenate(ids_all)), pa.int64()), pa.array(blobs, pa.binary())],
        names=["doc_id", "n", "set_id", "tokens"],
    )


class Cell:
    """The sets of a group with their token union and, for each token of it, who has it."""

    def __init__(self, ids: Sequence[int], blobs: Sequence[bytes]):
        self.ids, self.sets = ids, [np.frombuffer(b, np.uint64) for b in blobs]
        self.n = np.array([len(s) for s in self.sets])
        flat = np.concatenate(self.sets)
        member = np.repeat(np.arange(len(ids)), self.n)
        order = np.argsort(flat, kind="stable")
        self.member = member[order]
        self.union, begin = np.unique(flat[order], return_index=True)
        self.begin = np.append(begin, len(flat))

    def overlaps(self, query: np.ndarray) -> np.ndarray | None:
        """Tokens that the query shares with each member; None if those in the union are too few for any link."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        at = at[self.union[at] == query]
        if len(at) < least_overlap(len(query)):
            return None
        lengths = self.begin[at + 1] - self.begin[at]
        ends = np.cumsum(lengths)
        where = np.repeat(self.begin[at] - ends + lengths, lengths) + np.arange(ends[-1])
        return np.bincount(self.member[where], minlength=len(self.ids))

    def links(self, query: np.ndarray) -> np.ndarray:
        """The members that the query links to."""
        shared = self.overlaps(query)
        if shared is None:
            return np.empty(0, np.int64)
        return np.flatnonzero(100 * shared >= THRESHOLD * (self.n + len(query) - shared))


def _local(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Components within a cell, named after their smallest set; the hub is the smallest of its cells and told by the first of them."""
    ids, blobs = zip(*sorted(zip(table.column("set_id").to_pylist(), table.column("tokens").to_pylist(), strict=True)), strict=True)
    cell, root = Cell(ids, blobs), list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, query in enumerate(cell.sets):
        for j in cell.links(query):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    told = range(0 if key[1].as_py() == 0 else 1, len(ids))
    return pa.table([pa.array([ids[i] for i in told], pa.int64()), pa.array([ids[find(i)] for i in told], pa.int64())], names=["set_id", "comp"])


def _open(queries: pa.Table, members: pa.Table) -> pa.Table:
    """Links between queries and the members of the groups that they were sent to."""
    out: tuple[list, list] = ([], [])
    if queries.num_rows and members.num_rows:
        rows = sorted(zip(members.column("comp").to_pylist(), members.column("tokens").to_pylist(), strict=True))
        cell = Cell([r[0] for r in rows], [r[1] for r in rows])
        for comp, blob in zip(queries.column("q_comp").to_pylist(), queries.column("q_tokens").to_pylist(), strict=True):
            for other in {cell.ids[j] for j in cell.links(np.frombuffer(blob, np.uint64))} - {comp}:
                out[0].append(comp)
                out[1].append(other)
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])


def _frequent(batches):
    """The tokens that at least LOCAL sets of a partition have, with their number."""
    flat = [np.frombuffer(b, np.uint64) for batch in batches for b in batch.column(0).to_pylist()]
    found, times = np.unique(np.concatenate([np.empty(0, np.uint64), *flat]), return_counts=True)
    keep = times >= LOCAL
    yield pa.RecordBatch.from_arrays([pa.array(K.signed(found[keep]), pa.int64()), pa.array(times[keep], pa.int64())], names=["token", "times"])


def _prefixes(last):
    """The tokens of each set's prefix. last: tokens that come last, and in which order."""

    def cut(batches):
        late, rank = last.value
        for batch in batches:
            sets = [np.frombuffer(b, np.uint64) for b in batch.column(batch.schema.get_field_index("tokens")).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([np.empty(0, np.uint64), *sets])
            text = np.repeat(np.arange(len(sets)), n)
            order = np.zeros(len(flat), np.int64)
            if len(late):
                at = np.minimum(np.searchsorted(late, flat), len(late) - 1)
                order = np.where(late[at] == flat, rank[at], 0)
            flat = flat[np.lexsort((flat, order, text))]
            count = _looked_at(n, MATRIX)
            at, row = _first(flat, np.concatenate([[0], np.cumsum(n)]), count)
            rest = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in ("set_id", "comp", "n", "hub", "cell", "size")]
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(flat[at]), pa.int64()), *rest], names=["token", "set_id", "comp", "n", "hub", "cell", "size"])

    return cut


def joined(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    prepare(docs.sparkSession)
    slots = X.slots_for(parts(docs))
    dealt = X.bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), slots)
    answers = X.answered(dealt.groupBy("_bucket").applyInArrow(_send(slots), X.SENT), slots)
    rows = dealt.groupBy("_bucket").cogroup(answers.groupBy("_bucket")).applyInArrow(_candidates, "doc_id long, n long, set_id long, tokens binary")
    rows = written(rows, "sets")
    members = rows.select("doc_id", "n", "set_id")
    links = components_of_sets(rows.where("tokens IS NOT NULL").select("set_id", "n", "tokens"))
    # A row a set, then a row a component; only sets of several documents or with links are asked for again.
    sets = members.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times"))
    sets = sets.join(links, "set_id", "left").where("times > 1 OR comp IS NOT NULL")
    sets = written(sets.select("set_id", "least", "times", F.coalesce("comp", "set_id").alias("comp")), "named")
    hot = hot_from(members.count())
    roots = sets.groupBy("comp").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("sets"))
    told = spread_join(sets.select("set_id", "times", "comp"), roots, "comp", "sets", hot, "set_id").select("set_id", "times", "component")
    # Empty sets have no row to find, and are dealt out.
    asking = members.withColumn("set_id", F.when(F.col("n") > 0, F.col("set_id")).otherwise(F.xxhash64(place())))
    found = spread_join(asking, told, "set_id", "times", hot, place())
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def components_of_sets(candidates: DataFrame) -> DataFrame:
    """set_id and comp, a name of its component, for each set of the candidates that links to another. Rows of equal set_id are copies."""
    sets = written(candidates.groupBy("set_id").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "distinct", "set_id")
    hot = hot_from(sets.count())
    # Of a set's smallest tokens (of eight bytes, little-endian, as they are sorted) the one that most sets have among theirs.
    first = F.explode(F.array(*(F.substring("tokens", 1 + 8 * k, 8) for k in range(SMALLEST)))).alias("least")
    few = sets.select("set_id", first).where("length(least) = 8").select("set_id", F.xxhash64("least").alias("least"))
    often = spread_join(few, few.groupBy("least").agg(F.count(F.lit(1)).alias("all"), F.count(F.lit(1)).alias("times")), "least", "all", hot, "set_id")
    often = often.groupBy("set_id").agg(F.max(F.struct("times", "least")).alias("_k")).select("set_id", "_k.least")
    chosen = written(often, "named")
    # The sets' tokens stay in buckets by set_id, so that only narrow rows are shuffled for their places and components.
    groups = chosen.groupBy("least").agg(F.min("set_id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    cells = F.ceil(F.col("size") / F.lit(CELL)).cast("int")
    at = spread_join(chosen, groups.select("least", "hub", cells.alias("cells"), "size"), "least", "size", hot, "set_id")
    cell = F.when(F.col("set_id") == F.col("hub"), 0).otherwise(F.coalesce(F.pmod(F.xxhash64("set_id"), F.col("cells")), F.lit(0))).cast("int")
    at = at.select("set_id", F.coalesce("hub", "set_id").alias("hub"), cell.alias("cell"), "cells")
    placed = written(sets.join(at, "set_id").select("set_id", "n", "tokens", "hub", "cell", "cells"), "placed", "set_id")
    discard(sets, chosen)
    # A set of a large group goes to a cell of either of two deals; where its local components meet, they are one.
    again = F.when(F.col("cells") > 1, F.col("cells") + F.pmod(F.xxhash64("set_id", F.lit("again")), F.col("cells"))).cast("int")
    deals = F.explode(F.filter(F.array("cell", again), lambda c: c.isNotNull())).alias("cell")
    others = placed.where("cells IS NOT NULL AND set_id <> hub").select("hub", deals, "set_id", "tokens")
    last = F.when(F.col("cells") > 1, 2 * F.col("cells")).otherwise(1).cast("int") - 1
    hubs = placed.where("cells IS NOT NULL AND set_id = hub").select("hub", F.explode(F.sequence(F.lit(0), last)).alias("cell"), "set_id", "tokens")
    local = written(others.unionByName(hubs).groupBy("hub", "cell").applyInArrow(_local, "set_id long, comp long"), "local")
    first = local.groupBy("set_id").agg(F.min("comp").alias("comp"), F.max("comp").alias("other"))
    met = components(first.where("comp <> other").select(F.col("comp").alias("a"), F.col("other").alias("b")).distinct())
    each = first.groupBy("comp").agg(F.count(F.lit(1)).alias("sets")).join(met.select(F.col("node").alias("comp"), "root"), "comp")
    first = spread_join(first.select("set_id", "comp"), each, "comp", "sets", hot, "set_id").select("set_id", F.coalesce("root", "comp").alias("comp"))
    first = written(first, "first")
    # Sets of a component in no other's cell have it for themselves.
    sizes = first.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.count(F.lit(1)).alias("times"))
    sized = spread_join(first, sizes, "comp", "times", hot, "set_id")
    comps = placed.join(sized, "set_id", "left").select("set_id", "n", "tokens", "hub", "cell", F.coalesce("comp", "set_id").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    comps = written(comps, "comps", "set_id")
    discard(placed, local, first)

    # The matrix has a row for each token and cell; of two sets, the one of the smaller component (of equals, of the
    # smaller name) asks the other's cell.
    # Any one order of tokens is right; with frequent ones last, sets that share a common passage alone don't meet.
    often = comps.select("tokens").mapInArrow(_frequent, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    often = often.orderBy(F.desc("times"), "token").limit(FREQUENT).select("token").toArrow()
    late = often.column("token").to_numpy().view(np.uint64)
    rank = np.arange(len(late), 0, -1)
    order = np.argsort(late)
    last = comps.sparkSession.sparkContext.broadcast((late[order], rank[order]))
    tokens = comps.mapInArrow(_prefixes(last), "token long, set_id long, comp long, n long, hub long, cell int, size long")
    contested = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    tokens = written(tokens.join(contested, "token"), "tokens")
    last.destroy()
    rank = F.struct("size", "comp")
    matrix = tokens.groupBy("token", F.col("hub").alias("g_hub"), F.col("cell").alias("g_cell")).agg(F.min("n").alias("g_least"), F.max("n").alias("g_most"), F.max(rank).alias("g_rank"))
    fits = (100 * F.col("g_most") >= THRESHOLD * F.col("n")) & (THRESHOLD * F.col("g_least") <= 100 * F.col("n"))
    met = tokens.join(matrix, "token").where(fits & (F.col("g_rank") > rank)).groupBy("set_id", "g_hub", "g_cell").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("shared"))
    # A partner has t n tokens at least, and so as large a share of the first ones in common.
    needed = F.greatest(F.lit(1), F.floor(F.lit(MATRIX) * F.ceil(F.lit(THRESHOLD) * F.col("n") / 100) / 100))
    pairs = written(met.where(F.col("shared") >= needed).select("set_id", "g_hub", "g_cell"), "pairs")
    parts_ = pairs.groupBy("g_hub", "g_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("parts"))
    asked = pairs.join(parts_, ["g_hub", "g_cell"]).join(comps.select("set_id", F.col("comp").alias("q_comp"), F.col("tokens").alias("q_tokens")), "set_id")
    asked = asked.select("g_hub", "g_cell", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int").alias("part"), "q_comp", "q_tokens")
    wanted = comps.select("set_id", F.col("hub").alias("g_hub"), F.col("cell").alias("g_cell")).join(parts_, ["g_hub", "g_cell"])
    opened = comps.select("set_id", "comp", "tokens").join(wanted, "set_id")
    opened = opened.select("g_hub", "g_cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "comp", "tokens")
    key = ["g_hub", "g_cell", "part"]
    edges = asked.groupBy(*key).cogroup(opened.groupBy(*key)).applyInArrow(_open, "a long, b long")
    merged = components(edges.distinct())
    discard(tokens, pairs)
    each = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("sets")).join(merged.select(F.col("node").alias("comp"), "root"), "comp")
    named = spread_join(comps.select("set_id", "comp"), each, "comp", "sets", hot, "set_id")
    return named.select("set_id", F.coalesce("root", "comp").alias("comp"))
