"""Language-model scores by context-tree weighting over bytes, beside a base score of word counts.

A byte is eight binary decisions; each has, for every context of 0 to DEPTH preceding bytes, a node with counts of
either outcome over all training texts and their Krichevsky-Trofimov estimate. The weight that a node gives its own
estimate against its longer contexts' is the context tree's posterior, computed bottom-up from all counts. Subtrees of
the two bytes before (65,536 of them at most) are counted and weighted by different tasks.

The tree grows with the corpus: every node of two and more context bytes is kept by its whole context, in slots by the
two bytes before. Counts travel packed by slot from each input partition; where a slot would be sent more than HEAVY
bytes of them (the commonest pairs of bytes, words of a large corpus), those of equal keys are first brought together by
as many tasks as that takes. Buckets of documents ask for the distinct bytes in context they have, and the slot of each
answers with its probability; only nodes of no and one context byte (65,792) are broadcast. A context never seen gives its
weight to the longest one seen. The probability of a byte given its context is then the product of eight mixtures, and
the score of a text the sum of log10 over its bytes, A-Z lower-cased, and an end mark.

A null or empty text is its end alone: one token. Null ids belong to crc32 of the empty text (learned from). Repeated
rows count and are scored each; other columns are ignored; an empty table gives no rows; without training rows every
decision is even.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsia.llm import exchange as X
from impulsia.llm import kernels as K
from impulsia.llm.common import learns, parts, prepare, resident, written

DEPTH = 5
MOD, OUT = 5, 1
#: The word that ends every text.
END = np.uint64(0x2545F4914F6CDD1D)
#: Bytes in context that a slot evaluates together.
TOGETHER = 2_000_000
#: Bytes of counts that a slot reads uncombined.
HEAVY = 64 << 20
RANGES = 64
U = np.uint64


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end for each text, and where each text's begin."""
    starts, ends, bounds = K.spans(data, offsets)
    return np.insert(K.span_hash(data, starts, ends), bounds[1:], END), bounds + np.arange(len(bounds))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end (0): itself in the lowest byte, the DEPTH before it above, the nearest highest; before a text are zeros."""
    n = len(offsets) - 1
    pad = np.zeros(len(data) + n * (DEPTH + 1), np.uint64)
    begin = offsets[:-1] + np.arange(n) * (DEPTH + 1) + DEPTH  # each text after DEPTH zeros, then its end
    text = np.repeat(np.arange(n), np.diff(offsets))
    at = np.arange(len(data)) + (begin - offsets[:-1])[text]
    pad[at] = data
    bounds = offsets + np.arange(n + 1)
    text = np.repeat(np.arange(n), np.diff(bounds))
    at = np.arange(bounds[-1]) + (begin - bounds[:-1])[text]
    out = pad[at].copy()
    for d in range(1, DEPTH + 1):
        out |= pad[at - d] << U(8 * (DEPTH - d + 1))
    return out, bounds


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Tally:
    """Counts by key, brought together now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self.parts.append((found, counts.astype(np.int64)))
        self.size += len(found)
        if self.size > 4_000_000:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])
            if self.size > 2_000_000:
                self.size = 0  # mostly distinct: wait for as many again

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return _summed(*(np.concatenate([p[i] for p in self.parts]) for i in (0, 1)))


def near_slot(cells: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each byte in context, by the two bytes before."""
    near = K.mix(cells >> U(8 * (DEPTH - 1)))
    return (((near >> U(32)) * U(slots)) >> U(32)).astype(np.int64)


SENT = "kind int, _slot int, keys binary, counts binary"


def _packed(kind: int, slot: np.ndarray, keys: np.ndarray, counts: np.ndarray, slots: int, cols: list[list]) -> None:
    order = np.argsort(slot, kind="stable")
    keys, counts = keys[order], counts[order]
    edges = np.searchsorted(slot[order], np.arange(slots + 1, dtype=slot.dtype))
    for s in np.flatnonzero(np.diff(edges) > 0):
        lo, hi = edges[s], edges[s + 1]
        for c, v in zip(cols, (kind, int(s), keys[lo:hi].tobytes(), counts[lo:hi].tobytes()), strict=True):
            c.append(v)


def _count(slots: int):
    def count(batches):
        resident()
        words, cells = Tally(), Tally()
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                low = K.LOWER[data]
                words.add(lower_words(low, offsets)[0])
                cells.add(grams(low, offsets)[0])
        cols: list[list] = [[], [], [], []]
        keys, counts = words.total()
        _packed(0, (((keys >> U(32)) * U(slots)) >> U(32)).astype(np.int64), keys, counts, slots, cols)
        keys, counts = cells.total()
        _packed(1, near_slot(keys, slots), keys, counts, slots, cols)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["kind", "_slot", "keys", "counts"])

    return count


def _parts(batches):
    """Rows of heavy slots cut by a hash of the key: a row a part."""
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for row in batch.to_pylist():
            keys, counts = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64)
            part = (K.mix(keys ^ U(0x632BE59BD9B4E019)) % U(row["parts"])).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(row["parts"] + 1))
            for p in np.flatnonzero(np.diff(edges) > 0):
                at = order[edges[p] : edges[p + 1]]
                for c, v in zip(cols, (row["kind"], row["_slot"], int(p), keys[at].tobytes(), counts[at].tobytes()), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), *(pa.array(c, pa.binary()) for c in cols[3:])], names=["kind", "_slot", "part", "keys", "counts"])


def _together(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    keys, counts = _gathered(table)
    return pa.table([*(pa.array([k.as_py()], pa.int32()) for k in key[:2]), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["kind", "_slot", "keys", "counts"])


def combined(sent: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """What was sent, of heavy slots with the counts of equal keys brought together."""
    sizes = sent.groupBy("kind", "_slot").agg(F.sum(F.length("keys").cast("long")).alias("size")).where(F.col("size") > heavy)
    sizes = written(sizes.select("kind", "_slot", F.ceil(F.col("size") / F.lit(heavy)).cast("int").alias("parts")), "heavy")
    if not sizes.count():
        return sent
    few = F.broadcast(sizes)  # two kinds of slots: a row for 64 MB of counts at most
    cut = sent.join(few, ["kind", "_slot"]).select("kind", "_slot", "parts", "keys", "counts").mapInArrow(_parts, "kind int, _slot int, part int, keys binary, counts binary")
    return sent.join(few, ["kind", "_slot"], "left_anti").unionByName(cut.groupBy("kind", "_slot", "part").applyInArrow(_together, SENT))


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist())])
    counts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())])
    return _summed(keys, counts)


def _word_counts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    keys, counts = _gathered(table)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([int(counts.sum())], pa.int64()), pa.array([len(keys)], pa.int64())], names=["_slot", "keys", "counts", "n", "v"])


_LGAMMA_HALF = math.lgamma(0.5)
_small = np.array([[math.lgamma(i + 0.5), math.lgamma(i + 1.0)] for i in range(4096)])


def _lgamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log gamma of n + 1/2, or of n + 1."""
    out = _small[np.minimum(n, 4095), 0 if half else 1]
    big = n >= 4096
    if big.any():
        x = n[big] + (0.5 if half else 1.0)
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _lgamma(n0, True) + _lgamma(n1, True) - 2 * _LGAMMA_HALF - _lgamma(n0 + n1, False)


def nodes_at(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one depth from its cells (context above the byte), ascending: context and bits so far after a leading one, and counts of either bit."""
    keys, zeros, ones = [], [], []
    byte = cells & U(255)
    for k in range(8):
        node = (cells & ~U(255)) | (U(1) << U(k)) | (byte >> U(8 - k))
        bit = ((byte >> U(7 - k)) & U(1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        total, one = np.add.reduceat(counts, first), np.add.reduceat(counts * bit, first)
        keys.append(node[first])
        zeros.append(total - one)
        ones.append(one)
    keys, zeros, ones = map(np.concatenate, (keys, zeros, ones))
    order = np.argsort(keys)
    return keys[order], zeros[order], ones[order]


def _weights(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of each node's counts, and the weight of its own estimate. below: nodes and log probabilities of contexts one byte longer."""
    own = log_kt(n0, n1)
    if below is None:
        return own, np.ones(len(own))
    # The farthest byte stands lowest in a context.
    parent = ((below[0] >> U(16)) << U(8)) | (below[0] & U(255))
    longer = np.bincount(np.searchsorted(keys, parent), below[1], len(keys))
    return np.logaddexp(own, longer) - math.log(2), 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))


def levels(cells: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Depth by depth from the deepest to two, the nodes of whole subtrees of two context bytes: keys, counts of either bit, weighted log probability and own weight."""
    below = None
    for depth in range(DEPTH, 1, -1):
        own, sums = _summed(((cells >> U(8 * (DEPTH - depth + 1))) << U(8)) | (cells & U(255)), counts)
        keys, n0, n1 = nodes_at(own, sums)
        logs, w = _weights(keys, n0, n1, below)
        below = (keys, logs)
        yield depth, (keys, n0, n1, logs, w)


#: part -1: a slot's bytes in context and their counts; others: ranges of depth-1 nodes and their sums.
NODES = "part int, _slot int, keys binary, counts binary"


def _subtrees(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The counts of a slot, brought together, and what the contexts above need of its subtrees."""
    cells, counts = _gathered(table)
    for _, found in levels(cells, counts):
        keys, n0, n1, logs, _ = found
    # Depth 1: logs of longer contexts and counts by the nearest byte and node.
    parent = ((keys >> U(16)) << U(8)) | (keys & U(255))
    up, of = np.unique(parent, return_inverse=True)
    stacked = np.stack([np.bincount(of, x, len(up)) for x in (logs, n0.astype(np.float64), n1.astype(np.float64))], 1)
    cols: list[list] = [[-1], [cells.tobytes()], [counts.tobytes()]]
    edges = np.searchsorted(up, np.arange(RANGES + 1, dtype=np.uint64) * U((1 << 16) // RANGES))
    for r in np.flatnonzero(np.diff(edges) > 0):
        lo, hi = edges[r], edges[r + 1]
        for c, v in zip(cols, (int(r), up[lo:hi].astype(np.int32).tobytes(), stacked[lo:hi].tobytes()), strict=True):
            c.append(v)
    return pa.table([pa.array(cols[0], pa.int32()), pa.array([key[0].as_py()] * len(cols[0]), pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["part", "_slot", "keys", "counts"])


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    part, width = key[0].as_py(), (1 << 16) // RANGES
    total = np.zeros((width, 3))
    for p, s in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
        total[np.frombuffer(p, np.int32) - part * width] += np.frombuffer(s, np.float64).reshape(-1, 3)
    return pa.table([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])


def assemble(rows: list[tuple[int, bytes]]) -> dict[int, np.ndarray]:
    """Of depths 0 and 1, the probability of a one and the own weight of each node (0: never seen)."""
    near, width = np.zeros((1 << 16, 3)), (1 << 16) // RANGES
    for part, raw in rows:
        near[part * width : (part + 1) * width] = np.frombuffer(raw, np.float64).reshape(-1, 3)
    logs, n0, n1 = near[:, 0], near[:, 1].astype(np.int64), near[:, 2].astype(np.int64)

    def level(longer: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = log_kt(zeros, ones)
        seen = zeros + ones > 0
        w = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))
        table = np.stack([np.where(seen, (ones + 0.5) / (zeros + ones + 1), 0), np.where(seen, w, 0)], 1)
        return table, np.where(seen, np.logaddexp(own, longer) - math.log(2), 0)

    model = {}
    model[1], up = level(logs, n0, n1)
    model[0], _ = level(*(x.reshape(256, 256).sum(0) for x in (up, n0, n1)))
    return model


class Tree:
    """The context tree: depths 0 and 1 whole, and the table of counts by slot, of which any deeper node can be made."""

    def __init__(self, near: dict[int, np.ndarray], counts: DataFrame, slots: int):
        self.near, self.counts, self.slots = near, counts, slots

    def around(self, cells: np.ndarray) -> Scorer:
        """A scorer for these bytes in context, from their slots alone."""
        some = np.unique(near_slot(cells, self.slots)).tolist()
        return Scorer(self.near, *_gathered(self.counts.where(F.col("_slot").isin(some)).toArrow()))


class Scorer:
    """log10 probabilities of bytes in their contexts, of a whole tree or of the counts of some slots."""

    def __init__(self, tree: Tree | dict[int, np.ndarray], cells: np.ndarray = np.empty(0, np.uint64), counts: np.ndarray = np.empty(0, np.int64)):
        self.tree, self.deep = tree, {}
        for depth, (keys, n0, n1, _, w) in levels(cells, counts) if len(cells) else ():
            self.deep[depth] = keys, np.stack([(n1 + 0.5) / (n0 + n1 + 1), w], 1)

    def _found(self, depth: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if depth < 2:
            return tuple(self.tree[depth][key.astype(np.int64)].T)
        if depth not in self.deep:
            return np.zeros(len(key)), np.zeros(len(key))
        keys, values = self.deep[depth]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        p, w = values[at].T
        return np.where(keys[at] == key, p, 0), w

    def evaluate(self, cells: np.ndarray) -> np.ndarray:
        if isinstance(self.tree, Tree):
            return self.tree.around(cells).evaluate(cells)
        byte, total = cells & U(255), np.zeros(len(cells))
        for k in range(8):
            node = (U(1) << U(k)) | (byte >> U(8 - k))
            q, any_ = np.full(len(cells), 0.5), np.zeros(len(cells), bool)
            for depth in range(DEPTH, -1, -1):
                p, w = self._found(depth, ((cells >> U(8 * (DEPTH - depth + 1))) << U(8)) | node)
                seen = p > 0
                q = np.where(seen, np.where(any_, w * p + (1 - w) * q, p), q)
                any_ |= seen
            total += np.log10(np.where((byte >> U(7 - k)) & U(1), q, 1 - q))
        return total

    def logs(self, cells: np.ndarray) -> np.ndarray:
        """evaluate(), each distinct one once."""
        new, of = np.unique(cells, return_inverse=True)
        return np.concatenate([np.empty(0), *(self.evaluate(new[i : i + 100_000]) for i in range(0, len(new), 100_000))])[of]


class Lookup:
    """Values by key, all keys asked for being there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.mask = U((1 << max(1, (2 * len(keys)).bit_length())) - 1)
        self.at = np.zeros(int(self.mask) + 1, np.int32)
        self.at[(K.mix(self.keys) & self.mask).astype(np.int64)] = np.arange(len(keys))

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.at[(K.mix(keys) & self.mask).astype(np.int64)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.values[at]


def train(docs: DataFrame, slots: int | None = None) -> tuple[DataFrame, int, int, Tree]:
    """Word counts by slot, their sum and number, and the context tree, from the rows that learns() allows. Who asks by slot gives their number."""
    slots = slots or parts(docs)
    sent = written(docs.where(learns(MOD, OUT)).select("text").mapInArrow(_count(slots), SENT), "counts")
    sent = combined(sent)
    words = written(sent.where("kind = 0").groupBy("_slot").applyInArrow(_word_counts, "_slot int, keys binary, counts binary, n long, v long"), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    nodes = written(sent.where("kind = 1").groupBy("_slot").applyInArrow(_subtrees, NODES), "nodes")
    merged = nodes.where("part >= 0").groupBy("part").applyInArrow(_merged, "part int, sums binary")
    near = assemble([(r["part"], bytes(r["sums"])) for r in merged.toLocalIterator()])
    return words, total["n"], total["v"], Tree(near, nodes.where("part = -1").select("_slot", "keys", "counts"), slots)


ASKED = "kind int, _slot int, _from int, asked binary"


def _ask(slots: int):
    """What a bucket asks, each once: words (kind 0) and bytes in context (1)."""

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        words, cells = Tally(), Tally()
        for _, _, data, offsets in K.chunks(table.column("text")):
            low = K.LOWER[data]
            words.add(lower_words(low, offsets)[0])
            cells.add(grams(low, offsets)[0])
        cols: list[list] = [[], [], [], []]
        for kind, tally, slot in ((0, words, lambda x: (((x >> U(32)) * U(slots)) >> U(32)).astype(np.int64)), (1, cells, lambda x: near_slot(x, slots))):
            keys, counts = tally.total()
            _packed(kind, slot(keys), keys, counts, slots, cols)
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(np.full(len(cols[0]), key[0].as_py()), pa.int32()), pa.array(cols[2], pa.binary())], names=["kind", "_slot", "_from", "asked"])

    return ask


def _answer(shared):
    """Counts of the known ones among the words that buckets ask for, log10 probabilities of all bytes in context."""

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, counted: pa.Table) -> pa.Table:
        kind = (asked if asked.num_rows else counted).column("kind")[0].as_py()
        keys, counts = _gathered(counted)
        cols: tuple[list, list, list] = ([], [], [])
        buckets, blobs = asked.column("_from").to_pylist(), [np.frombuffer(b, np.uint64) for b in asked.column("asked").to_pylist()]
        scorer = Scorer(shared.value, keys, counts) if kind and blobs else None
        lo = 0
        while lo < len(blobs):
            hi, size = lo + 1, len(blobs[lo])
            while hi < len(blobs) and size + len(blobs[hi]) <= TOGETHER:
                size += len(blobs[hi])
                hi += 1
            logs = scorer.logs(np.concatenate(blobs[lo:hi])) if kind else None
            at = 0
            for bucket, own in zip(buckets[lo:hi], blobs[lo:hi], strict=True):
                if kind:
                    values = logs[at : at + len(own)]
                    at += len(own)
                else:
                    own = own[X._in(own, keys)]
                    values = counts[np.searchsorted(keys, own)]
                for c, v in zip(cols, (bucket, own.tobytes(), values.tobytes()), strict=True):
                    c.append(v)
            lo = hi
        return pa.table([pa.array([kind] * len(cols[0]), pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["kind", "_bucket", "keys", "counts"])

    return answer


def _scores(n: int, v: int):
    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, counts = _gathered(answers.filter(pc.equal(answers.column("kind"), 0)))
        told = answers.filter(pc.equal(answers.column("kind"), 1))
        chances = Lookup(*(np.concatenate([np.empty(0, t), *(np.frombuffer(b, t) for b in told.column(c).to_pylist())]) for c, t in (("keys", np.uint64), ("counts", np.float64))))
        unknown = math.log10(0.5)
        logs = np.log10(counts + 0.5)
        out: list[list[np.ndarray]] = [[np.empty(0)] for _ in range(5)]
        for _, _, data, offsets in K.chunks(table.column("text")):
            low = K.LOWER[data]
            words, bounds = lower_words(low, offsets)
            known = X._in(words, keys)
            each = np.full(len(words), unknown)
            each[known] = logs[np.searchsorted(keys, words[known])]
            cells, edges = grams(low, offsets)
            out[0].append(np.diff(bounds))
            out[1].append(np.diff(np.concatenate([[0], np.cumsum(known)])[bounds]))
            out[2].append(np.add.reduceat(each, bounds[:-1]) - np.diff(bounds) * math.log10(n + 0.5 * (v + 1)))
            out[3].append(np.add.reduceat(chances.of(cells), edges[:-1]))
            out[4].append(out[3][-1] * -math.log2(10) / np.diff(edges))
        cols = [np.concatenate(c) for c in out]
        return pa.table([table.column("doc_id"), *(pa.array(c.astype(np.int64), pa.int64()) for c in cols[:2]), *(pa.array(c, pa.float64()) for c in cols[2:])], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    return score


def scored(docs: DataFrame) -> DataFrame:
    """Both scores of every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, the code length of the text and its end mark by their number of bytes."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # One number for both sides: a projection's size, and so its parts(), is another than its table's.
    slots = parts(docs)
    words, n, v, tree = train(rows, slots)
    shared = docs.sparkSession.sparkContext.broadcast(tree.near)
    dealt = X.bucketed(rows, X.Slots(slots, 1))
    asked = dealt.groupBy("_bucket").applyInArrow(_ask(slots), ASKED)
    counted = words.select(F.lit(0).alias("kind"), "_slot", "keys", "counts").union(tree.counts.select(F.lit(1).alias("kind"), "_slot", "keys", "counts"))
    replies = asked.groupBy("kind", "_slot").cogroup(counted.groupBy("kind", "_slot")).applyInArrow(_answer(shared), "kind int, _bucket int, keys binary, counts binary")
    found = dealt.groupBy("_bucket").cogroup(replies.groupBy("_bucket")).applyInArrow(_scores(n, v), "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return found.select("doc_id", (~learns(MOD, OUT)).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
