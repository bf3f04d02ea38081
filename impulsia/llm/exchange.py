"""Exchanges of hashes between groups of documents.

Documents are dealt once into buckets by a hash of the row and its place (so that a row repeated very often has many
buckets); every step that reads them again reuses that shuffle. A step sends hashes from its bucket to slots by hash
range, packed into one binary a bucket and slot; a slot finds what several documents have and answers each bucket. Each
bucket sends a hash once, however many of its documents have it, so that a passage or copy that a third of all
documents has weighs at most one entry a bucket in its slot.

There are as many slots as buckets, n, so that either stays small; rows from each to each would be their square. Beyond
DIRECT of them, rows travel by way of relays, one a square-root-th of the slots and of the buckets: a bucket sends a row
for each range of slots, a relay cuts these rows and joins those of its buckets, so that n ** 1.5 rows go either way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsia.llm.common import place, stored

#: Bytes of a hash, the highest, that the search for shared ones sends; what it finds is verified with whole hashes.
SHORT = 6
#: Slots to which buckets send without relays.
DIRECT = 2048
#: The column of a document's bucket; one of this name is replaced.
BUCKET = "_bucket"


class Slots(NamedTuple):
    """How many slots and buckets there are; and how many slots make a range, and buckets a relay (1: no relays)."""

    n: int
    width: int

    @property
    def ranges(self) -> int:
        """To how many ranges of slots a bucket sends."""
        return self.n // self.width


def slots_for(n: int, direct: int = DIRECT) -> Slots:
    """About n of them: beyond direct a square, so that ranges of slots are even."""
    if n <= direct:
        return Slots(n, 1)
    width = math.isqrt(n - 1) + 1
    return Slots(width * width, width)


def bucketed(docs: DataFrame, slots: Slots) -> DataFrame:
    return stored(docs).withColumn(BUCKET, F.pmod(F.xxhash64("doc_id", "text", place()), F.lit(slots.n)).cast("int"))


def ids(column: pa.Array) -> np.ndarray:
    """doc_ids; a null one counts as larger than any."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def narrow(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - SHORT :]).tobytes()


def widen(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SHORT, 8), np.uint8)
    out[:, 8 - SHORT :] = np.frombuffer(raw, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").reshape(-1)


def slot_edges(ordered: np.ndarray, slots: int) -> np.ndarray:
    """Where each slot's part of ascending hashes begins; slots are even ranges of the hashes' upper half."""
    slot = ((ordered >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
    return np.searchsorted(slot, np.arange(slots + 1, dtype=np.uint64))


def sent(bucket: int, slots: Slots, once: np.ndarray, many: np.ndarray) -> pa.Table:
    """Rows for every range of slots with the distinct hashes that one document of the bucket has, and those that several have."""
    cols: list[list] = [[], [], [], []]
    once, many = np.sort(once), np.sort(many)
    a, b = slot_edges(once, slots.ranges), slot_edges(many, slots.ranges)
    for s in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)):
        for c, v in zip(cols, (int(s), bucket, narrow(once[a[s] : a[s + 1]]), narrow(many[b[s] : b[s + 1]])), strict=True):
            c.append(v)
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["_slot", "_from", "once", "many"])


SENT = "_slot int, _from int, once binary, many binary"


def once_and_many(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that occur once, and the distinct ones that occur more often."""
    found, times = np.unique(hashes, return_counts=True)
    return found[times == 1], found[times > 1]


def _shared(table: pa.Table) -> pa.Table:
    own = [(f, widen(a), widen(b)) for f, a, b in zip(*(table.column(c).to_pylist() for c in ("_from", "once", "many")), strict=True)]
    everything = np.concatenate([x for _, a, b in own for x in (a, b, b)])
    found, times = np.unique(everything, return_counts=True)
    found = found[times > 1]
    cols: tuple[list, list] = ([], [])
    for f, a, b in own:
        mine = np.concatenate([b, a[_in(a, found)]])
        if len(mine):
            cols[0].append(f)
            cols[1].append(narrow(mine))
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=[BUCKET, "shared"])


def _in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def answered(sends: DataFrame, slots: Slots) -> DataFrame:
    """For each bucket, the hashes it sent that several documents have, anywhere."""
    return exchanged(sends, slots, [("once", {"once": SHORT}), ("many", {"many": SHORT})], _shared, ["shared"])


def exchanged(sends: DataFrame, slots: Slots, columns: list[tuple[str, dict[str, int]]], answer: Callable[[pa.Table], pa.Table], told: list[str]) -> DataFrame:
    """The answers (_bucket, told: binaries that may come in parts) of each slot to what it is sent. sends: _slot, _from and columns, of which each hash column comes with the widths of those that are cut with it."""
    reply = ", ".join(["_bucket int", *(f"{c} binary" for c in told)])
    w = slots.width
    if w == 1:
        return sends.groupBy("_slot").applyInArrow(answer, reply)
    names = [c for _, widths in columns for c in widths]
    packed = ", ".join(["_slot int", "_relay int", "_from array<int>", *(f"{c} array<binary>" for c in names)])
    relays = sends.withColumn("_relay", F.floor(F.col("_from") / F.lit(w)).cast("int"))
    there = relays.groupBy("_slot", "_relay").applyInArrow(_cut(slots, columns), packed)
    back = ", ".join(["_relay int", "_range int", "_bucket array<int>", *(f"{c} array<binary>" for c in told)])
    replies = there.groupBy("_slot").applyInArrow(_answering(answer, names, told, w), back)
    return replies.groupBy("_relay", "_range").applyInArrow(_joined(told), reply)


def _nested(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _cut(slots: Slots, columns: list[tuple[str, dict[str, int]]]):
    """A relay's work: a row for each slot of its range with what each of its buckets sends there."""
    names, w = [c for _, widths in columns for c in widths], slots.width

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, relay = key[0].as_py(), key[1].as_py()
        found: dict[int, list[list]] = {}
        for row in table.select(["_from", *names]).to_pylist():
            parts: dict[int, dict[str, bytes]] = {}
            for hashes, widths in columns:
                raw = row[hashes]
                ordered = widen(raw) if widths[hashes] == SHORT else np.frombuffer(raw, np.uint64)
                edges = slot_edges(ordered, slots.n)[at * w : (at + 1) * w + 1]
                for s in np.flatnonzero(np.diff(edges) > 0):
                    for c, size in widths.items():
                        parts.setdefault(int(s), {})[c] = row[c][edges[s] * size : edges[s + 1] * size]
            for s, own in parts.items():
                slot = found.setdefault(at * w + s, [[] for _ in range(len(names) + 1)])
                slot[0].append(row["_from"])
                for into, c in zip(slot[1:], names, strict=True):
                    into.append(own.get(c, b""))
        rows = sorted(found.items())
        arrays = [pa.array([s for s, _ in rows], pa.int32()), pa.array([relay] * len(rows), pa.int32()), _nested([r[0] for _, r in rows], pa.int32())]
        return pa.table([*arrays, *(_nested([r[i + 1] for _, r in rows], pa.binary()) for i in range(len(names)))], names=["_slot", "_relay", "_from", *names])

    return cut


def _answering(answer, names: list[str], told: list[str], w: int):
    def reply(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        flat = pa.table({c: table.column(c).combine_chunks().flatten() for c in ["_from", *names]})
        made = answer(flat)
        found: dict[int, list[list]] = {}
        for bucket, *blobs in zip(*(made.column(c).to_pylist() for c in [BUCKET, *told]), strict=True):
            relay = found.setdefault(bucket // w, [[] for _ in range(len(told) + 1)])
            for into, v in zip(relay, (bucket, *blobs), strict=True):
                into.append(v)
        rows = sorted(found.items())
        arrays = [pa.array([r for r, _ in rows], pa.int32()), pa.array([key[0].as_py() // w] * len(rows), pa.int32()), _nested([r[0] for _, r in rows], pa.int32())]
        return pa.table([*arrays, *(_nested([r[i + 1] for _, r in rows], pa.binary()) for i in range(len(told)))], names=["_relay", "_range", BUCKET, *told])

    return reply


def _joined(told: list[str]):
    """What a relay's slots answer, a row for each of its buckets."""

    def join(table: pa.Table) -> pa.Table:
        flat = {c: table.column(c).combine_chunks().flatten().to_pylist() for c in [BUCKET, *told]}
        found: dict[int, list[list[bytes]]] = {}
        for bucket, *blobs in zip(*flat.values(), strict=True):
            for into, v in zip(found.setdefault(bucket, [[] for _ in told]), blobs, strict=True):
                into.append(v)
        rows = sorted(found.items())
        return pa.table([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([b"".join(r[i]) for _, r in rows], pa.binary()) for i in range(len(told)))], names=[BUCKET, *told])

    return join


#: The bytes of a hash that narrow() leaves.
_KEPT = np.uint64(((1 << 8 * SHORT) - 1) << (64 - 8 * SHORT))


class Known:
    """The shared hashes of a bucket's answer."""

    def __init__(self, answers: Iterable[bytes]):
        self.ordered = np.sort(np.concatenate([np.empty(0, np.uint64), *map(widen, answers)]))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return _in(hashes & _KEPT, self.ordered)
