"""Substring deduplication by difference-cover anchors.

A window is SIZE consecutive words. Words are removed from a document where they lie in a window that also starts in a
document of smaller id. Only anchors are searched corpus-wide: the ANCHOR words from each position that is in COVER
modulo PERIOD. Whatever two positions a window has in two documents, COVER has two members of their difference, so
both share an anchor that is aligned in both within the window. Around the anchors that several documents share,
matches are extended to whole windows, whose hashes are then compared corpus-wide for the smallest id.

A null or empty text has no words, and a text of fewer than SIZE words no window. A null id counts as larger than any
other; rows of equal id don't remove from each other. Windows are judged on the input, not on what is left. Texts of
any length are read whole; other columns pass; an empty table gives an empty one. Without digest a null text becomes
an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsia.llm import exchange as X
from impulsia.llm import kernels as K
from impulsia.llm.common import parts, prepare, resident

SIZE = 13
PERIOD, COVER = 7, (1, 2, 4)
#: The longest anchor that a window holds from each of PERIOD consecutive positions.
ANCHOR = SIZE - PERIOD + 1


class Words:
    """Word hashes of a run of texts with the windows and anchors among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.bounds = K.spans(data, offsets)
        self.words = K.span_hash(data, starts, ends)
        self.count = np.diff(self.bounds)
        #: Windows: where they start among the words, and in which text.
        self.at, self.text = K.starts_of(self.bounds, SIZE)

    def hashes(self) -> np.ndarray:
        return K.windows(self.words, SIZE)[self.at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place among the words and text of each anchor of texts that have a window."""
        at, text = K.starts_of(self.bounds, ANCHOR)
        place = (at - self.bounds[text]) % PERIOD
        keep = np.isin(place, COVER) & (self.count[text] >= SIZE)
        at, text = at[keep], text[keep]
        return K.windows(self.words, ANCHOR)[at], at, text

    def near(self, known: X.Known) -> np.ndarray:
        """Which windows hold a shared anchor."""
        hashes, at, _ = self.anchors()
        flags = np.zeros(len(self.words) + 1, np.int64)
        flags[at[known.has(hashes)] + 1] = 1
        flags = np.cumsum(flags)
        return flags[self.at + PERIOD] > flags[self.at]


def _anchors(slots: X.Slots):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        resident()
        once, many = [], []
        for _, _, data, offsets in K.chunks(table.column("text")):
            hashes, _, text = Words(data, offsets).anchors()
            order = np.argsort(hashes, kind="stable")
            hashes, text = hashes[order], text[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])]) if len(hashes) else np.empty(0, bool)
            a, b = X.once_and_many(hashes[new])
            once.append(a)
            many.append(b)
        a, b = X.once_and_many(np.concatenate([np.empty(0, np.uint64), *once, *many]))
        several = np.union1d(b, np.concatenate([np.empty(0, np.uint64), *many]))
        return X.sent(key[0].as_py(), slots, a[~X._in(a, several)], several)

    return send


def _least(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, with the smallest id of each and whether there are several."""
    order = np.lexsort((doc, hashes))
    hashes, doc = hashes[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    last = np.append(first[1:], len(hashes)) - 1 if len(first) else first
    return hashes[first], doc[first], doc[last] != doc[first]


def _windows(slots: X.Slots):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        resident()
        known, found = X.Known(answers.column("shared").to_pylist()), []
        doc = X.ids(table.column("doc_id")) if table.num_rows else np.empty(0, np.int64)
        if len(known.ordered):
            for lo, _, data, offsets in K.chunks(table.column("text")):
                words = Words(data, offsets)
                near = words.near(known)
                found.append((words.hashes()[near], doc[lo + words.text[near]]))
        hashes, least, several = _least(*(np.concatenate([np.empty(0, t), *(f[i] for f in found)]) for i, t in ((0, np.uint64), (1, np.int64))))
        edges, cols = X.slot_edges(hashes, slots.ranges), [[], [], [], [], []]
        for s in np.flatnonzero(np.diff(edges) > 0):
            lo, hi = edges[s], edges[s + 1]
            for c, v in zip(cols, (int(s), key[0].as_py(), hashes[lo:hi].tobytes(), least[lo:hi].tobytes(), several[lo:hi].tobytes()), strict=True):
                c.append(v)
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["_slot", "_from", "hashes", "least", "several"])

    return send


def _smallest(table: pa.Table) -> pa.Table:
    """Answers each bucket for the windows it sent that lie in several documents: the smallest id that has them."""
    rows = table.select(["_from", "hashes", "least", "several"]).to_pylist()
    own = [(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["least"], np.int64), np.frombuffer(r["several"], bool)) for r in rows]
    hashes, least, several = (np.concatenate([o[i] for o in own]) for i in range(3))
    found, first, differ = _least(hashes, least)
    more = differ.copy()
    more[np.searchsorted(found, hashes[several])] = True
    found, first = found[more], first[more]
    cols: tuple[list, list, list] = ([], [], [])
    for r, (h, _, _) in zip(rows, own, strict=True):
        at = np.searchsorted(found, h)
        hit = X._in(h, found)
        if hit.any():
            for c, v in zip(cols, (r["_from"], h[hit].tobytes(), first[at[hit]].tobytes()), strict=True):
                c.append(v)
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["_bucket", "hashes", "least"])


def _cut(names: list[str], digest: bool):
    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        resident()
        pairs = [(np.frombuffer(h, np.uint64), np.frombuffer(d, np.int64)) for h, d in zip(answers.column("hashes").to_pylist(), answers.column("least").to_pylist(), strict=True)]
        hashes = np.concatenate([np.empty(0, np.uint64), *(p[0] for p in pairs)])
        least = np.concatenate([np.empty(0, np.int64), *(p[1] for p in pairs)])
        order = np.argsort(hashes)
        hashes, least = hashes[order], least[order]
        doc = X.ids(table.column("doc_id")) if table.num_rows else np.empty(0, np.int64)
        n_words, n_removed, out = [], [], []
        for lo, hi, data, offsets in K.chunks(table.column("text")):
            words = Words(data, offsets)
            gone = np.zeros(len(words.words), bool)
            if len(hashes):
                own = words.hashes()
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                dup = (hashes[at] == own) & (least[at] < doc[lo + words.text])
                gone = K.covered(words.at[dup], SIZE, len(gone))
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.bounds])
            raw = data.tobytes()
            for i in range(hi - lo):
                text = raw[offsets[i] : offsets[i + 1]]
                if removed[i] or digest:
                    kept = text.split()
                    if removed[i]:
                        kept = [w for w, g in zip(kept, gone[words.bounds[i] : words.bounds[i + 1]].tolist(), strict=True) if not g]
                    text = b" ".join(kept)
                out.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            n_words.append(words.count)
            n_removed.append(removed)
        counts = [pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64()) for x in (n_words, n_removed)]
        if digest:
            return pa.table([table.column("doc_id"), *counts, pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
        columns = [pa.array(out, pa.string()) if c == "text" else table.column(c) for c in names]
        return pa.table([*columns, *counts], names=[*names, "n_words", "n_removed"])

    return cut


def deduplicated(docs: DataFrame, digest: bool = False) -> DataFrame:
    """docs with n_words and n_removed, and in the text, where words are removed, the kept words joined by a space; with digest, doc_id and the kept words' SHA-256 alone. Columns of the names used are replaced."""
    prepare(docs.sparkSession)
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.select("doc_id", "text") if digest else rows.drop("n_words", "n_removed", X.BUCKET)
    slots = X.slots_for(parts(docs))
    dealt = X.bucketed(rows, slots)
    shared = X.answered(dealt.groupBy("_bucket").applyInArrow(_anchors(slots), X.SENT), slots)
    windows = dealt.groupBy("_bucket").cogroup(shared.groupBy("_bucket")).applyInArrow(_windows(slots), "_slot int, _from int, hashes binary, least binary, several binary")
    smallest = X.exchanged(windows, slots, [("hashes", {"hashes": 8, "least": 8, "several": 1})], _smallest, ["hashes", "least"])
    if digest:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    else:
        schema = rows.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema
    return dealt.groupBy("_bucket").cogroup(smallest.groupBy("_bucket")).applyInArrow(_cut(rows.columns, digest), schema)
