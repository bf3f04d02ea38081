"""Best-fit packing of tokenised documents into sequences of bounded length.

Only the lengths of pieces decide a packing, so the search runs on how many pieces there are of each length: at most
LIMIT numbers, whatever the corpus. Bin completion takes the largest length left, enumerates undominated fillings of
the rest of its sequence (none that a larger free piece could improve in place of some of its pieces), best fit first,
and uses the chosen one as often as the counts allow. Depth-first search keeps the best packing found as incumbent and
prunes a branch whose waste exceeds what a better packing could afford; it ends at the lower bound or after NODES
steps, with the incumbent. These bounds are on the search, never on pieces: every piece is packed, and a sequence is
filled until no piece left fits. Pieces then take their places by their rank among the pieces of their length, which is
counted per input partition, so no task sees more than its share.

A null or empty text is one piece, the end token alone. Repeated rows are packed each; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impulsia.llm import kernels as K
from impulsia.llm.bpe import Merger, WordCache, byte_letters, ranges, shared_description
from impulsia.llm.common import resident, written

LIMIT = 2048
#: Steps of the search beyond its first descent, and fillings tried at a step.
NODES, WIDTH = 1500, 4
#: Pieces of a filling that are searched one by one; what room these leave takes runs of one length, the largest that fits first.
SINGLY = 64
#: Of one sequence's fillings, the steps that enumerate them and the lengths tried at each depth, at most; what they have found then is ranked.
STEPS, TRIES = 400, 64
#: Dominance is tested for groups of up to so many pieces; of fillings with more than MANY pieces, for up to the second number.
GROUP, MANY = (4, 2), 8
END = 0

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


class WordIds:
    """Ids of whole texts as the tokenizers library gives them.

    White space parts what the pre-tokenizer never joins, so each run of non-space is encoded by itself, once while the
    worker remembers it. Runs of ASCII and the usual Latin letters are cut and merged here, all new ones together; any
    other (and any with an apostrophe or a special token's mark) is given to the library. Both ways give its ids.
    """

    odd = re.compile("[\x1c-\x1f\x85\u180e\u200b]")
    #: ASCII but for apostrophes and the mark of special tokens, and the letters of Latin-1.
    plain = re.compile("[!-&(-;=-{}~\xc0-\xd6\xd8-\xf6\xf8-\xff]{1,200}").fullmatch

    def __init__(self, description: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        spec = json.loads(description)["model"]
        vocab, end = spec["vocab"], spec["end_of_word_suffix"]
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        self.merger = Merger([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges], max(vocab.values()) + 1)
        #: Of each byte of a plain run: 0 a letter's, 1 a digit, 2 other.
        self.kind = np.full(256, 2, np.int8)
        for b in [*range(97, 123), *range(128, 256)]:
            self.kind[b] = 0
        self.kind[48:58] = 1
        self.cache = WordCache(self._new)

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = self.plain
        own = [i for i, w in enumerate(words) if plain(w)]
        rest = sorted({*range(len(words))}.difference(own)) if len(own) < len(words) else []
        raw = [words[i].lower().encode() for i in own]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        kind, first = self.kind[data], np.cumsum(sizes) - sizes
        cut = np.ones(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        cut[first] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        ids = self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        flat, lengths = self.merger.merge_flat(ids, ends - starts)
        counts = np.add.reduceat(lengths, np.searchsorted(starts, first)) if len(own) else np.empty(0, np.int64)
        if not rest:
            return flat, counts
        others = [e.ids for e in self.tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False)]
        more = np.fromiter(map(len, others), np.int64, len(others))
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(others), np.int64, int(more.sum()))])
        order = np.argsort(np.array(own + rest, np.int64))
        counts = np.concatenate([counts, more])
        return flat[ranges((np.cumsum(counts) - counts)[order], counts[order])], counts[order]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words, counts = [], [0]
        for t in texts:
            if t:
                words += [t] if self.odd.search(t) else t.split()
            counts.append(len(words))
        ids, lengths = self.cache.ids(words)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[counts]


def _word_ids(description: Broadcast) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    text = description.value
    return resident(("words", hash(text)), lambda: WordIds(text))


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """The pieces of every document with the partition they were made in and their place among its pieces of their length."""
    described = shared_description(docs.sparkSession, path)

    def cut(batches):
        own, part, seen = _word_ids(described), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            for lo, hi, _, _ in K.chunks(batch.column(1)):
                ids, bounds = own.encode(batch.column(1).slice(lo, hi - lo).to_pylist())
                n = np.diff(bounds) + 1
                many = -(-n // limit)
                doc = np.repeat(np.arange(hi - lo), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * limit
                length = np.minimum(limit, n[doc] - start)
                flat = np.insert(ids, bounds[1:], END).astype("<u4")
                at = (bounds[:-1] + np.arange(hi - lo))[doc] + start
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(at, at + length, strict=True)]
                order = np.argsort(length, kind="stable")
                place = np.empty(len(doc), np.int64)
                place[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order])
                place += seen[length]
                seen += np.bincount(length, minlength=limit + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(doc))]
                    + [pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (np.full(len(doc), part), pa.int32()), (place, pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def lower_bound(counts: dict[int, int], limit: int) -> int:
    """No packing has fewer sequences: for each a, pieces over limit - a stand alone, those over half too, and the rest of at least a fill what these leave."""
    have = np.zeros(limit + 2, np.int64)
    for length, n in counts.items():
        have[length] = n
    number, size = np.cumsum(have), np.cumsum(have * np.arange(limit + 2))
    half, best = limit // 2, -(-int(size[limit]) // limit)
    for a in range(half + 1):
        big, mid = number[limit] - number[limit - a], number[limit - a] - number[half]
        free = mid * limit - (size[limit - a] - size[half])
        small = size[half] - (size[a - 1] if a else 0)
        best = max(best, int(big + mid + max(0, -(-int(small - free) // limit))))
    return best


def _dominated(filling: tuple[int, ...], slack: int, lengths: list[int]) -> bool:
    """Whether a free length could stand in for some of the filling's pieces and waste less or leave smaller ones."""
    times = Counter(filling)
    for k in range(1, min(len(filling), GROUP[len(filling) > MANY]) + 1):
        for some in set(combinations([x for x, n in times.items() for _ in range(min(n, k))], k)):
            s = sum(some)
            i = bisect_right(lengths, s) if k == 1 else bisect_left(lengths, s)
            if i < len(lengths) and lengths[i] <= s + slack:
                return True
    return False


def fillings(room: int, counts: dict[int, int], lengths: list[int], width: int = WIDTH) -> list[tuple[int, ...]]:
    """Up to width undominated fillings of room from the counted lengths (sorted), least waste first."""
    if not lengths or lengths[0] > room:
        return [()]
    if counts.get(room):
        return [(room,)]
    found: dict[tuple[int, ...], int] = {}
    steps = perfect = 0

    def fill(left: int, taken: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        used, i = Counter(taken), bisect_right(lengths, left)
        while i:
            x = lengths[i - 1]
            k = min(counts[x] - used[x], left // x)
            used[x] += k
            left -= k * x
            i = min(i - 1, bisect_right(lengths, left))
        return tuple(sorted(used.elements(), reverse=True)), left

    def descend(left: int, below: int, taken: tuple[int, ...]) -> None:
        nonlocal steps, perfect
        if len(taken) >= SINGLY:
            taken, left = fill(left, taken)
        i = bisect_right(lengths, min(left, below))
        if not i or len(taken) >= SINGLY:
            perfect += not left and taken not in found
            found.setdefault(taken, left)
            return
        # The piece that fits exactly, then pairs that do, then the largest.
        tried = 0
        for j in range(i - 1, -1, -1):
            x = lengths[j]
            if counts[x] <= taken.count(x):
                continue
            rest = left - x
            if rest and rest <= x and counts.get(rest, 0) > taken.count(rest) + (rest == x):
                perfect += (*taken, x, rest) not in found
                found[(*taken, x, rest)] = 0
            elif tried < 2 or not rest:
                descend(rest, x, (*taken, x))
            tried += 1
            steps += 1
            if steps > STEPS or tried > TRIES or perfect >= width:
                break
        if not tried:
            found.setdefault(taken, left)

    descend(room, room, ())
    ranked = sorted(sorted(found.items(), reverse=True), key=lambda f: (f[1], len(f[0])))
    good = [f for f, slack in ranked if not _dominated(f, slack, lengths)] or [f for f, _ in ranked]
    return good[:width] or [()]


def pack_lengths(counts: dict[int, int], limit: int = LIMIT, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with how often each is used, which hold all counted pieces in as few sequences as the search finds."""
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    least, total = lower_bound(counts, limit), sum(x * n for x, n in counts.items())
    best: list[tuple[tuple[int, ...], int]] = []
    fewest = 1 << 60
    used = 0

    def options(have: dict[int, int], lengths: list[int]) -> list[tuple[tuple[int, ...], int]]:
        top = lengths[-1]
        have[top] -= 1
        free = lengths if have[top] else lengths[:-1]
        made = fillings(limit - top, have, free)
        have[top] += 1
        out = []
        for f in made:
            bin_ = (top, *f)
            out.append((bin_, min(have[x] // k for x, k in Counter(bin_).items())))
        return out

    def take(have: dict[int, int], lengths: list[int], bin_: tuple[int, ...], times: int, sign: int) -> None:
        for x, k in Counter(bin_).items():
            before = have.get(x, 0)
            have[x] = before - sign * times * k
            if sign > 0 and not have[x]:
                del lengths[bisect_left(lengths, x)]
            elif sign < 0 and not before:
                lengths.insert(bisect_left(lengths, x), x)

    have, lengths = dict(counts), sorted(counts)
    stack: list[list] = [[options(have, lengths), 0, None]]
    bins, waste = 0, 0
    while stack:
        top = stack[-1]
        if top[2]:  # undo what this level had chosen
            bin_, times = top[2]
            take(have, lengths, bin_, times, -1)
            bins, waste, top[2] = bins - times, waste - times * (limit - sum(bin_)), None
        if top[1] >= len(top[0]) or used > nodes and best or fewest <= least:
            stack.pop()
            continue
        bin_, times = top[0][top[1]]
        top[1] += 1
        spare = waste + times * (limit - sum(bin_))
        if best and spare > (fewest - 1) * limit - total:
            continue
        used += bool(best)
        take(have, lengths, bin_, times, 1)
        bins, waste, top[2] = bins + times, spare, (bin_, times)
        if not lengths:
            if bins < fewest:
                fewest, best = bins, [level[2] for level in stack]
        else:
            stack.append([options(have, lengths), 0, None])
    return best


def places(packing: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length a sequence, offset), sorted: where pieces go by their rank. At most the square root of twice the limit rows a filling, and one filling uses up a length."""
    rows, used, first = [], {}, 0
    for bin_, times in packing:
        offset = 0
        for x in sorted(set(bin_), reverse=True):
            k = bin_.count(x)
            rows.append((x, used.get(x, 0), first, k, offset))
            used[x] = used.get(x, 0) + times * k
            offset += x * k
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cut = written(pieces(docs, path, limit), "pieces")
    return packed(cut, limit)


def packed(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    each = cut.groupBy("part", "length").count()
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    spots = cut.sparkSession.sparkContext.broadcast(places(pack_lengths(counts, limit)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.join(each.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("place")).alias("rank"))

    def put(batches):
        rows = spots.value
        keys = (rows[:, 0] << 48) | rows[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            row = rows[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            turn = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + turn // row[:, 3], pa.int64()), pa.array(row[:, 4] + turn % row[:, 3] * length, pa.int64())],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
