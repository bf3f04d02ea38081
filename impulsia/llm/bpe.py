"""Byte-level BPE encoding and decoding by speculation and verification.

Encoding cuts a text into words, looks each up in a bounded cache of words met before, and encodes the new ones
together: greedy longest match proposes tokens for all of them, a vectorised check tests every adjacent pair of
proposed tokens (and every token by itself), and only words with a failing test are merged step by step. A proposal
whose tokens each encode to themselves and whose neighbours are compatible is what merging gives: no merge could have
crossed a boundary before the tokens beside it were made.

A null text is an empty one: no tokens, which decode to an empty text. Texts of any length are encoded whole. Repeated
rows are encoded each, other columns pass, and an empty table gives an empty one. The strings of special tokens in a
text are encoded as these tokens, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impulsia.llm import kernels as K
from impulsia.llm.common import prepare, resident

#: Words that a worker remembers at most, and how many it keeps when it forgets the rest.
CACHE, CORE = 1 << 19, 1 << 17
#: Pieces of words that it remembers at most.
PIECES = 1 << 18
#: Words of more bytes are merged by way of a heap.
LONG = 256
NEVER = 1 << 60

#: Fixed by the tokenizer: the pattern that cuts texts before merging.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ODD_SPACE = regex.compile(r"[^\S \n]|[\x00-\x02]")

#: Marks in cache keys: no space before, a piece as it stands, a special token.
BARE, EXACT, SPECIAL = "\x00", "\x01", "\x02"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + lengths[0] - 1, then those of the next, and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordCache:
    """Ids by word, in flat arrays. encode: gives all ids of a list of new words, and how many each has."""

    def __init__(self, encode):
        self.encode, self.index = encode, {}
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.used = 0

    def _grow(self, name: str, need: int) -> None:
        have = getattr(self, name)
        if need > len(have):
            setattr(self, name, np.concatenate([have, np.zeros(max(need, 2 * len(have)) - len(have), have.dtype)]))

    def add(self, words: list[str]) -> None:
        flat, lengths = self.encode(words)
        n = len(self.index)
        for name, need in (("flat", self.used + len(flat)), ("starts", n + len(words)), ("lengths", n + len(words))):
            self._grow(name, need)
        self.flat[self.used : self.used + len(flat)] = flat
        self.lengths[n : n + len(words)] = lengths
        self.starts[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def trim(self) -> None:
        if len(self.index) > CACHE:
            self.index = dict(list(self.index.items())[:CORE])
            self.used = int(self.starts[CORE - 1] + self.lengths[CORE - 1])

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each word has."""
        self.trim()
        index = self.index
        if new := list(dict.fromkeys(w for w in words if w not in index)):
            self.add(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[at]
        return self.flat[ranges(self.starts[at], lengths)], lengths


class Merger:
    """Merges of adjacent ids by rank."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int], size: int):
        self.size, self.made = size, made
        self.rank = {p: r for r, p in reversed(list(enumerate(pairs)))}
        self.result = np.array([*made, 0], np.int64)
        # Open addressing: each pair at the first free place from its hash on.
        self.mask = (1 << max(4, (4 * len(self.rank)).bit_length())) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NEVER, np.int64)
        for (a, b), r in self.rank.items():
            key = a * size + b
            at = self._slot(key)
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at] = key, r

    def _slot(self, key):
        return (key ^ (key >> 13) ^ (key >> 27)) & self.mask

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER if it doesn't merge."""
        key = a * self.size + b
        at = self._slot(key)
        out, found = self.ranks[at], self.keys[at]
        todo = np.flatnonzero((found != key) & (found >= 0))
        out[found < 0] = NEVER
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            out[todo] = np.where(found == key[todo], self.ranks[at[todo]], NEVER)
            todo = todo[(found != key[todo]) & (found >= 0)]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """The pair of lowest rank, the leftmost of equals, is merged until none is left."""
        if len(ids) > LONG:
            return self._merge_long(ids)
        ids, get, made = list(ids), self.rank.get, self.made
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs by rank and place, in n log n steps."""
        n, get = len(ids), self.rank.get
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = self.made[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [t for t, on in zip(ids, live, strict=True) if on]

    def merge_flat(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of at least one id in one array, one merge of each word at a time."""
        ids, lengths, of = ids.copy(), lengths.copy(), np.arange(len(lengths))
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.cumsum(lengths) - lengths
        ranks = np.full(len(ids), NEVER, np.int64)
        if len(ids):
            ranks[:-1] = self.ranks_of(ids[:-1], ids[1:])
            ranks[starts + lengths - 1] = NEVER
        while len(of):
            least = np.minimum.reduceat(ranks, starts)
            done = least == NEVER
            if done.any():
                out = np.repeat(done, lengths)
                ended.append((ids[out], lengths[done], of[done]))
                ids, ranks, lengths, of, least = ids[~out], ranks[~out], lengths[~done], of[~done], least[~done]
                starts = np.cumsum(lengths) - lengths
                if not len(of):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, lengths))
            word = np.searchsorted(starts, at, "right") - 1
            at = at[np.concatenate([[True], word[1:] != word[:-1]])]
            ids[at] = self.result[least]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ranks[at] = NEVER
            place = at - np.arange(len(at))
            ids, ranks = ids[keep], ranks[keep]
            lengths = lengths - 1
            starts = np.cumsum(lengths) - lengths
            inner = place[place != starts + lengths - 1]
            ranks[inner] = self.ranks_of(ids[inner], ids[inner + 1])
            left = place[place != starts] - 1
            ranks[left] = self.ranks_of(ids[left], ids[left + 1])
        if not ended:
            return ids, lengths
        flat, many, words = (np.concatenate([e[i] for e in ended]) for i in range(3))
        order = np.argsort(words)
        return flat[ranges((np.cumsum(many) - many)[order], many[order])], many[order]


class Codec:
    """A byte-level BPE tokenizer from its JSON description."""

    def __init__(self, description: str):
        letters = byte_letters()
        spec = json.loads(description)
        vocab = spec["model"]["vocab"]
        to_bytes = {t: bytes(letters[c] for c in t) for t in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = to_bytes[t]
        self.ids = {b: i for i, b in enumerate(self.bytes) if b}
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.singles = np.array(self.single, np.int64)
        self.known: dict[str, list[int]] = {}
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            self.longest[b[:2]] = max(len(b), self.longest.get(b[:2], 1))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        pairs = [(vocab[a], vocab[b]) for a, b in merges]
        made = [vocab[a + b] for a, b in merges]
        self.merger = Merger(pairs, made, size)
        #: Of each token: its halves (itself if it is one byte) and the rank of the merge that makes it.
        self.left, self.right, self.at = np.arange(size), np.arange(size), np.full(size, -1)
        for r in range(len(pairs) - 1, -1, -1):
            i = made[r]
            self.left[i], self.right[i], self.at[i] = *pairs[r], r
        self.size = size
        self.whole = np.full(size, -1, np.int8)
        self.cache = WordCache(self._new)
        joined = b"".join(self.bytes)
        self.table, self.width = np.frombuffer(joined, np.uint8), np.fromiter(map(len, self.bytes), np.int64, size)
        self.begin = np.cumsum(self.width) - self.width
        decimals = [b",%d" % i for i in range(size)]
        self.digits, self.digits_width = np.frombuffer(b"".join(decimals), np.uint8), np.fromiter(map(len, decimals), np.int64, size)
        self.digits_begin = np.cumsum(self.digits_width) - self.digits_width

    def merge(self, word: bytes) -> list[int]:
        return self.merger.merge([self.single[b] for b in word])

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses from a into b: none of a piece that ends a with one that begins b, of a rank at which both stand, before the merges that consume them (at equal ranks, the leftmost pair merges first)."""
        ok = np.ones(len(a), bool)
        x, x_until, live = a.copy(), np.full(len(a), NEVER), np.ones(len(a), bool)
        while live.any():
            y, y_until, on = b.copy(), np.full(len(a), NEVER), live.copy()
            while on.any():
                i = np.flatnonzero(on)
                r = self.merger.ranks_of(x[i], y[i])
                ok[i[(r < x_until[i]) & (r <= y_until[i])]] = False
                on[i] = self.at[y[i]] >= 0
                y_until[i], y[i] = self.at[y[i]], self.left[y[i]]
                on &= ok
            i = np.flatnonzero(live)
            live[i] = (self.at[x[i]] >= 0) & ok[i]
            x_until[i], x[i] = self.at[x[i]], self.right[x[i]]
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: greedy longest match, verified; by merging where it fails."""
        ids, longest, proposed = self.ids, self.longest, []
        for w in words:
            i, n, out = 0, len(w), []
            while i < n:
                j = min(n, i + longest.get(w[i : i + 2], 1))
                while j > i + 1 and w[i:j] not in ids:
                    j -= 1
                out.append(ids[w[i:j]])
                i = j
            proposed.append(out)
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(lengths.sum()))
        word = np.repeat(np.arange(len(words)), lengths)
        for t in np.unique(flat[self.whole[flat] < 0]):
            self.whole[t] = self.merge(self.bytes[t]) == [t]
        bad = np.bincount(word[self.whole[flat] == 0], minlength=len(words)) > 0
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, of = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fails = ~self.compatible(pairs // self.size, pairs % self.size)
        bad |= np.bincount(word[inner[fails[of]]], minlength=len(words)) > 0
        failing = [i for i in np.flatnonzero(bad).tolist() if len(words[i]) <= LONG]
        for i in np.flatnonzero(bad).tolist():
            if len(words[i]) > LONG:
                proposed[i] = self.merge(words[i])
        raw = np.frombuffer(b"".join([words[i] for i in failing]), np.uint8)
        flat, lengths = self.merger.merge_flat(self.singles[raw], np.fromiter((len(words[i]) for i in failing), np.int64, len(failing)))
        flat, ends = flat.tolist(), np.cumsum(lengths).tolist()
        for i, lo, hi in zip(failing, [0, *ends], ends):
            proposed[i] = flat[lo:hi]
        return proposed

    def _new(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > PIECES:
            known.clear()
        new: dict[str, None] = {}
        parts = []
        for k in keys:
            mark = k[:1]
            if mark == SPECIAL:
                parts.append(k)
                continue
            text = k[1:] if mark in (BARE, EXACT) else k if k == "\n" else " " + k
            found = [text] if mark == EXACT else PATTERN.findall(text)
            parts.append(found)
            for p in found:
                if p not in known:
                    new[p] = None
        known.update(zip(new, self.encode_words([p.encode() for p in new]), strict=True))
        made = [[self.special[p[1:]]] if isinstance(p, str) else known[p[0]] if len(p) == 1 else [i for q in p for i in known[q]] for p in parts]
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.int32, int(lengths.sum())), lengths

    def words(self, text: str) -> list[str]:
        """Cache keys whose pieces, in order, are those of the text. Words between single spaces and line ends stand alone: the pattern takes a space only before a word and never crosses one after it."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n" or "<|" in text or ODD_SPACE.search(text):
            out = []
            for i, s in enumerate(self.split.split(text) if self.split else [text]):
                out += [SPECIAL + s] if i % 2 else [EXACT + p for p in PATTERN.findall(s)]
            return out
        return (BARE + text).replace("\n", " \n " + BARE).split(" ")

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin."""
        words, counts = [], [0]
        for t in texts:
            if t:
                words += self.words(t)
            counts.append(len(words))
        ids, lengths = self.cache.ids(words)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[counts]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids; bytes that are no UTF-8 become replacement characters."""
        raw = self.table[ranges(self.begin[ids], self.width[ids])].tobytes()
        at = np.concatenate([[0], np.cumsum(self.width[ids])])[bounds]
        return [raw[lo:hi].decode("utf-8", "replace") for lo, hi in zip(at[:-1], at[1:], strict=True)]

    def decimals(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Runs of ids as decimal numbers joined by commas."""
        raw = self.digits[ranges(self.digits_begin[ids], self.digits_width[ids])].tobytes()
        at = np.concatenate([[0], np.cumsum(self.digits_width[ids])])[bounds]
        return [raw[lo + 1 : hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def codec(description: Broadcast) -> Codec:
    text = description.value
    return resident(("bytes", hash(text)), lambda: Codec(text))


def shared_description(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file at path, a few MB whatever the corpus, for all workers."""
    prepare(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(column: pa.Array):
    for lo, hi, _, _ in K.chunks(column):
        yield column.slice(lo, hi - lo).to_pylist()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of each text. A column of their name is replaced."""
    docs = docs.drop(ids)
    described = shared_description(docs.sparkSession, path)
    schema = docs.select("*", F.array().cast("array<int>").alias(ids)).schema

    def add(batches):
        own = codec(described)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            made = [K.lists(pa.int32(), *own.encode(part)) for part in _texts(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))], names=[*batch.schema.names, ids])

    return docs.mapInArrow(add, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of each list of token ids; a null list gives an empty text. A column of that name is replaced."""
    rows = rows.drop(text)
    described = shared_description(rows.sparkSession, path)
    schema = rows.select("*", F.lit("").alias(text)).schema

    def add(batches):
        own = codec(described)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            made = []
            for lo in range(0, batch.num_rows, 256):
                runs = [np.asarray(x or [], np.int64) for x in column.slice(lo, 256).to_pylist()]
                made += own.decode(np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(add, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id with the number and SHA-256 of each text's ids, and the SHA-256 of what these ids decode to."""
    described = shared_description(docs.sparkSession, path)

    def digest(batches):
        own = codec(described)
        for batch in batches:
            for lo, hi, _, _ in K.chunks(batch.column(1)):
                ids, bounds = own.encode(batch.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in own.decimals(ids, bounds)], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own.decode(ids, bounds)], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
