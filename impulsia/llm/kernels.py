"""Vectorised word and window hashes over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from impulsia.llm.common import CHUNK_BYTES

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = U(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: U, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_BYTES)
        row = np.full(size, base, np.uint64)
        row[0] = 1
        _powers[key] = have = np.multiply.accumulate(row)
    return have


_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole texts of about limit bytes; a null is an empty text, a longer text a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text where its words begin among them (one more at the end)."""
    space = SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    if len(space):
        before[0], after[-1] = True, True
        before[1:], after[:-1] = space[:-1], space[1:]
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = True
        after[offsets[1:][full] - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal wherever the bytes are."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n, "up")[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, n + 1, "down")[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on; the last k - 1 positions have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= U(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)


def starts_of(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one text begin, and the text of each. bounds: from spans()."""
    count = np.maximum(np.diff(bounds) - k + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(len(text)) - np.repeat(first - bounds[:-1], count), text


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """True at each of n positions that a window of k from one of the starts holds."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + k, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, sorted by text and hash, and where each text's begin. A text of 1 to k - 1 words has its whole sequence as the only one."""
    starts, ends, bounds = spans(data, offsets)
    words = span_hash(data, starts, ends)
    at, text = starts_of(bounds, k)
    hashes = windows(words, k)[at]
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([_whole(words[bounds[i] : bounds[i + 1]]) for i in short], np.uint64)
        hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, short])
    if len(short):
        order = np.argsort(text, kind="stable")
        hashes, text = hashes[order], text[order]
    edges = np.searchsorted(text, np.arange(len(offsets)))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        hashes[lo:hi].sort()
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(offsets)))


def _whole(words: np.ndarray) -> int:
    return int(mix(windows(words, len(words)) ^ U(len(words)))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(kind: pa.DataType, values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of values[bounds[i]:bounds[i + 1]], one binary for each i."""
    width = values.dtype.itemsize
    at = pa.py_buffer((np.asarray(bounds, np.int64) * width).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(values))])
