"""Numpy kernels over the UTF-8 bytes of Arrow text columns.

Words are runs of bytes outside ``\\x20\\x09-\\x0D``. Those are ASCII, so splitting bytes and
splitting code points agree. Blocks of about a megabyte keep memory flat however large a batch is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GAP = np.zeros(256, bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte, from a fixed seed.
BYTE_KEY = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Multipliers of the words of a window, by position.
WINDOW_KEY = np.random.default_rng(97).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit of ``x`` over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(texts: pa.Array, limit: int = 1 << 20):
    """Yields (first row, row after the last, bytes, offsets) for blocks of whole rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, where, what = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def find_words(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = GAP):
    """Byte starts and ends of the words, and for each row the index of its first word (one entry more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = gaps[data]
    word = ~gap
    start, end = word.copy(), word.copy()
    start[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    full = offs[1:] > offs[:-1]
    p, q = offs[:-1][full], offs[1:][full] - 1
    start[p], end[q] = word[p], word[q]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n, and their inverses; kept for the next block."""
    if len(_POWERS[0]) <= n:
        for k, x in enumerate((BASE, BASE_INV)):
            _POWERS[k] = np.full(n + 1 + (n >> 2), x, np.uint64)
            _POWERS[k][0] = 1
            np.cumprod(_POWERS[k], out=_POWERS[k])
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, whatever their place."""
    n = len(data)
    power, back = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_KEY[data] * power[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def hash_windows(words: np.ndarray, at: np.ndarray, size: int):
    """Hashes of the windows of ``size`` words that stay in a row: (hash, row, index of the first word)."""
    n = len(words) - size + 1
    counts = np.diff(at)
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
    if not len(row):
        return np.zeros(0, np.uint64), row, np.zeros(0, np.int64)
    full = counts >= size
    begin = np.repeat(at[:-1][full], (counts - size + 1)[full])
    n_each = (counts - size + 1)[full]
    within = np.arange(len(row)) - np.repeat(np.cumsum(n_each) - n_each, n_each)
    first = begin + within
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += words[j : j + n] * WINDOW_KEY[j]
    return mix64(total[first] + np.uint64(size)), row, first


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = 5):
    """For each row the sorted distinct hashes of its shingles; a shorter row has its whole word sequence as one."""
    lower = LOWER[data]
    starts, ends, at = find_words(lower, offs)
    words = hash_spans(lower, starts, ends)
    hashes, row, _ = hash_windows(words, at, size)
    cut = np.searchsorted(row, np.arange(len(offs)))
    counts = np.diff(at)
    for i, n in enumerate(counts):
        if n >= size:
            yield np.unique(hashes[cut[i] : cut[i + 1]])
        elif n:
            w = words[at[i] : at[i + 1]]
            yield mix64((w * WINDOW_KEY[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def digest128(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """A list<int64> column of the given arrays."""
    offs = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offs[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))


#: Gaps of normalised words: white space and the punctuation that stands between words.
SOFT_GAP = GAP.copy()
SOFT_GAP[[ord(c) for c in ".,;:!?\"()[]{}"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def sentence_numbers(data: np.ndarray) -> np.ndarray:
    """For each byte the number of sentence and line ends before it; a stop ends a sentence if white space or nothing follows."""
    ends = data == 10
    stop = _STOP[data]
    stop[:-1] &= GAP[data[1:]]
    return np.cumsum(ends | stop) - (ends | stop)


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte offset the number of code points that start before it (one entry more at the end)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def hash_runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of each run of word hashes, whatever its place."""
    n = len(words)
    power, back = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=total[1:])
    return mix64((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))
