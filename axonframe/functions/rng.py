"""Reproducible draws: a hash of a seed and keys in place of a generator's state, so that a row's draw depends on nothing but the row."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def uniform(seed: str, *keys) -> Column:
    """A number in [0, 1)."""
    text = F.concat_ws("|", F.lit(seed), *[F.lit(k).cast("string") if not isinstance(k, (Column, str)) else (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def below(p: float, text: Column) -> Column:
    """Whether the draw of ``text``, which is ``uniform``'s seed and keys joined by ``|``, is less than ``p``; the hash's digits are compared as they are."""
    limit = math.ceil(p * 2**32)
    if not 0 < limit < 2**32:
        return F.lit(limit > 0)
    return F.substring(F.md5(text.cast("binary")), 1, 8) < F.lit(f"{limit:08x}")


def gauss(seed: str, *keys) -> Column:
    """A standard normal number, by the Box-Muller method from two hashes."""
    radius = F.sqrt(-2.0 * F.log(F.lit(1.0) - uniform(seed + "r", *keys)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed + "a", *keys))


_ADDED = [np.uint32(int(2**32 * abs(math.sin(i + 1)))) for i in range(64)]
_TURNED = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
#: Texts that are hashed at once, so that what is at hand stays near.
_AT_ONCE = 1 << 13


def _first_words(w: np.ndarray) -> np.ndarray:
    """The first word of the MD5 of each text, from its block's 16 words as rows of ``w``."""
    n = w.shape[1]
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(61):  # the last three steps don't touch the first word
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _ADDED[i]
        f += w[g]
        turned = f << np.uint32(_TURNED[i])
        f >>= np.uint32(32 - _TURNED[i])
        turned |= f
        turned += b
        a, b, c, d = d, turned, b, c
    return b + np.uint32(0x67452301)


class Draws:
    """The numbers that ``uniform`` gives for a seed and keys, the last of which is a whole number: ``heads`` are the texts before it, joined by ``|``."""

    def __init__(self, heads: pa.Array):
        heads = heads.cast(pa.binary())
        ends = np.frombuffer(heads.buffers()[1], np.int32)[heads.offset : heads.offset + len(heads) + 1]
        n = np.diff(ends)
        self.texts = heads.to_pylist() if len(n) and n.max() > 40 else None  # no room in one block for any number
        if self.texts is None:
            self.n, self.block = n, np.zeros((len(n), 64), np.uint8)
            row = np.repeat(np.arange(len(n)), n)
            self.block[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.frombuffer(heads.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(row) else 0

    def at(self, k: int) -> np.ndarray:
        tail = b"|%d" % k
        if self.texts is not None:
            return np.array([int.from_bytes(hashlib.md5(t + tail).digest()[:4], "big") for t in self.texts]) / 2**32
        rows = np.arange(len(self.n))
        for j, byte in enumerate(tail + b"\x80"):
            self.block[rows, self.n + j] = byte
        self.block[:, 56:58] = (8 * (self.n + len(tail))).astype("<u2").view(np.uint8).reshape(-1, 2)
        words = self.block.view("<u4")
        first = [_first_words(np.ascontiguousarray(words[k : k + _AT_ONCE].T)) for k in range(0, len(words), _AT_ONCE)]
        return np.concatenate(first).byteswap() / 2**32 if first else np.empty(0)

    def keep(self, some: np.ndarray) -> None:
        """Goes on with some of the heads."""
        if self.texts is not None:
            self.texts = [t for t, kept in zip(self.texts, some.tolist()) if kept]
        else:
            self.n, self.block = self.n[some], self.block[some]
