"""Numpy kernels: hashes of words and of windows over many texts at once, and window anchors.

Texts of a batch lie end to end. A polynomial hash modulo 2^64 with a running sum gives the
hash of any range by one subtraction; ranges of equal content have equal hashes wherever they
lie. An anchor of a window is its least fragment by hash order, the leftmost of equals; it
depends on the window's content alone, so equal windows have equal anchors at equal offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Windows of a piece of a long sequence; with a window more it stays below 2^24 places.
_PIECE = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to 2^bits."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full((1 << bits) + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


#: Two independent bases; both odd.
BASES = (0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93)


class Ranges:
    """Hashes of ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]) -> None:
        bits = max(18, int(len(values)).bit_length())
        power, self.inverse = _powers(base, bits)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def sliding(self, width: int) -> np.ndarray:
        """The hash of each range of `width` values, by its start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


@lru_cache(maxsize=2)
def byte_values(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


class Texts:
    """Texts end to end, with a newline after each: bytes, and each text's begin and end."""

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stop = np.cumsum(sizes + 1) - 1
        self.start = self.stop - sizes
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, begin byte, end byte) of each word, and the number of words before each text and after all."""
        data = self.bytes
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        gap = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        hashes = Ranges(byte_values()[data]).of(begin, end)
        return hashes, begin, end, np.concatenate([np.searchsorted(begin, self.start), [len(begin)]])


def batches_of(column: pa.Array, most: int = 256 << 10) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) in runs of about `most` bytes; a null is an empty text."""
    first, got, size = 0, [], 0
    for i, text in enumerate(column.cast(pa.binary()).to_pylist()):
        got.append(text or b"")
        size += len(got[-1])
        if size >= most:
            yield first, got
            first, got, size = i + 1, [], 0
    if got:
        yield first, got


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by the first of them."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(values: Ranges, first: np.ndarray, last: np.ndarray, window: int, fragment: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor) of every window of `window` values inside the texts first[i]..last[i].

    A place takes 24 bits of a key, so longer sequences go in pieces that overlap by a window.
    """
    order = values.sliding(fragment)
    width = window - fragment + 1
    if len(order) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.empty(len(order) - width + 1, np.int64)
    for s in range(0, len(least), _PIECE):
        piece = order[s : s + _PIECE + width - 1]
        keys = piece >> np.uint64(24) << np.uint64(24) | np.arange(len(piece), dtype=np.uint64)
        least[s : s + _PIECE] = (sliding_min(keys, width) & np.uint64((1 << 24) - 1)).astype(np.int64) + s
    inside = np.zeros(len(least) + 1, np.int8)
    fits = last - first >= window
    np.add.at(inside, first[fits], 1)
    np.add.at(inside, last[fits] - window + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]))
    return start, least[start]
