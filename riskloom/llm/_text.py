"""Vectorized work on the UTF-8 bytes of Arrow string columns: slices, words, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is a slice of its own.
SLICE = 1 << 18
_RNG = np.random.default_rng(20240601)
_TABLES = [_RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' n + 1 offsets in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return b, off - off[0]


def slices(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, of one row at least."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def ids_of(column) -> np.ndarray:
    """An integer column as int64; null becomes the smallest long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.int64())
    if column.null_count:
        column = column.fill_null(-(2**63))
    return column.to_numpy(zero_copy_only=False)


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 up to n, and of its inverse."""
    have = _POWERS.get(which)
    if have is None or have[0] < n:
        size = max(n, SLICE + 1024) + 1

        def run(base: int) -> np.ndarray:
            a = np.full(size, np.uint64(base))
            a[0] = 1
            return np.cumprod(a, dtype=np.uint64)

        have = (size - 1, run(_BASES[which]), run(pow(_BASES[which], -1, 2**64)))
        if n <= 2 * SLICE:  # those of long texts aren't kept, workers live on
            _POWERS[which] = have
    return have[1], have[2]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class Hashes:
    """Polynomial hashes of any substring of b, from prefix sums modulo 2**64."""

    def __init__(self, b: np.ndarray, which: int = 0):
        n = len(b)
        self.p, self.inv = powers(which, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES[which][b] * self.p[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])

    def all(self, k: int) -> np.ndarray:
        """Of each k bytes in a row."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.inv[: len(self.sums) - k])


def word_spans(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t-\\r]+ of each row, and each row's first word number (n + 1 of them)."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~_SEP[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    before = np.empty(len(b), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(b), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def shingle_hashes(b: np.ndarray, off: np.ndarray, size: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its runs of `size` words; a shorter row is one run; no words: none."""
    if lower:
        b = _FOLD[b]
    starts, ends, first = word_spans(b, off)
    h = Hashes(b).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    coef = [mix(np.array([i + 1], np.uint64) * np.uint64(_BASES[1]))[0] | np.uint64(1) for i in range(size)]
    runs = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i, c in enumerate(coef):
        runs += h[i : i + len(runs)] * c
    runs = mix(runs)
    for r in range(len(off) - 1):
        f, t = first[r], first[r + 1]
        if t - f >= size:
            yield np.unique(runs[f : t - size + 1])
        elif t > f:
            yield mix((h[f:t] * np.array(coef[: t - f], np.uint64)).sum(dtype=np.uint64).reshape(1) + np.uint64(t - f))
        else:
            yield np.zeros(0, np.uint64)
