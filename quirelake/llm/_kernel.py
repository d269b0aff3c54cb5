"""Whole Arrow text columns as numpy arrays of word places and 64-bit word names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: The white space of the word rule: 0x20 and 0x09-0x0D. All ASCII, so UTF-8 bytes can be looked at.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z lower-cased, and as they are.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
_STEP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed))


BYTE = _stream(11, 256)
BASE = U(0x9E3779B97F4A7C55)  # odd: it has an inverse modulo 2**64
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if _powers[0].size < n:
        for k, b in enumerate((BASE, BASE_INV)):
            p = np.full(max(n, 1 << 16), b, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def text_slices(col: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and each text's first word (with the total at the end)."""
    n = buf.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(offs.size, np.int64)
    inside = ~WHITE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offs)


def word_names(buf: np.ndarray, start: np.ndarray, end: np.ndarray, case: np.ndarray = SAME) -> np.ndarray:
    """A 64-bit name for each word, the same for equal words everywhere."""
    out = np.empty(start.size, U)
    i = 0
    with np.errstate(over="ignore"):
        while i < start.size:
            j = start.size if end[-1] - start[i] <= _STEP else max(i + 1, int(np.searchsorted(end, start[i] + _STEP, "right")))
            a, b = int(start[i]), int(end[j - 1])
            up, down = powers(b - a + 1)
            sums = np.zeros(b - a + 1, U)
            np.cumsum(BYTE[case[buf[a:b]]] * up[:-1], out=sums[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
            i = j
    return out


def window_names(names: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit name for each k consecutive names."""
    n = names.size - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        if k <= 8:
            for c, i in zip(_stream(5, k) | U(1), range(k), strict=True):
                out += names[i : i + n] * c
        else:
            for a in range(0, n, _STEP):
                part = names[a : min(a + _STEP, n) + k - 1]
                up, down = powers(part.size + 1)
                sums = np.zeros(part.size + 1, U)
                np.cumsum(part * up[:-1], out=sums[1:])
                m = part.size - k + 1
                out[a : a + m] = (sums[k:] - sums[:-k]) * down[:m]
        return mix(out + U(k))


def give_back() -> None:
    """Freed memory goes back to the system: Python workers live on beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function of batches, giving back freed memory when it ends."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return through


def trimmed_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run, a function of a group, giving back freed memory after each."""

    def through(t: pa.Table) -> pa.Table:
        out = run(t)
        give_back()
        return out

    return through


def trimmed_groups(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""

    def through(t: pa.Table, other: pa.Table) -> pa.Table:
        out = run(t, other)
        give_back()
        return out

    return through
