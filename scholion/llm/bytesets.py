"""Vectorised hashing of words, word shingles and byte k-grams over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

np.seterr(over="ignore")  # 64-bit arithmetic wraps on purpose

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers can be inverted modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK)
        for k, b in enumerate((BASE, INVERSE)):
            steps = np.full(m, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their UTF-8 bytes: first row, row after the last, bytes, offsets. Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each span: equal spans have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[stop] - sums[start]) * down[start])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of each word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    solid = ~SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] |= solid[edge]
    ends[edge - 1] |= solid[edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, stop, np.searchsorted(offsets, start, "right") - 1


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sets of hashed word shingles: first row, sorted distinct hashes (int64) of all rows one after another, bounds.

    Letters A-Z are lower-cased. A row with fewer than ``size`` words has all its words as one shingle, a row without
    words none.
    """
    for lo, hi, data, offsets in chunks(column):
        data = LOWER[data]
        start, stop, row = words(data, offsets)
        h = span_hashes(prefix_sums(data), start, stop)
        n = np.bincount(row, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(n)])
        total = h.copy()
        for k in range(1, size):
            total[: max(0, len(h) - k)] += h[k:] * np.uint64(pow(0xD6E8FEB86659FD93, k, 2**64))
        whole = np.arange(len(h)) + size <= first[row + 1]
        vals, rows = mix(total[whole]), row[whole]
        for r in np.flatnonzero((n > 0) & (n < size)):
            part = h[first[r] : first[r + 1]]
            one = np.uint64(len(part))
            for k, x in enumerate(part):
                one = mix(np.array([one + x * np.uint64(2 * k + 5)], np.uint64))[0]
            vals, rows = np.append(vals, one), np.append(rows, r)
        vals = vals.view(np.int64)
        if len(rows) > 1 and (rows[1:] < rows[:-1]).any():
            order = np.argsort(rows, kind="stable")
            vals, rows = vals[order], rows[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=hi - lo))])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            vals[a:b].sort()
        keep = np.ones(len(vals), bool)
        keep[1:] = (vals[1:] != vals[:-1]) | (rows[1:] != rows[:-1])
        vals, rows = vals[keep], rows[keep]
        yield lo, vals, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=hi - lo))])
