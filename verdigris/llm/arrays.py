"""Word and hash kernels over Arrow string columns, as numpy arrays of UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19
#: Rows looked at together, so that only their bytes are copied.
SLICE_ROWS = 1024

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 offsets of texts in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most limit bytes, or one longer row."""
    for at in range(0, len(column), SLICE_ROWS):
        data, offsets = utf8(column[at : at + SLICE_ROWS])
        row, rows = 0, len(offsets) - 1
        while row < rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            yield at + row, at + end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    both = []
    for base in (BASE, BASE_INVERSE):
        x = np.full(n, base, dtype=np.uint64)
        x[:1] = 1
        both.append(np.multiply.accumulate(x))
    if n <= CHUNK_BYTES + 1:
        _powers = (both[0], both[1])
    return both[0], both[1]


class Hasher:
    """Polynomial hashes of any substring of data, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words: runs of bytes that aren't outside (space and \\t to \\r, if not told)."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~outside[data]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts_here[first] = inside[first]
    starts = np.flatnonzero(starts_here)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | starts_here[1:]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(word_hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words within a row, and their rows."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total = total * np.uint64(0xA0761D6478BD642F) + word_hashes[i : i + n]
    same = rows[:n] == rows[k - 1 :]
    return mix(total[same]), rows[:n][same]
