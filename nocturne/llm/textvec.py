"""Vectorised text kernels over whole Arrow string batches.

All kernels work on the UTF-8 buffer of a batch at once, without a Python loop over
rows.  Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; these are ASCII,
so splitting on the byte level is exact for UTF-8.

Hashes: a word is hashed as a polynomial over its bytes modulo 2**64, with random byte
codes, followed by a 64-bit finalizer; a sequence of words is a polynomial over word
hashes, again finalized.  Both come from prefix sums, so any window costs O(1).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95 | 1
_CODES = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64)
_OTHER_BASE, _OTHER_CODES = 0x8EBC6AF09C88C6E3 | 1, np.random.default_rng(0x07E4).integers(1, 2**63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), applied to uint64."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up = np.full(n, base, dtype=np.uint64)
    up[0] = 1
    down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cached powers; the cache grows to the longest batch seen."""
    have = _CACHE.get(base)
    if have is None or len(have[0]) < n:
        have = _CACHE[base] = _powers(base, max(n, 1 << 16))
    return have


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: byte spans [start, end), and first[i] .. first[i+1] the words of row i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Word spans; a word never runs over a row's end."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, other: bool = False):
    """A function of (starts, ends) that gives a uint64 for each byte span, equal for equal bytes; ``other``: of an independent family."""
    up, down = powers(_OTHER_BASE if other else _BYTE_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_OTHER_CODES if other else _CODES)[data] * up[: len(data)], out=total[1:])

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((total[end] - total[start]) * down[start] + length * _U(0x2545F4914F6CDD1D))

    return of


def word_hashes(w: Words, lower: bool = False, other: bool = False) -> np.ndarray:
    """A uint64 for each word, equal for equal bytes."""
    return span_hashes(LOWER[w.data] if lower else w.data, other)(w.start, w.end)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A uint64 for each run of ``size`` words; windows may run over row ends, see window_ok."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_BASE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[size:] - total[: n - size + 1]) * down[: n - size + 1])


def window_ok(first: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Whether a window that starts at each word lies in one row."""
    n = max(0, n_words - size + 1)
    ok = np.ones(n, bool)
    for back in range(1, size):
        at = first[1:-1] - back if len(first) > 2 else first[:0]
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def joined(w: Words, keep: np.ndarray | None = None, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The (kept) words of each row with one space between them.

    Returns (bytes, row offsets, starts, ends), the spans being those of the kept words.
    """
    start, end, rows = w.start, w.end, w.rows()
    if keep is not None:
        start, end, rows = start[keep], end[keep], rows[keep]
    n = len(w.data)
    step = np.zeros(n + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    mask = np.cumsum(step[:n], dtype=np.int8).astype(bool)
    later = np.zeros(len(start), bool)
    later[1:] = rows[1:] == rows[:-1]
    data = LOWER[w.data] if lower else w.data.copy()
    gaps = start[later] - 1
    data[gaps] = 0x20
    mask[gaps] = True
    place = np.zeros(n + 1, np.int64)
    np.cumsum(mask, out=place[1:])
    first = np.searchsorted(rows, np.arange(len(w.first)))
    begin, stop = place[start], place[end]
    size = len(stop)
    offsets = np.zeros(len(w.first), np.int64)
    if size:
        offsets = np.where(first > 0, stop[np.maximum(first, 1) - 1], 0)
    return data[mask], offsets, begin, stop


def pieces(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Slices of a batch with about ``most`` bytes of text each; a longer row is a slice of its own."""
    if not batch.num_rows:
        return
    text = batch.column(column)
    sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(sizes)))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high
