"""Vectorised kernels over Arrow text batches: word boundaries, word hashes, shingle sets."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts are worked off in slices of about so many bytes, which bounds memory whatever the batch holds.
SLICE_BYTES = 1 << 19



def release() -> None:
    """Give memory that earlier tasks of this worker freed back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(process):
    """A function over Arrow batches that gives its memory back when its task ends."""

    def run(arrow):
        try:
            yield from process(arrow)
        finally:
            release()

    return run


_powers = {"p": np.ones(1, U64), "i": np.ones(1, U64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n at least."""
    if len(_powers["p"]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("p", _BASE), ("i", inverse)):
            table = np.ones(1, U64)
            step = base
            while len(table) < size:  # doubling: table[k + len] = table[k] * base^len
                table = np.concatenate([table, table * U64(step)])
                step = step * step & (1 << 64) - 1
            _powers[key] = table
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) for runs of rows of about SLICE_BYTES; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, and where each row's words begin (rows + 1 entries)."""
    if len(data) == 0:
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:]
    begin = np.flatnonzero(start)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    end = np.flatnonzero(last) + 1
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((_LOWER[data] if lower else data).astype(U64).__iadd__(U64(1)) * powers[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(U64))
    return hashes, np.searchsorted(begin, offsets)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside rows, and each row's bounds. A shorter non-empty row gives its whole sequence as one."""
    count = np.diff(bounds)
    rows = len(count)
    full = np.maximum(count - n + 1, 0)
    size = full + ((count > 0) & (count < n))
    out_bounds = np.zeros(rows + 1, np.int64)
    np.cumsum(size, out=out_bounds[1:])
    out = np.empty(out_bounds[-1], U64)
    if len(hashes) >= n:
        rolled = np.full(len(hashes) - n + 1, n, U64)
        for k in range(n):
            rolled = rolled * U64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
            rolled ^= rolled >> U64(29)
        owner = np.repeat(np.arange(rows), full)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        out[out_bounds[:-1][owner] + at] = mix(rolled[bounds[:-1][owner] + at])
    for row in np.flatnonzero((count > 0) & (count < n)):
        value = int(count[row])
        for h in hashes[bounds[row] : bounds[row + 1]].tolist():
            value = (value * 0xD6E8FEB86659FD93 + h) & (1 << 64) - 1
            value ^= value >> 29
        out[out_bounds[row]] = mix(np.array([value], U64))[0]
    return out, out_bounds


def unique_per_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and their bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.searchsorted(owner[keep], np.arange(len(bounds)))
