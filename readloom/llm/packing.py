"""Pack tokenised documents into sequences of fixed capacity by patterns of few documents.

Lengths are counted in a histogram of at most ``capacity`` entries. Patterns of up to
four length classes that fill a sequence are enumerated, and repeat counts fitted to
the class counts by non-negative least squares (active set, so few patterns are in
use). Counts are rounded down, and patterns filled with lengths that sum to the
capacity exactly; what is left over is packed best fit, longest first. The plan is a list
of (lengths, times) whose size depends on the capacity and not on the number of
documents; each piece finds its place in it by its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .kernels import tidy
from .tokens import ChunkEncoder, batches, encoder

CLASSES = 64
MOST_PER_PATTERN = 4
#: Entries of the tokenizer's cache in a task, after which it starts anew; 33 MB of text have 366,000 distinct chunks here.
CACHE_ENTRIES = 400_000

_PIECES = "pid int, doc_id long, piece int, start long, length long, ids_crc32 long, place long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def class_patterns(classes: int = CLASSES, most: int = MOST_PER_PATTERN) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``most`` classes (from 1) that sum to ``classes``."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
            return
        room = most - len(head)
        for c in range(min(left, head[-1] if head else left), 0, -1):
            if c * room >= left:
                extend((*head, c), left - c)

    extend((), classes)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Minimise |a x - b| over x >= 0 by the active-set method; no more columns than rows are in use at the end."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[used] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance or used.sum() >= a.shape[0]:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            fit = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[at] = fit
                break
            low = fit <= 0
            step = float(np.min(x[at][low] / np.maximum(x[at][low] - fit[low], 1e-300)))
            x[at] += step * (fit - x[at])
            gone = at[(x[at] <= tolerance) & low]
            x[gone], used[gone] = 0, False
            if not len(gone):
                used[at[low]] = False
                x[at[low]] = 0
    return x


def plan_packing(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of the sequences for so many pieces of each length (index 1 to capacity)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    width = -(-capacity // CLASSES)
    of = (np.arange(capacity + 1) + width - 1) // width
    counts = np.bincount(of, left, CLASSES + 1)[1:].astype(float)
    patterns = class_patterns()
    matrix = np.zeros((CLASSES, len(patterns)))
    for j, p in enumerate(patterns):
        for c in p:
            matrix[c - 1, j] += 1
    repeats = np.floor(nonnegative_least_squares(matrix, counts) + 1e-6).astype(np.int64)
    planned: list[tuple[tuple[int, ...], int]] = []
    for j in np.flatnonzero(repeats):
        times = int(repeats[j])
        while times > 0 and (chosen := _exact_instance(left, patterns[j], width, capacity)):
            need = {length: chosen.count(length) for length in chosen}
            many = min([times, *(int(left[length]) // n for length, n in need.items())])
            for length, n in need.items():
                left[length] -= n * many
            planned.append((chosen, many))
            times -= many
    return best_fit(left, capacity, planned)


def _exact_instance(left: np.ndarray, pattern: tuple[int, ...], width: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths that are there, one from each class of the pattern, that fill a sequence to the last place; the last may be of a higher class, as lengths below their class's end leave room."""
    chosen: list[int] = []
    spare = left.copy()
    room = capacity
    for c in pattern[:-2]:
        fits = np.flatnonzero(spare[(c - 1) * width + 1 : c * width + 1])
        if not len(fits):
            return None
        length = int(fits[-1]) + (c - 1) * width + 1
        chosen.append(length)
        spare[length] -= 1
        room -= length
    if len(pattern) == 1:
        return (room,) if spare[room] > 0 else None
    low, least = (pattern[-2] - 1) * width + 1, (pattern[-1] - 1) * width + 1
    first = np.arange(low, min(pattern[-2] * width, room - least) + 1)
    if not len(first):
        return None
    second = room - first
    both = np.minimum(spare[first], spare[second])
    both[first == second] //= 2
    best = int(np.argmax(both))
    return (*chosen, int(first[best]), int(second[best])) if both[best] > 0 else None


def best_fit(left: np.ndarray, capacity: int, planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Add pieces, longest first, where they leave the smallest gap; whole runs of equal pieces and equal sequences at a time."""
    open_: dict[int, list[list]] = defaultdict(list)
    gaps = np.zeros(capacity + 1, np.int64)

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        open_[gap].append([lengths, times])
        gaps[gap] += times

    for lengths, times in planned:
        put(lengths, times)
    for length in range(capacity, 0, -1):
        rest = int(left[length])
        while rest > 0:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = int(fits[0]) + length
                top = open_[gap][-1]
                many = min(rest, top[1])
                top[1] -= many
                gaps[gap] -= many
                if not top[1]:
                    open_[gap].pop()
                put((*top[0], length), many)
                rest -= many
            else:
                each = capacity // length
                if full := rest // each:
                    put((length,) * each, full)
                if rest % each:
                    put((length,) * (rest % each), 1)
                rest = 0
    return [(lengths, times) for group in open_.values() for lengths, times in group if times]


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For searchsorted: keys (length * 2^44 + first rank), the sequence id at that rank, and the offset in the sequence."""
    used = np.zeros(capacity + 1, np.int64)
    found, base = [], 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            found.append(((length << 44) + int(used[length]), base, offset))
            used[length] += times
            offset += length
        base += times
    found.sort()
    table = np.array(found, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _cutter(tokenizer: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = encoder(tokenizer)
        try:
            yield from pieces(chunks, arrow)
        finally:
            # tasks go to all idle workers in turn, and each would keep a cache that later stages have no room for
            chunks.forget()

    def pieces(chunks: ChunkEncoder, arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in arrow:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            for a, b in batches(texts):
                out: list[tuple] = []
                for doc_id, ids in zip(doc_ids[a:b], chunks.encode(texts[a:b], CACHE_ENTRIES), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        length = len(part) // 4
                        out.append((pid, doc_id, piece, at // 4, length, zlib.crc32(part), int(seen[length])))
                        seen[length] += 1
                columns = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["pid", "doc_id", "piece", "start", "length", "ids_crc32", "place"])

    return cut


def _placer(keys: np.ndarray, bases: np.ndarray, offsets: np.ndarray):
    def place(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            length = batch.column("length").to_numpy()
            rank = batch.column("place").to_numpy() + batch.column("ahead").to_numpy()
            key = (length << 44) + rank
            at = np.searchsorted(keys, key, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(bases[at] + key - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``end_id``; only those longer than ``capacity``
    are cut, into pieces of ``capacity`` and a rest. A null or empty text is the
    end id alone. Repeated rows and null doc_ids are separate documents; an empty
    table gives no rows; columns other than doc_id and text are not read. The
    driver gets the histogram of lengths, ``capacity`` numbers at most.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.table(rows.mapInArrow(tidy(_cutter(tokenizer, capacity, end_id)), _PIECES), "pieces")
    counts = scratch.table(pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    keys, bases, offsets = slots(plan_packing(histogram, capacity), capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select("pid", "length", F.coalesce(before, F.lit(0)).alias("ahead"))
    return pieces.join(ahead, ["pid", "length"]).mapInArrow(_placer(keys, bases, offsets), _PACKED)
