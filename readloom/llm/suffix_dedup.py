"""Exact removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A suffix is indexed where a text has an anchor: the k-byte string with the least
hash among those inside a window. Equal windows have the same anchor at the same
place, so suffixes at anchors find every repeated window, with about one suffix in
half a window less the anchor. Windows are as long as the shorter of two lengths:
strings of ``length`` bytes are removed, those of ``report`` bytes only counted; a
window of ``length`` bytes has the anchor of the shorter one that begins where it
does. Consecutive windows with the same anchor form a run; the entry of a run is the
digest of the anchor, then that of all bytes of the run. A level of the index is a
table of distinct entries sorted by digest, beside one of its heads (the digests of
anchors) and how many entries each has. New batches get a level of their own, and
levels of equal size merge; a merge scans the entries and heads of both for matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups
from .kernels import _BASE, _power_tables, U64, mix, text_slices, tidy

#: Bytes of an anchor.
ANCHOR = 48
#: Longer texts are indexed in overlapping pieces of so many window starts.
PIECE = 1 << 22
#: Runs that a task compares for one anchor; windows of commoner anchors are compared by their own hashes, as rows.
MOST_RUNS = 4096
_POSITION = U64((1 << 24) - 1)

_ENTRIES = "key long, batch int, entry binary, first int, run int, lead int"


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` bytes."""
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers[: len(data)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[: len(data) - size + 1])


def anchors(data: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each window start, the position of the leftmost k bytes with the least hash inside the window."""
    hashes = (_rolling(data, k) & ~_POSITION) | (np.arange(len(data) - k + 1, dtype=U64) & _POSITION)
    width, p = length - k + 1, 1
    while 2 * p <= width:
        hashes = np.minimum(hashes[:-p], hashes[p:])
        p *= 2
    starts = len(data) - length + 1
    low = np.minimum(hashes[:starts], hashes[width - p : width - p + starts])
    return (low & _POSITION).astype(np.int64)


def _runs(data: np.ndarray, offsets: np.ndarray, window: int, k: int, starts: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, first window, last window, anchor) inside the concatenated texts of a slice; windows begin in its first ``starts`` bytes."""
    if len(data) < window:
        return
    at = anchors(data, window, k)[:starts]
    row = np.searchsorted(offsets, np.arange(len(at)), "right") - 1
    valid = np.arange(len(at)) + window <= offsets[row + 1]
    start = valid.copy()
    start[1:] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    end = valid.copy()
    end[:-1] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~valid[1:]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    yield from zip(row[first].tolist(), first.tolist(), last.tolist(), at[first].tolist(), strict=True)


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, start in the row's text, bytes, offsets, window starts); a very long text comes alone, piece by piece, each with the bytes that its last windows reach."""
    for first, data, offsets in text_slices(column):
        if len(data) <= PIECE + length:
            yield first, 0, data, offsets, len(data)
            continue
        for begin in range(0, len(data), PIECE):
            part = data[begin : begin + PIECE + length - 1]
            yield first, begin, part, np.array([0, len(part)]), PIECE


def _indexer(length: int, window: int, k: int):
    def index(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            keys, batches = batch.column("key").to_numpy(), batch.column("batch").to_numpy()
            for first, begin, data, offsets, starts in _pieces(batch.column("text"), length):
                raw = data.tobytes()
                ends = offsets[1:].tolist()
                rows, entry, start, run, lead = [], [], [], [], []
                for row, a, z, m in _runs(data, offsets, window, k, starts):
                    head = xxhash.xxh3_64_digest(raw[m : m + k])
                    # the number of windows is part of the entry: where a text ends, equal bytes may hold fewer
                    entry.append(head + xxhash.xxh3_64_digest(raw[a : min(z + length, ends[row])], (z - a) << 16 | m - a))
                    rows.append(row)
                    start.append(a - int(offsets[row]) + begin)
                    run.append(z - a)
                    lead.append(m - a)
                at = np.array(rows, np.int64) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at]), pa.array(batches[at]), pa.array(entry, pa.binary()), *[pa.array(c, pa.int32()) for c in (start, run, lead)]],
                    ["key", "batch", "entry", "first", "run", "lead"],
                )

    return index


@dataclass
class SuffixIndex:
    """Levels of distinct entries, each twice the size of the next at least: (size, name, entries, heads)."""

    scratch: Scratch
    levels: list[tuple[int, str, DataFrame, DataFrame]] = field(default_factory=list)
    _made: int = 0

    def add(self, entries: DataFrame) -> None:
        """Index a batch: build its array, and merge levels of equal size."""
        place = F.min(F.struct("key", "first", "run", "lead")).alias("place")
        self.levels.append(self._write(entries.groupBy("entry").agg(F.count(F.lit(1)).alias("times"), place), 1))
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            self._merge()

    def merged(self) -> tuple[DataFrame, DataFrame]:
        """All levels as one, and its heads that stand in two entries, with how many (of which some may be counted more than once)."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0][2], self.levels[0][3].where("n > 1")

    def _merge(self) -> None:
        """One level of the last two. Entries and heads are scanned side by side: equal entries are counted together, and a head of both has matches in both."""
        a, b = self.levels.pop(), self.levels.pop()
        both = b[2].unionByName(a[2]).groupBy("entry").agg(F.sum("times").alias("times"), F.min("place").alias("place"))
        heads = b[3].unionByName(a[3]).groupBy("head").agg(F.sum("n").alias("n"))
        self.levels.append(self._write(both, a[0] + b[0], heads))
        for gone in (a, b):
            self.scratch.drop(gone[1])
            self.scratch.drop(f"{gone[1]}-heads")

    def _write(self, df: DataFrame, size: int, heads: DataFrame | None = None) -> tuple[int, str, DataFrame, DataFrame]:
        self._made += 1
        name = f"level-{self._made}"
        level = self.scratch.table(df.sortWithinPartitions("entry"), name)
        heads = level.groupBy(_head()).agg(F.count(F.lit(1)).alias("n")) if heads is None else heads
        return size, name, level, self.scratch.table(heads.sortWithinPartitions("head"), f"{name}-heads")


def _head() -> Column:
    return F.substring("entry", 1, 8).alias("head")


def _fetcher(length: int):
    def fetch(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            texts = batch.column("text").cast(pa.large_binary())
            for i, places in enumerate(batch.column("places").to_pylist()):
                text = texts[i].as_py() or b""
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p["entry"] for p in places], pa.binary()),
                        pa.array([p["lead"] for p in places], pa.int32()),
                        pa.array([p["run"] for p in places], pa.int32()),
                        pa.array([text[p["first"] : p["first"] + p["run"] + length] for p in places], pa.binary()),
                        pa.array([p["common"] for p in places], pa.bool_()),
                    ],
                    ["entry", "lead", "run", "bytes", "common"],
                )

    return fetch


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n[i] places of each i, the i and the place."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _window_keys(batch: list[tuple[bytes, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of runs (entry, lead, run, bytes): a hash of each window and of where its anchor is, the run it is in, and its place there."""
    sizes = np.array([len(row[3]) for row in batch], np.int64)
    n = np.clip(np.minimum(np.array([row[2] for row in batch], np.int64) + 1, sizes - length + 1), 0, None)
    owner, place = _spread(n)
    if not len(owner):
        return np.empty(0, U64), owner, place
    rolled = _rolling(np.frombuffer(b"".join(row[3] for row in batch), np.uint8), length)
    lead = np.array([row[1] for row in batch], np.int64)
    return mix(rolled[(np.cumsum(sizes) - sizes)[owner] + place] + (lead[owner] - place).astype(U64) * U64(_BASE)), owner, place


def _spans(flags: np.ndarray, owner: np.ndarray, place: np.ndarray, runs: int) -> list[bytes]:
    """For each run, (first, last) of its stretches of flagged windows."""
    edge = np.ones(len(flags) + 1, bool)
    edge[1:-1] = owner[1:] != owner[:-1]
    before, after = np.append(False, flags[:-1]), np.append(flags[1:], False)
    start, end = flags & (edge[:-1] | ~before), flags & (edge[1:] | ~after)
    raw = np.stack([place[start], place[end]], axis=1).astype("<i4").tobytes()
    bounds = (8 * np.searchsorted(owner[start], np.arange(runs + 1))).tolist()
    return [raw[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]


def _rows_of(batch: pa.RecordBatch) -> list[tuple[bytes, int, int, bytes]]:
    return list(zip(*[batch.column(c).to_pylist() for c in ("entry", "lead", "run", "bytes")], strict=True))


def _window_rows(lengths: tuple[int, int]):
    def rows(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            runs = _rows_of(batch)
            heads = np.frombuffer(b"".join(r[0][:8] for r in runs), U64)
            for kind, length in enumerate(lengths):
                keys, owner, place = _window_keys(runs, length)
                windows = mix(keys ^ heads[owner] ^ U64(length)).view(np.int64)
                columns = [batch.column("entry").take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(np.full(len(keys), kind, np.int8)), pa.array(windows)]
                yield pa.RecordBatch.from_arrays(columns, ["entry", "spot", "kind", "window"])

    return rows


def _spot_spans(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def spans(spots: list[int] | None) -> bytes:
        flags = np.zeros(max(spots) + 1 if spots else 0, bool)
        flags[spots or []] = True
        return _spans(flags, np.zeros(len(flags), np.int64), np.arange(len(flags)), 1)[0]

    for batch in arrow:
        found = [pa.array([spans(s) for s in batch.column(c).to_pylist()], pa.binary()) for c in ("long", "short")]
        yield pa.RecordBatch.from_arrays([batch.column("entry"), *found], ["entry", "spans", "shared"])


def _common_anchors(variants: DataFrame, lengths: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Spans of repeated windows in runs of very common anchors: windows are counted before the shuffle, and hot ones meet their counts by broadcast."""
    windows = scratch.table(variants.mapInArrow(_window_rows(lengths), "entry binary, spot int, kind byte, window long"), "windows")
    counts = scratch.table(windows.groupBy("window").agg(F.count_distinct("entry").alias("runs"), F.count(F.lit(1)).alias("rows")).where("runs > 1").drop("runs"), "window-counts")
    hits = join_groups(windows, counts, ["window"], "rows", windows.count())
    spots = [F.collect_set(F.when(F.col("kind") == kind, F.col("spot"))).alias(name) for kind, name in enumerate(("long", "short"))]
    return hits.groupBy("entry").agg(*spots).mapInArrow(_spot_spans, "entry binary, spans binary, shared binary")


def _resolver(lengths: tuple[int, int]):
    def settle(runs: list[tuple[bytes, int, int, bytes]]) -> pa.RecordBatch:
        """The windows that stand in two runs of an anchor; a run holds each of its windows once."""
        heads = np.frombuffer(b"".join(r[0][:8] for r in runs), U64)
        found = []
        for length in lengths:
            keys, owner, place = _window_keys(runs, length)
            _, inverse, counts = np.unique(mix(keys ^ mix(heads[owner])), return_inverse=True, return_counts=True)
            found.append(_spans(counts[inverse] > 1, owner, place, len(runs)))
        some = [i for i, shared in enumerate(found[1]) if shared]
        columns = [[runs[i][0] for i in some], *[[spans[i] for i in some] for spans in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["entry", "spans", "shared"])

    def resolve(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, bytes]] = []
        for batch in arrow:
            held += _rows_of(batch)
            if not held or held[0][0][:8] == held[-1][0][:8]:
                continue  # the last anchor may go on in the next batch
            head = held[-1][0][:8]
            cut = next(i for i in range(len(held) - 1, -1, -1) if held[i][0][:8] != head) + 1
            yield settle(held[:cut])
            held = held[cut:]
        if held:
            yield settle(held)

    return resolve


def _covered(owner: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the maximal runs of bytes that windows cover, from spans of first and last window starts."""
    fits = last >= first
    owner, first, last = owner[fits], first[fits], last[fits]
    order = np.lexsort((first, owner))
    owner, first, last = owner[order], first[order], last[order]
    reach = np.maximum.accumulate(owner * (1 << 40) + last + length) - owner * (1 << 40)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (first[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return owner[at], first[at], reach[np.append(at[1:], len(owner)) - 1] if len(at) else reach


def _remover(lengths: tuple[int, int]):
    def spans(marks: pa.ListArray, column: str, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first, last window start); a mark without its own spans holds for the whole run, as far as windows fit in."""
        counts = np.diff(marks.offsets.to_numpy())
        owner = np.repeat(np.arange(len(counts)), counts)
        struct = marks.flatten()
        first, run, own = struct.field("first").to_numpy().astype(np.int64), struct.field("run").to_numpy().astype(np.int64), struct.field(column)
        whole = own.is_null().to_numpy(zero_copy_only=False)
        part = np.flatnonzero(~whole)
        blobs = own.take(pa.array(part)).to_pylist()
        pairs = np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2).astype(np.int64)
        of = np.repeat(part, [len(b) // 8 for b in blobs])
        last = np.minimum(first + run, sizes[owner] - length)
        return np.concatenate([owner[whole], owner[of]]), np.concatenate([first[whole], pairs[:, 0] + first[of]]), np.concatenate([last[whole], pairs[:, 1] + first[of]])

    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            if not batch.num_rows:
                continue
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            marks = batch.column("marks").fill_null([])
            sizes = np.array([len(t) for t in texts], np.int64)
            rows = len(texts)
            removed, shared = (_covered(*spans(marks, c, sizes, n), n) for c, n in zip(("spans", "shared"), lengths, strict=True))
            long = np.zeros(rows, np.int64)
            np.maximum.at(long, shared[0], shared[2] - shared[1])
            edges = np.searchsorted(removed[0], np.arange(rows + 1)).tolist()
            begins, ends = removed[1].tolist(), removed[2].tolist()
            kept = []
            for i, text in enumerate(texts):
                a, z = edges[i], edges[i + 1]
                kept.append(b"".join(text[x:y] for x, y in zip([0, *ends[a:z]], [*begins[a:z], len(text)], strict=True)) if a < z else text)
            left = np.array([len(k) for k in kept], np.int64)
            numbers = [sizes, sizes - left, np.bincount(removed[0], minlength=rows), np.bincount(shared[0], shared[2] - shared[1], rows).astype(np.int64), long]
            n_bytes, n_removed, n_spans, n_repeated, longest = (pa.array(c.astype(np.int64)) for c in numbers)
            digests = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n_removed, n_spans, digests, n_repeated, longest, pa.array(kept, pa.binary())], [c.split(" ")[0] for c in _CUT.split(", ")])

    return cut


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, longest_repeat long, kept binary"


def remove_repeats(docs: DataFrame, length: int = 400, report: int = 256, anchor: int = ANCHOR, batches: int = 3) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, longest_repeat, kept.

    A byte goes if a string of ``length`` bytes that covers it starts at another
    place too, in this document or another; all strings are judged on the input.
    ``n_repeated`` counts the bytes that strings of ``report`` bytes cover which
    start at another place too, no more than ``length``; they stay unless a longer
    one covers them. ``longest_repeat`` is the longest run of such bytes.
    ``kept`` is what stays, as bytes, since a cut may fall inside a character.
    Null texts are empty; texts shorter than ``report`` repeat nothing; repeated rows
    are documents of their own, so that both lose what they share. An empty table
    gives no rows; columns other than doc_id and text are not read.

    Entries found twice mark their whole run. Where an anchor has different runs,
    one occurrence of each is read again and the runs' windows are compared by
    hash, in one task for up to ``MOST_RUNS`` runs, as counted rows beyond; the
    marks then go to all occurrences.
    """
    report = min(report, length)
    lengths = (length, report)
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), "text"))
    marked = texts.withColumn("batch", F.pmod("key", F.lit(batches)).cast("int")).where(F.octet_length("text") >= report)
    entries = scratch.table(marked.select("key", "batch", "text").mapInArrow(tidy(_indexer(length, report, min(anchor, report))), _ENTRIES), "entries", ("batch",))
    index = SuffixIndex(scratch)
    for b in range(batches):
        index.add(entries.where(F.col("batch") == b))
    suffixes, heads = index.merged()

    total = int(heads.agg(F.sum("n")).first()[0] or 0)
    asked = join_groups(suffixes.select(_head(), "entry", "place"), heads, ["head"], "n", total).withColumn("common", F.col("n") > MOST_RUNS)
    wanted = asked.groupBy("place.key").agg(F.collect_list(F.struct("entry", "place.first", "place.run", "place.lead", "common")).alias("places"))
    variants = texts.join(wanted.hint("merge"), "key").select("text", "places")
    variants = scratch.table(variants.mapInArrow(tidy(_fetcher(length)), "entry binary, lead int, run int, bytes binary, common boolean"), "variants")
    rare = variants.where("NOT common").drop("common").withColumn("head", F.substring("entry", 1, 8)).repartition("head").sortWithinPartitions("entry").drop("head")
    partly = rare.mapInArrow(tidy(_resolver(lengths)), "entry binary, spans binary, shared binary")
    partly = scratch.table(partly.unionByName(_common_anchors(variants.where("common").drop("common"), lengths, scratch)), "partly")

    nothing = F.lit(None).cast("binary")
    whole = suffixes.where("times > 1").select("entry", "times", nothing.alias("spans"), nothing.alias("shared"))
    rest = partly.join(suffixes.where("times = 1").select("entry", "times").hint("merge"), "entry").select("entry", "times", "spans", "shared")
    marks = scratch.table(whole.unionByName(rest), "marks")
    total = int(marks.agg(F.sum("times")).first()[0] or 0)
    hits = join_groups(entries.select("key", "entry", "first", "run"), marks, ["entry"], "times", total)
    by_text = hits.groupBy("key").agg(F.collect_list(F.struct("first", "run", "spans", "shared")).alias("marks"))
    cut = texts.join(by_text.hint("merge"), "key", "left").select("doc_id", "text", "marks")
    return cut.mapInArrow(tidy(_remover(lengths)), _CUT)
