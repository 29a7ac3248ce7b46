"""Fuzzy repeated passages by collinear chaining of shared word k-mers.

All k-mers that documents share are joined on their hash, a range of hashes after the other. Links follow the number
of occurrences: of a k-mer's occurrences the first is the hub that all others are
linked with. As that hub may hold no more than a piece of a passage, so is the first of
those that also agree in another k-mer some way on, or back: the one of least hash in
each of four windows around (``SKETCHES``), the outer ones far enough for the two to
span most of a passage. The links of two documents are chained in order, each step
paying for its gap, with a Fenwick tree for the best predecessor; chains are then
aligned word by word, which settles ends, matches and identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups
from .kernels import ngrams, text_slices, tidy, words


@dataclass(frozen=True)
class PassageOptions:
    """k-mer length in words and share of k-mers used, all unless fewer are asked for; least matched words and identity of a passage; gap cost a word against the gain of a seed; words that an alignment may skip at once."""

    k: int = 4
    sampled: float = 1.0
    min_words: int = 40
    identity: float = 0.8
    gain: float = 5.5
    gap: float = 0.25
    reach: int = 48

    @property
    def pairs(self) -> int:
        """Pairs of neighbouring words that the two sides of a passage agree in at least: a word left out or put in on either side parts one pair."""
        return math.ceil(max(self.min_words - 1 - 2 * self.min_words * (1 / self.identity - 1) - 1e-9, 0))

    @property
    def margin(self) -> int:
        """Words that a passage may go on beyond its outermost seeds."""
        return self.k + 10 + self.reach


#: Width of the windows whose least k-mer goes with a seed, and where they begin; with k-mers of 4 words the outermost make 40 words with it.
WIDTH, SKETCHES = 12, (12, 24, -24, -36)
#: Words of a text that travel as one row to where they are aligned.
PAGE = 256
#: A key with more than this share of a task's seeds is dealt out by document; there can be no more than its inverse of them a task.
HOT_SHARE = 1 / 2000
#: One document in so many is asked for such keys, which decide where rows go, not what is found.
HOT_SAMPLE = 16
#: Ranges of hashes that seeds are joined in, one after the other, so that no more than a part of them lies on disk.
ROUNDS = 2
#: Seeds that a task gathers before it sends them on, packed by parts of the range; bytes of text that a part stands for.
LOT, PART_BYTES = 400_000, 1 << 20
#: Bits of a key, and the least and most of them that tell its part; the rest has 32 at most.
KEY_BITS, LEAST_BITS, MOST_BITS = 40, 8, 16
#: Of neighbouring seeds on one diagonal, every so manieth goes into chains beside the first and the last.
STRIDE = 3
#: Edits on either side of a seed that the second way of alignment follows.
_EDITS = 64
#: A key has 40 bits, last in the row where its zeros meet others, which makes shuffled rows smaller.
_SEEDS = "uid long, pos int, salt int, sketch long, key long"
#: Of a key that is dealt out, rows come as they are: without a hub, but with key and sketch.
_LINKS = "uid long, hub long, pos int, hub_pos int, span int, sketch long, key long"
_PACKED = "part int, dealt boolean, seeds binary"
_ASKED = "uid long, chain long, side int, at int, low int, high int"
_PAGES = "uid long, doc_id long, page int, words binary"
_PARTS = "chain long, side int, page int, doc_id long, low int, at int, words binary"
_FOUND = "doc_id long, start_word long, end_word long, other_id long, other_start long, other_end long, matched_words long, identity double"


def sketches(grams: np.ndarray, bounds: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    """For each k-mer, or each chosen one, four times 16 bits: of the least k-mer in each window around it, 0 where the row has none there."""
    rows = len(bounds) - 1
    pad = max(max(-s, s + WIDTH) for s in SKETCHES)
    spaced = np.full(len(grams) + (rows + 2) * pad, np.uint64(2**64 - 1))
    at = np.arange(len(grams)) + (np.repeat(np.arange(rows), np.diff(bounds)) + 1) * pad
    spaced[at] = grams
    low, p = spaced, 1
    while 2 * p <= WIDTH:
        low = np.minimum(low[:-p], low[p:])
        p *= 2
    low = np.minimum(low[: len(low) - (WIDTH - p)], low[WIDTH - p :])
    at = at if chosen is None else at[chosen]
    out = np.zeros(len(at), np.uint64)
    for i, begin in enumerate(SKETCHES):
        least = low[at + begin]
        out |= np.where(least == np.uint64(2**64 - 1), np.uint64(0), (least & np.uint64(0x7FFF)) + np.uint64(1)) << np.uint64(16 * i)
    return out


def repeated_at_once(grams: np.ndarray, bounds: np.ndarray, o: PassageOptions) -> np.ndarray:
    """Which k-mers lie in a further round of text that repeats itself at once, in rounds of fewer words than a window, as one word over and over."""
    out = np.zeros(len(grams), bool)
    for shift in range(1, min(WIDTH, len(grams))):
        at = np.flatnonzero(grams[shift:] == grams[:-shift])
        if not len(at):
            continue
        row = np.searchsorted(bounds, at, "right")
        one = bounds[row] > at + shift  # both in one row
        at, row = at[one], row[one]
        begin = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(row, prepend=-1) != 0))
        size = np.diff(begin, append=len(at))
        out[at[np.repeat(size + o.k - 1 >= shift, size)] + shift] = True
    return out


def _sampled(batch: pa.RecordBatch, o: PassageOptions, low: int = 0, high: int = 1 << KEY_BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, position, key, sketch) of the seeds of a batch whose keys lie from ``low`` on and below ``high``."""
    limit = min(int(o.sampled * 2.0**64), 2**64 - 1)
    for first, data, offsets in text_slices(batch.column("text")):
        hashes, bounds = words(data, offsets)
        grams, starts = ngrams(hashes, bounds, o.k)
        keys = (grams >> np.uint64(64 - KEY_BITS)).view(np.int64)
        at = np.flatnonzero((grams <= np.uint64(limit)) & (keys >= low) & (keys < high) & ~repeated_at_once(grams, starts, o))
        row = np.searchsorted(starts, at, "right") - 1
        yield first, row, at - starts[row], keys[at], sketches(grams, starts, at).view(np.int64)


def _hot_finder(o: PassageOptions):
    def find(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys that may own more than ``HOT_SHARE`` of this task's seeds, counted by lots, of which the commoner half is kept while they are too many."""
        keys, counts, total = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for batch in arrow:
            for _, _, _, key, _ in _sampled(batch, o):
                total += len(key)
                keys, inverse = np.unique(np.concatenate([keys, key]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, np.ones(len(key))]), len(keys)).astype(np.int64)
                if len(keys) > 1 << 18:
                    many = counts > np.median(counts)
                    keys, counts = keys[many], counts[many]
        many = counts > max(total * HOT_SHARE, 50)
        yield pa.RecordBatch.from_arrays([pa.array(keys[many])], ["key"])

    return find


def _seeder(o: PassageOptions, hot: np.ndarray, low: int = 0, high: int = 1 << KEY_BITS):
    def seed(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            uids = batch.column("uid").to_numpy()
            for first, row, pos, key, sketch in _sampled(batch, o, low, high):
                # text that repeats itself at once, as one word over and over, is one passage: what starts in its first round is kept
                order = np.lexsort((pos, sketch, key, row))
                row, pos, key, sketch = (c[order] for c in (row, pos, key, sketch))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (sketch[1:] != sketch[:-1]) | (pos[1:] - pos[:-1] >= o.min_words)
                uid, pos, key, sketch = uids[row[new] + first], pos[new].astype(np.int32), key[new], sketch[new]
                salt = np.where(np.isin(key, hot), (uid & 0x3FF) + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (uid, pos, salt, sketch, key)], ["uid", "pos", "salt", "sketch", "key"])

    return seed


def _range(turn: int, bits: int) -> tuple[int, int]:
    """First part of a round and of the next one."""
    return (turn << bits) // ROUNDS, (turn + 1 << bits) // ROUNDS


def _packer(o: PassageOptions, hot: np.ndarray, turn: int, bits: int):
    """The seeds of one round, many to a row: rows of their own would cost the shuffle more than all else."""
    low, high = _range(turn, bits)
    seed = _seeder(o, hot, low << KEY_BITS - bits, high << KEY_BITS - bits)

    def pack(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in seed(arrow):
            key, uid, pos, sketch, salt = (batch.column(c).to_numpy() for c in ("key", "uid", "pos", "sketch", "salt"))
            part = key >> (KEY_BITS - bits)
            # seeds of a common key go to a part by document
            part = np.where(salt > 0, low + (uid & 0xFFFFF) % (high - low), part) - low
            held.append([part.astype(np.uint16), salt > 0, key, uid, pos, sketch])
            if sum(len(h[0]) for h in held) >= LOT:
                yield lot(held)
                held = []
        if held:
            yield lot(held)

    def lot(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        part, dealt, key, uid, pos, sketch = (np.concatenate(c) for c in zip(*held, strict=True))
        rows: list[tuple] = []
        for kind in (False, True):
            at = np.flatnonzero(dealt == kind)
            at = at[np.argsort(part[at], kind="stable")]
            edges = np.flatnonzero(np.diff(part[at], prepend=-1, append=-1)) if len(at) else []
            # what a part says of a key needn't travel, but of a common one the part says nothing
            sent = [(key[at] if kind else key[at] & (1 << KEY_BITS - bits) - 1).astype("<i8" if kind else "<u4"), uid[at].astype("<i8"), pos[at].astype("<i4"), sketch[at].astype("<i8")]
            rows += [(int(part[at[a]]) + low, kind, b"".join(c[a:z].tobytes() for c in sent)) for a, z in zip(edges, edges[1:], strict=False)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["part", "dealt", "seeds"])

    return pack


def _unpacked(raw: bytes, part: int, dealt: bool, bits: int) -> list[np.ndarray]:
    n, at, out = len(raw) // (28 if dealt else 24), 0, []
    for kind in ("<i8" if dealt else "<u4", "<i8", "<i4", "<i8"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out if dealt else [out[0].astype(np.int64) + (part << KEY_BITS - bits), *out[1:]]


def _part_linker(o: PassageOptions, bits: int):
    """``_linker`` over packed seeds, which come part by part."""
    link = _linker(o)

    def batch_of(key: np.ndarray, uid: np.ndarray, pos: np.ndarray, sketch: np.ndarray, salt: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (uid, pos, np.full(len(key), salt, np.int32), sketch, key)], ["uid", "pos", "salt", "sketch", "key"])

    def sorted_part(part: int, blobs: list[bytes]) -> pa.RecordBatch:
        key, uid, pos, sketch = (np.concatenate(c) for c in zip(*[_unpacked(b, part, False, bits) for b in blobs], strict=True))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        order = order[np.append(same, False) | np.append(False, same)]  # a key that is there once links nothing
        order = order[np.lexsort((pos[order], uid[order], key[order]))]
        return batch_of(key[order], uid[order], pos[order], sketch[order], 0)

    def seeds(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = -1, []
        for batch in arrow:
            for part, dealt, raw in zip(*[batch.column(c).to_pylist() for c in ("part", "dealt", "seeds")], strict=True):
                if dealt:
                    yield batch_of(*_unpacked(raw, part, True, bits), 1)
                    continue
                if part != now and blobs:
                    yield sorted_part(now, blobs)
                    blobs = []
                now = part
                blobs.append(raw)
        if blobs:
            yield sorted_part(now, blobs)

    def link_parts(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return link(seeds(arrow))

    return link_parts


def _first_of(*by: np.ndarray) -> np.ndarray:
    """For each row, the first row that has the same values."""
    order = np.lexsort(by)
    start = np.ones(len(order), bool)
    start[1:] = np.any([c[order][1:] != c[order][:-1] for c in by], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
    return out


def _linker(o: PassageOptions):
    names = [c.split(" ")[0] for c in _LINKS.split(", ")]

    def links(pieces: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, uid, pos, sketch, salt = (np.concatenate(c) for c in zip(*pieces, strict=True))
        dealt = np.flatnonzero(salt > 0)
        none = pa.nulls(len(dealt), pa.int64())
        hot = [pa.array(uid[dealt]), none, pa.array(pos[dealt]), none.cast(pa.int32()), none.cast(pa.int32()), pa.array(sketch[dealt]), pa.array(key[dealt])]
        same = (key[1:] == key[:-1]) & (salt[1:] == 0) & (salt[:-1] == 0)
        many = np.append(same, False) | np.append(False, same)
        key, uid, pos, sketch = (c[many] for c in (key, uid, pos, sketch))
        hubs = [_first_of(key)]
        for i in range(len(SKETCHES)):
            part = sketch >> (16 * i) & 0xFFFF
            hubs.append(np.where(part != 0, _first_of(part, key), hubs[0]))
        found = []
        for i, hub in enumerate(hubs):
            keep = (uid != uid[hub]) | (pos - pos[hub] >= o.min_words)
            for other in hubs[:i]:
                keep &= hub != other
            # a hub that agrees in another k-mer as well counts as a longer match
            span = np.any([hub == other for other in hubs[1:]], axis=0) * WIDTH + o.k
            found.append((uid[keep], uid[hub[keep]], pos[keep], pos[hub[keep]], span[keep].astype(np.int32)))
        cold = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
        none = pa.nulls(len(cold[0]), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(hot, [*cold, none, none], strict=True)], names)

    def link(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From seeds sorted by key, uid and place: a row for each but the first of a key, with the first, and so among those that share part of the sketch."""
        held: list[list[np.ndarray]] = []
        for batch in arrow:
            columns = [batch.column(c).to_numpy() for c in ("key", "uid", "pos", "sketch", "salt")]
            key = columns[0]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1])) if columns[4][-1] == 0 else len(key)  # the last key may go on in the next batch
            if last or (held and held[-1][0][-1] != key[0]):
                ready = [*held, [c[:last] for c in columns]]
                held = []
                yield links(ready)
            held.append([c[last:] for c in columns])
            held = held if len(held[-1][0]) or len(held) > 1 else []
        if held:
            yield links(held)

    return link


def _hot_links(dealt: DataFrame, o: PassageOptions, scratch: Scratch) -> DataFrame:
    """The links of keys that were dealt out, as the linker makes them: minima are taken before the shuffle, and hubs of many rows meet them by broadcast."""
    parts = [F.shiftrightunsigned("sketch", 16 * i).bitwiseAND(0xFFFF) for i in range(len(SKETCHES))]
    kinds = F.array(F.xxhash64("key"), *[F.when(p != 0, F.xxhash64("key", F.lit(i), p)) for i, p in enumerate(parts)])
    rows = scratch.table(dealt.select("uid", "pos", F.posexplode(kinds).alias("kind", "bucket")).where("bucket IS NOT NULL"), "dealt")
    hubs = rows.groupBy("bucket").agg(F.min(F.struct("uid", "pos")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    hubs = scratch.table(hubs, "dealt-hubs")
    met = join_groups(rows, hubs, ["bucket"], "rows", rows.count())
    met = met.where((F.col("uid") != F.col("first.uid")) | (F.col("pos") - F.col("first.pos") >= o.min_words))
    span = F.when(F.max("kind") > 0, WIDTH + o.k).otherwise(o.k).cast("int").alias("span")
    return met.groupBy("uid", F.col("first.uid").alias("hub"), "pos", F.col("first.pos").alias("hub_pos")).agg(span)


def chains(x: list[int], y: list[int], o: PassageOptions) -> list[list[int]]:
    """Disjoint collinear chains of seeds (x ascending), best first.

    A seed adds ``gain``; a step costs ``gap`` for each word of half of what it
    advances in both texts. So the value of a predecessor is its score plus a term
    of its own place, and the best one to the lower left is a prefix maximum in a
    Fenwick tree over y.
    """
    n = len(x)
    if n == 0:
        return []
    cost = o.gap / 2
    places = {v: i + 1 for i, v in enumerate(sorted(set(y)))}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(places) + 1)
    score, back = [0.0] * n, [-1] * n
    waiting: list[int] = []
    for j in range(n):
        if waiting and x[waiting[0]] < x[j]:
            for i in waiting:
                entry, p = (score[i] + cost * (x[i] + y[i]), i), places[y[i]]
                while p < len(tree):
                    if tree[p] < entry:
                        tree[p] = entry
                    p += p & -p
            waiting = []
        p, best = places[y[j]] - 1, (-1e18, -1)
        while p > 0:
            if tree[p] > best:
                best = tree[p]
            p -= p & -p
        step = best[0] - cost * (x[j] + y[j])
        score[j] = o.gain
        if best[1] >= 0 and step > 0:
            score[j] += step
            back[j] = best[1]
        waiting.append(j)
    used, found = [False] * n, []
    for j in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = back[j]
        if chain:
            found.append(chain[::-1])
    return found


def thinned(uid: np.ndarray, hub: np.ndarray, x: np.ndarray, y: np.ndarray, span: np.ndarray, o: PassageOptions) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links, sorted by uid, hub and x, go into chains, and all spans, the longest of its run for each.

    Links of two documents on one diagonal that overlap or touch are a run; its first and last stay and
    those between by ``STRIDE``, so that every run is there with both of its ends.
    """
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (hub[1:] != hub[:-1])
    line = (np.cumsum(new) << 33) + (x.astype(np.int64) - y + (1 << 32))
    order = np.argsort(line, kind="stable")
    line, at = line[order], y[order].astype(np.int64)
    first = np.ones(len(order), bool)
    first[1:] = (line[1:] != line[:-1]) | (at[1:] - at[:-1] > o.k)
    last = np.append(first[1:], True)
    begin = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    step = (at - at[begin][run]) // STRIDE
    kept = first | last
    kept[1:] |= step[1:] != step[:-1]
    keep, longest = np.empty(len(order), bool), np.empty(len(order), span.dtype)
    keep[order] = kept
    longest[order] = np.maximum.reduceat(span[order], begin)[run]
    return keep, longest


def reachable(chain: list[int], x: list[int], y: list[int], o: PassageOptions) -> Iterator[list[int]]:
    """The pieces of a chain between steps that no alignment makes; each is aligned by itself."""
    begin = 0
    for n in range(1, len(chain)):
        i, j = chain[n - 1], chain[n]
        if max(x[j] - x[i], y[j] - y[i]) > o.reach + 2 * o.k:
            yield chain[begin:n]
            begin = n
    yield chain[begin:]


def _chainer(o: PassageOptions):
    least = 2 * o.k  # two seeds that share no word; fewer agreeing words are chance
    slack = o.k + 10

    def chained(uid: int, hub: int, x: list[int], y: list[int], span: list[int]) -> Iterator[tuple]:
        """(minus seeds, first and last word of the chain in the document, hub, first and last word there)."""
        for chain in (piece for whole in chains(x, y, o) for piece in reachable(whole, x, y, o)):
            a, z = chain[0], chain[-1]
            if min(y[z] - y[a], x[z] - x[a]) + o.k >= least or max(span[i] for i in chain) >= least:
                yield -len(chain), y[a], y[z], hub, x[a], x[z]

    def ask(uid: int, found: list[tuple], out: list[tuple]) -> None:
        for _, first, last, hub, hub_first, hub_last in found:
            # the last bit says that both sides lie in one document
            key = (xxhash.xxh3_64_intdigest(np.array([uid, hub, hub_first, first], "<i8").tobytes()) - (1 << 63)) & ~1 | (uid == hub)
            out.append((uid, key, 0, first, max(first - o.margin, 0), last + o.k + o.margin))
            out.append((hub, key, 1, hub_first, max(hub_first - o.margin, 0), hub_last + o.k + o.margin))

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["uid", "chain", "side", "at", "low", "high"])

    def settle(columns: list[np.ndarray]) -> pa.RecordBatch:
        uid, hub, x, y, _ = columns
        order = np.lexsort((y, x, hub, uid))  # sorted by uid alone when they came, which is cheaper
        columns = [c[order] for c in columns]
        keep, span = thinned(*columns, o)
        columns = [c[keep] for c in (*columns[:-1], span)]
        uid, hub = columns[0], columns[1]
        edges = [0, *(np.flatnonzero((uid[1:] != uid[:-1]) | (hub[1:] != hub[:-1])) + 1).tolist(), len(uid)]
        rows: list[tuple] = []
        found: list[tuple] = []
        for a, z in zip(edges, edges[1:], strict=False):
            if a and uid[a] != uid[a - 1]:
                ask(int(uid[a - 1]), found, rows)
                found = []
            found += chained(int(uid[a]), int(hub[a]), *[c[a:z].tolist() for c in columns[2:]])
        ask(int(uid[-1]), found, rows)
        return emit(rows)

    def chain_groups(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in arrow:
            columns = [batch.column(c).to_numpy() for c in ("uid", "hub", "hub_pos", "pos", "span")]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last document may go on in the next batch
            if cut:
                yield settle([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        if held is not None:
            yield settle(held)

    return chain_groups


def _pager(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of a text's words, page by page."""
    for batch in arrow:
        uids, ids = batch.column("uid").to_numpy(), batch.column("doc_id").to_numpy()
        for first, data, offsets in text_slices(batch.column("text")):
            hashes, bounds = words(data, offsets)
            raw, ends = (hashes >> np.uint64(32)).astype("<u4").tobytes(), bounds.tolist()
            pages = -(-np.diff(bounds) // PAGE)
            row = np.repeat(np.arange(len(pages)), pages)
            page = np.arange(len(row)) - np.repeat(np.cumsum(pages) - pages, pages)
            begin = bounds[row] + page * PAGE
            blobs = [raw[4 * a : 4 * min(a + PAGE, ends[r + 1])] for a, r in zip(begin.tolist(), row.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(uids[row + first]), pa.array(ids[row + first]), pa.array(page.astype(np.int32)), pa.array(blobs, pa.binary())], ["uid", "doc_id", "page", "words"])


def _slicer(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page, the words that a chain asks for."""
    for batch in arrow:
        blobs = []
        for page, low, high, raw in zip(*[batch.column(c).to_pylist() for c in ("page", "low", "high", "words")], strict=True):
            blobs.append(raw[4 * max(low - page * PAGE, 0) : 4 * max(high - page * PAGE, 0)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("chain", "side", "page", "doc_id", "low", "at")] + [pa.array(blobs, pa.binary())], ["chain", "side", "page", "doc_id", "low", "at", "words"]
        )


@cache
def _steps(reach: int) -> np.ndarray:
    """In which order words may be skipped in a (rows) and b (columns): fewest in all; of one or two, a changed word or one more in a first."""
    a, b = np.indices((reach + 1, reach + 1))
    off = a + b
    rank = np.where((off <= 2) & (a == 1), -1, a)
    order = off * 1000 + rank
    return np.where((off == 0) | (off > reach), 1 << 30, order)


def align(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[int, int, int]:
    """Words used of a and of b, and matched ones, in an alignment from both starts."""
    return align_ends(a, b, reach)[-1]


def align_ends(a: np.ndarray, b: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """The places where an alignment from both starts may end: words used of a and of b, and matched ones.

    Equal runs are taken whole; at a difference the nearest place where three words
    agree again (or the rest, if shorter) is taken, no more than ``reach`` words
    off in all; the alignment ends at its last match where there is none.
    """
    i = j = matched = 0
    ends = [(0, 0, 0)]
    while i < len(a) and j < len(b):
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
        run = int(differ[0]) if len(differ) else n
        i, j, matched = i + run, j + run, matched + run
        if run:
            ends.append((i, j, matched))
        if i >= len(a) or j >= len(b):
            break
        equal = a[i : i + reach + 3, None] == b[None, j : j + reach + 3]
        thrice = equal[:-2, :-2] & equal[1:-1, 1:-1] & equal[2:, 2:]
        if not thrice.any():
            break
        order = np.where(thrice, _steps(reach)[: thrice.shape[0], : thrice.shape[1]], 1 << 30)
        best = int(order.argmin())
        if order.flat[best] == 1 << 30:
            break
        step = divmod(best, thrice.shape[1])
        i, j = i + step[0], j + step[1]
    return ends


def edit_ends(a: np.ndarray, b: np.ndarray, edits: int) -> list[tuple[int, int, int]]:
    """As ``align_ends``, by the furthest place that each number of edits reaches (words changed, left out or put in)."""
    if not len(a) or not len(b):
        return [(0, 0, 0)]
    # runs[edits + d, i]: equal words from a[i] and b[i + d] on
    shift = np.arange(-edits, edits + 1)
    at = np.arange(len(a) + 1)
    j = at + shift[:, None]
    equal = np.zeros(j.shape, bool)
    inside = (j >= 0) & (j < len(b)) & (at < len(a))
    equal[inside] = (a[np.minimum(at, len(a) - 1)] == b[np.clip(j, 0, len(b) - 1)])[inside]
    stop = np.where(equal, len(a) + 1, at)
    runs = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1] - at
    low = np.full(len(shift), -1)
    reached, matched = low.copy(), low.copy()
    reached[edits], matched[edits] = 0, 0
    rows, found = np.arange(len(shift)), []
    for n in range(edits + 1):
        if n:
            # a changed word advances both, one left out advances a only, one put in b only
            i = np.stack([reached + (reached >= 0), np.append(reached[1:] + (reached[1:] >= 0), -1), np.append(-1, reached[:-1])])
            m = np.stack([matched, np.append(matched[1:], -1), np.append(-1, matched[:-1])])
            i[(i > len(a)) | (i + shift > len(b)) | (i + shift < 0)] = -1
            best = i.argmax(axis=0)
            reached, matched = i[best, rows], m[best, rows]
        run = np.where(reached >= 0, runs[rows, np.maximum(reached, 0)], 0)
        reached, matched = reached + run, matched + run
        open_ = np.flatnonzero((reached >= 0) & (run > 0))
        if len(open_):
            top = open_[np.argmax(matched[open_])]
            found.append((int(reached[top]), int(reached[top] + shift[top]), int(matched[top])))
    return found or [(0, 0, 0)]


def best_ends(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], o: PassageOptions, apart: int | None = None) -> tuple[tuple[int, int, int], tuple[int, int, int]] | None:
    """The ends that match most words among those that make a passage; of one document, whose places lie ``apart``, those whose sides don't overlap."""
    x, y = np.array(left)[:, None, :], np.array(right)[None, :, :]
    both = x + y
    matched = both[..., 2]
    good = (matched >= o.min_words) & (matched >= o.identity * np.maximum(both[..., 0], both[..., 1]))
    if apart is not None:
        good &= x[..., 0] + y[..., 1] <= apart
    if not good.any():
        return None
    p, q = np.unravel_index(int(np.argmax(np.where(good, matched, -1))), good.shape)
    return left[p], right[q]


def _words_in_common(a: np.ndarray, b: np.ndarray) -> int:
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[p], m[q]).sum())


def pairs_in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Pairs of neighbouring words of a that b has as well."""
    if len(a) < 2 or len(b) < 2:
        return 0
    x, y = ((w[:-1].astype(np.uint64) << np.uint64(32)) + w[1:] for w in (a, b))
    y.sort()
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _aligner(o: PassageOptions):
    def passage(mine: dict, other: dict) -> tuple | None:
        apart = mine["at"] - other["at"] if mine["chain"] & 1 else None
        a, b = np.frombuffer(mine["words"], "<u4"), np.frombuffer(other["words"], "<u4")
        if pairs_in_common(a, b) < o.pairs:
            return None  # no alignment of the two can be a passage
        p, q = mine["at"] - mine["low"], other["at"] - other["low"]
        sides = (a[:p][::-1], b[:q][::-1]), (a[p:], b[q:])
        found = best_ends(*(align_ends(*side, o.reach) for side in sides), o, apart)
        if found is None and _words_in_common(a, b) >= o.min_words:
            # close edits lead the first way astray; half as many again as identity allows, as ends are still to be chosen
            found = best_ends(*(edit_ends(*side, min(int(1.5 * (1 - o.identity) * max(map(len, side))), _EDITS)) for side in sides), o, apart)
        if found is None and apart is not None and _words_in_common(a, b) >= o.min_words:
            # an equal run longer than the distance has no end inside it
            for cut in range(0, min(p, q, apart) + 1, 8):
                halves = (a[p - min(p, cut) : p][::-1], b[q - min(q, cut) : q][::-1]), (a[p:][: apart - cut], b[q:][: apart - cut])
                found = best_ends(*(align_ends(*side, o.reach) for side in halves), o, apart)
                if found is not None:
                    break
        if found is None:
            return None
        left, right = found
        matched, used = left[2] + right[2], max(left[0] + right[0], left[1] + right[1])
        start, other_start = mine["at"] - left[0], other["at"] - left[1]
        return mine["doc_id"], start, mine["at"] + right[0], other["doc_id"], other_start, other["at"] + right[1], matched, matched / used

    def align_pairs(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: list[dict] = []
        for batch in arrow:
            rows = []
            for row in batch.to_pylist():
                if sides and sides[-1]["chain"] == row["chain"] and sides[-1]["side"] == row["side"]:
                    sides[-1]["words"] += row["words"]  # the next page
                    continue
                if sides and sides[0]["chain"] != row["chain"]:
                    rows += settle(sides)
                    sides = []
                sides.append(row)
            yield emit(rows)
        yield emit(settle(sides))

    def settle(sides: list[dict]) -> list[tuple]:
        found = passage(*sides) if len(sides) == 2 else None
        return [] if found is None else [found]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [*[pa.int64()] * 7, pa.float64()]
        names = [c.split(" ")[0] for c in _FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return align_pairs


def repeated_passages(docs: DataFrame, options: PassageOptions | None = None) -> DataFrame:
    """Fuzzy passages that documents share: doc_id, start_word, end_word, other_id, other_start, other_end, matched_words, identity.

    Words lie between ASCII white space, A-Z lower-cased; ends are exclusive. Of
    documents that share a passage, each is paired with one that holds it, the hub
    of its seeds alone or with another seed, and not with all others. A passage has at least ``min_words``
    words that match in order, and no lower share of its longer side than
    ``identity``. Further copies inside a document are reported as well, with the
    document itself where it is the hub; the two sides don't overlap then, and text
    that repeats within fewer than ``min_words`` words counts as one copy. Where two
    hubs cover a stretch of a document, pairs with others that have fewer seeds in it
    are left out. Of chains
    and ends that are as good, those further to the left are taken.
    Rows with a null doc_id take no part; null, empty and short texts have no
    passages; rows equal in doc_id and text are one document, other rows with the
    same doc_id are different ones. An empty table gives no rows; columns other
    than doc_id and text are not read.

    Seeds of a very common k-mer are dealt out by document and meet their hubs as
    in ``_hot_links``; texts travel in pages of ``PAGE`` words to the chains that
    ask for them, those asked for most by broadcast.
    """
    o = options or PassageOptions()
    scratch = Scratch(docs.sparkSession, "passages")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("uid", F.xxhash64("doc_id", "text"))
    some = texts.where(F.pmod("uid", F.lit(HOT_SAMPLE)) == 0).select("text")
    # at most 1 / HOT_SHARE keys a task, and as many again where tasks differ
    common = some.mapInArrow(tidy(_hot_finder(o)), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("tasks")).orderBy(F.desc("tasks"), "key").limit(int(2 / HOT_SHARE)).collect()
    hot = np.array(sorted(r["key"] for r in common), np.int64)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((size // PART_BYTES).bit_length(), LEAST_BITS), MOST_BITS)
    rounds = []
    for turn in range(ROUNDS):
        seeds = texts.select("uid", "text").mapInArrow(tidy(_packer(o, hot, turn, bits)), _PACKED)
        links = seeds.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(_part_linker(o, bits)), _LINKS)
        rounds.append(scratch.table(links, f"links-{turn}"))
        del seeds, links
        rounds[-1].isEmpty()  # the listener bus holds on to a query until the next one ends
        scratch.release()
    links = reduce(DataFrame.unionByName, rounds)
    names = ["uid", "hub", "pos", "hub_pos", "span"]
    links = links.where("hub IS NOT NULL").select(*names).unionByName(_hot_links(links.where("hub IS NULL"), o, scratch).select(*names))
    asked = links.repartition("uid").sortWithinPartitions("uid").mapInArrow(tidy(_chainer(o)), _ASKED)
    asked = scratch.table(asked, "asked")
    del links, rounds
    for turn in range(ROUNDS):
        scratch.drop(f"links-{turn}")
    asked.isEmpty()
    scratch.release()

    wanted = texts.join(asked.select("uid").distinct().hint("merge"), "uid", "left_semi").dropDuplicates(["uid"])
    turned = asked.withColumn("page", F.explode(F.sequence(F.expr(f"low div {PAGE}").cast("int"), F.expr(f"(high - 1) div {PAGE}").cast("int"))))
    turned = scratch.table(turned, "turned")
    requests = scratch.table(turned.groupBy("uid", "page").agg(F.count(F.lit(1)).alias("requests")), "requests")
    pages = wanted.select("uid", "doc_id", "text").mapInArrow(tidy(_pager), _PAGES).join(requests.hint("merge"), ["uid", "page"])
    pages = scratch.table(pages, "pages")
    parts = join_groups(turned, pages, ["uid", "page"], "requests", turned.count()).select("chain", "side", "page", "doc_id", "low", "high", "at", "words").mapInArrow(tidy(_slicer), _PARTS)
    sides = parts.repartition("chain").sortWithinPartitions("chain", "side", "page")
    return sides.mapInArrow(tidy(_aligner(o)), _FOUND)
