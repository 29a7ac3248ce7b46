"""Language-model scores by stupid backoff over word n-gram counts.

Texts are exploded into n-grams; count tables are partitioned by n-gram hash; every
document's n-grams meet their counts there, and the logarithms are summed per
document. ``score_left_out`` scores each document of a corpus by the counts of all
others, with bigrams that travel packed; ``score_against`` scores documents by the
counts of another corpus, of any order, with joins on rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, join_groups, shuffle_partitions
from .kernels import U64, mix, release, text_slices, tidy, words

#: The usual factor for each step back to a shorter n-gram.
ALPHA = 0.4
#: Documents are packed in lots of about so many bytes of text, and counted in parts that stand for about so many.
LOT_BYTES, PART_BYTES = 3 << 20, 16 << 20
_BEGIN = U64(0x243F6A8885A308D3)
_LOW = U64((1 << 40) - 1)

_PACKETS = "to int, lot long, part int, docs binary, grams binary, words binary"
_COUNTED = "lot long, part int, docs binary, grams binary, words binary"
_SCORES = "doc_id long, n_words long, log_score double, mean_log_score double, backed_off long"


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays behind their types and lengths, compressed."""
    parts = [np.array([len(arrays)], "<u8").tobytes()]
    for a in arrays:
        parts += [np.array([a.dtype.itemsize, len(a)], "<u8").tobytes(), a.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unsqueeze(raw: bytes) -> list[np.ndarray]:
    """Unsigned arrays as ``_squeeze`` packed them."""
    data = zstandard.ZstdDecompressor().decompress(raw)
    out, at = [], 8
    for _ in range(int(np.frombuffer(data, "<u8", 1)[0])):
        size, n = (int(v) for v in np.frombuffer(data, "<u8", 2, at))
        out.append(np.frombuffer(data, f"<u{size}", n, at + 16))
        at += 16 + size * n
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in as few bytes as the largest needs."""
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _pack(hashes: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Five bytes a hash, then numbers of each, which are mostly small."""
    low = (hashes & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return np.array([len(hashes)], "<u4").tobytes() + low + _squeeze(*[_narrow(n) for n in numbers])


def _unpack(packed: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(packed, "<u4", 1)[0])
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8, 5 * n, 4).reshape(-1, 5)
    return wide.view("<u8").ravel(), *[a.astype(np.int64) for a in _unsqueeze(packed[4 + 5 * n :])]


class _Lot:
    """Distinct words and bigrams of each document of a lot, from the places of words among their document's distinct ones.

    ``word`` numbers a document's distinct words in order of appearance, all
    documents of the lot in a row; ``gram`` numbers its distinct pairs of them, with
    the begin mark of a document as the first of a pair.
    """

    def __init__(self, counts: np.ndarray, local: np.ndarray):
        self.counts = counts
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.starts = np.cumsum(counts) - counts
        distinct = np.zeros(len(counts), np.int64)
        np.maximum.at(distinct, self.owner, local + 1)
        self.bases = np.cumsum(distinct) - distinct
        self.word = local + self.bases[self.owner]
        self.n_words = int(distinct.sum())
        self.first = np.zeros(len(self.word), bool)
        self.first[self.starts[counts > 0]] = True
        before = np.append(0, self.word[:-1]) if len(self.word) else self.word
        self.before = np.where(self.first, self.n_words + self.owner, before)
        self.pairs, self.gram = np.unique(self.before * max(self.n_words, 1) + self.word, return_inverse=True)

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray) -> tuple[_Lot, np.ndarray]:
        """The lot of documents with these words, and the hash of each distinct word."""
        owner = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        firsts = order[new]  # the sort is stable, so these are the first places
        rank = np.empty(len(firsts), np.int64)
        by_place = np.argsort(firsts)
        rank[by_place] = np.arange(len(firsts))
        word = np.empty(len(order), np.int64)
        word[order] = rank[np.cumsum(new) - 1]
        distinct = np.bincount(owner[firsts], minlength=len(counts))
        return _Lot(counts, word - (np.cumsum(distinct) - distinct)[owner]), hashes[firsts[by_place]]

    def lasts(self) -> np.ndarray:
        """The words that end a document."""
        return self.word[(self.starts + self.counts - 1)[self.counts > 0]]


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _packer(parts: int):
    names = [c.split(" ")[0] for c in _PACKETS.split(", ")]

    def packets(number: int, doc_ids: list, hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        count = np.concatenate(counts)
        lot, distinct = _Lot.of(np.concatenate(hashes), count)
        first, second = np.divmod(lot.pairs, max(lot.n_words, 1))
        grams = mix(np.append(distinct, np.full(len(count), _BEGIN, U64))[first] * U64(0x9E3779B97F4A7C15) + distinct[second]) if lot.n_words else np.empty(0, U64)
        word_part, gram_part = _part_of(distinct, parts), _part_of(grams, parts)
        known = np.array([d is not None for d in doc_ids], np.uint8)
        ids = np.array([d or 0 for d in doc_ids], "<i8").view("<u8")
        head = _squeeze(ids, known, _narrow(count), _narrow(lot.word - lot.bases[lot.owner]), _narrow(word_part), _narrow(gram_part))
        rows: list[tuple] = [(number % parts, number, -1, head, None, None)]
        numbers = (np.bincount(lot.gram, minlength=len(grams)),), (np.bincount(lot.word, minlength=lot.n_words), np.bincount(lot.lasts(), minlength=lot.n_words))
        sides = []
        for part, values, own in zip((gram_part, word_part), (grams, distinct), numbers, strict=True):
            order = np.argsort(part, kind="stable")
            sides.append((order, values, own, np.searchsorted(part[order], np.arange(parts + 1))))
        docs = np.array([int((count > 0).sum())], "<u8").tobytes()
        for p in range(parts):
            packed = [_pack(values[order[e[p] : e[p + 1]]], *[n[order[e[p] : e[p + 1]]] for n in own]) for order, values, own, e in sides]
            rows.append((p, number, p, docs if p == number % parts else None, *packed))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def pack(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = TaskContext.get().partitionId() << 32
        doc_ids, hashes, counts, held = [], [], [], 0
        for batch in arrow:
            ids = batch.column("doc_id").to_pylist()
            for first, data, offsets in text_slices(batch.column("text")):
                h, bounds = words(data, offsets)
                doc_ids += ids[first : first + len(bounds) - 1]
                hashes.append(h)
                counts.append(np.diff(bounds))
                held += len(data)
                if held >= LOT_BYTES:
                    yield packets(number, doc_ids, hashes, counts)
                    number += 1
                    doc_ids, hashes, counts, held = [], [], [], 0
        if doc_ids:
            yield packets(number, doc_ids, hashes, counts)

    return pack


def _totals(hashes: list[np.ndarray], times: np.ndarray) -> np.ndarray:
    """For each n-gram the number of times that all have it."""
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    return np.bincount(inverse, times).astype(np.int64)[inverse]


def _count_part(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of the count tables: count its n-grams, and answer each lot with those of all other documents."""
    release()
    names = [c.split(" ")[0] for c in _COUNTED.split(", ")]
    lots, parts, grams, gram_times, plain, word_times, ends, docs = [], [], [], [], [], [], [], 0
    for batch in arrow:
        own = batch.filter(pc.less(batch.column("part"), 0))
        yield own.select(names)
        for row in batch.filter(pc.greater_equal(batch.column("part"), 0)).to_pylist():
            lots.append(row["lot"])
            parts.append(row["part"])
            h, t = _unpack(row["grams"])
            grams.append(h)
            gram_times.append(t)
            h, t, last = _unpack(row["words"])
            plain.append(h)
            word_times.append(t)
            ends.append(last)
            docs += int(np.frombuffer(row["docs"], "<u8")[0]) if row["docs"] else 0
    if not lots:
        return
    if len(set(parts)) > 1:
        raise ValueError("parts of the count tables have met in one task")
    t, w, e = (np.concatenate(c) for c in (gram_times, word_times, ends))
    sums = np.array([w.sum(), docs], "<u8")
    del gram_times, word_times, ends
    counts = [_totals(grams, t) - t, _totals(plain, w) - w, _totals(plain, w - e) - (w - e)]
    gram_cuts, word_cuts = (np.cumsum([0, *map(len, c)]).tolist() for c in (grams, plain))
    del grams, plain
    for begin in range(0, len(lots), 100):
        rows = []
        for i in range(begin, min(begin + 100, len(lots))):
            g, v = slice(gram_cuts[i], gram_cuts[i + 1]), slice(word_cuts[i], word_cuts[i + 1])
            rows.append((lots[i], parts[i], sums.tobytes(), _squeeze(_narrow(counts[0][g])), _squeeze(_narrow(counts[1][v]), _narrow(counts[2][v]))))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _score_lot(alpha: float):
    def placed(answers: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        """Answers of the parts in turn, put where the lot has their n-grams."""
        out = np.zeros(len(part), np.float64)
        out[np.argsort(part, kind="stable")] = np.concatenate(answers) if answers else out
        return out

    def score(table: pa.Table) -> pa.Table:
        release()
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        ids, known, count, local, word_part, gram_part = _unsqueeze(rows[0]["docs"])
        lot = _Lot(count.astype(np.int64), local.astype(np.int64))
        words_, docs = np.sum([np.frombuffer(r["docs"], "<u8") for r in rows[1:]], axis=0).astype(np.float64)
        answers = [(_unsqueeze(r["grams"])[0], *_unsqueeze(r["words"])) for r in rows[1:]]
        grams = placed([a[0] for a in answers], gram_part)
        plain, contexts = (placed([a[i] for a in answers], word_part) for i in (1, 2))
        # the begin mark is a context once in each document with words
        context = np.append(contexts, np.full(len(count), docs - 1.0))[lot.before]
        seen = grams[lot.gram]
        others = np.maximum(words_ - lot.counts, 1.0)[lot.owner]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(seen > 0, seen / context, alpha * np.maximum(plain[lot.word], 0.5) / others)
        total = np.bincount(lot.owner, np.log(value), len(count))
        back = np.bincount(lot.owner, seen == 0, len(count)).astype(np.int64)
        empty = lot.counts == 0
        return pa.table({
            "doc_id": pa.array(ids.view("<i8"), mask=known == 0),
            "n_words": pa.array(lot.counts),
            "log_score": pa.array(total, mask=empty),
            "mean_log_score": pa.array(total / np.maximum(lot.counts, 1), mask=empty),
            "backed_off": pa.array(back),
        })

    return score


def score_left_out(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, backed_off) of each document by the bigram counts of all other documents.

    Words lie between ASCII white space, A-Z lower-cased; a begin mark comes before
    the first. A word that others have after the same one scores its bigram's count
    over that of its first word as a context; one that they haven't backs off, and
    scores ``alpha`` times its share of all words, where an unseen word counts as
    seen half a time. ``backed_off`` counts those. Scores of documents without words
    are null. Repeated rows are documents of their own, each other's included; null
    doc_ids stay null; an empty table gives no rows. Columns other than doc_id and
    text are not read.

    A document sends a distinct n-gram once, so that no n-gram has more entries than
    there are documents, however common. A part is a task's, and stands for
    ``PART_BYTES`` of text whatever the input; an n-gram is known by its part and 40
    more bits, so that about one in a million is taken for another.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    packed = texts.mapInArrow(tidy(_packer(parts)), _PACKETS)
    counted = packed.repartitionById(parts, F.col("to")).mapInArrow(tidy(_count_part), _COUNTED)
    return counted.groupBy("lot").applyInArrow(_score_lot(alpha), _SCORES)


def exploded(docs: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, g1, ..., g<order>): for each word the hashes of the n-grams that end with it; g1 is the word."""
    mark = F.array_repeat(F.lit("<s>"), order - 1)
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.filter(F.split(lower, f"[{SPACE}]+"), lambda w: w != "")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(mark, found).alias("w"), F.size(found).alias("n"))
    spots = marked.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(order), F.col("n") + order - 1)))
    return spots.select("doc_id", *[F.xxhash64(F.lit(k), F.slice("w", F.col("i") - (k - 1), k)).alias(f"g{k}") for k in range(1, order + 1)], *[F.xxhash64(F.lit(-k), F.slice("w", F.col("i") - k, k)).alias(f"c{k}") for k in range(1, order)])


def count_tables(train: DataFrame, order: int, scratch: Scratch) -> dict[str, DataFrame]:
    """Counts of n-grams (g1 to g<order>) and of contexts (c1 to c<order-1>), partitioned by hash and written; the total number of words as "n"."""
    spots = exploded(train, order)
    tables = {}
    for name in [c for c in spots.columns if c != "doc_id"]:
        tables[name] = scratch.table(spots.groupBy(F.col(name).alias("h")).agg(F.count(F.lit(1)).alias("count")), f"count-{name}")
    tables["n"] = tables["g1"].agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    return tables


def score_against(docs: DataFrame, train: DataFrame, order: int = 3, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of documents by the counts of another corpus, with backoff.

    An unseen n-gram scores ``alpha`` times what its shorter one does, down to the
    word's share of all words; an unseen word counts as seen half a time. Documents
    without words have null scores; repeated rows and null doc_ids are scored as
    well. Either table may be empty; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    tables = count_tables(train, order, scratch)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("doc_id", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text"))
    rows = scratch.table(exploded(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), order), "exploded")
    for k in [*range(1, order + 1), *range(-1, -order, -1)]:
        name = f"g{k}" if k > 0 else f"c{-k}"
        table = tables[name].withColumnRenamed("count", f"n_{name}")
        used = scratch.table(rows.groupBy(F.col(name).alias("h")).agg(F.count(F.lit(1)).alias("uses")).join(table, "h", "left"), f"used-{name}")
        total = int(used.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0])
        rows = join_groups(rows.withColumn("h", F.col(name)), used, ["h"], "uses", total).drop("h", "uses", name)
        rows = scratch.table(rows, f"joined-{name}")
    n = float(tables["n"].first()["n"])
    score = F.greatest(F.coalesce("n_g1", F.lit(0)).cast("double"), F.lit(0.5)) / F.lit(max(n, 1.0))
    for k in range(2, order + 1):
        score = F.when(F.col(f"n_g{k}").isNotNull(), F.col(f"n_g{k}") / F.col(f"n_c{k - 1}")).otherwise(F.lit(alpha) * score)
    summed = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.ln(score)).alias("log_score"))
    every = docs.select("id", "doc_id").join(summed, "doc_id", "left")
    return every.select(F.col("id").alias("doc_id"), F.coalesce("n_words", F.lit(0)).alias("n_words"), "log_score", (F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
