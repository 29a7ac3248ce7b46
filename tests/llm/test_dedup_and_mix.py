"""Exact dedup, repeated strings, mixing: against brute force on small and odd tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from readloom.llm import exact_dedup, mixing, queries, suffix_dedup
from readloom.llm.exact_dedup import DigestIndex

SCHEMA = "doc_id long, text string, source string, digest string, size string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "d", "z") for i, t, s in rows], SCHEMA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


ODD = [(5, "a  b", "s"), (3, "a\tb", "s"), (9, " a b", "s"), (7, None, None), (8, "", "s"), (2, " \n", "s"), (11, "é x", "t"), (11, "é x", "t"), (None, "a b", "s"), (None, "alone", "s"), (20, "x" * 90000, "s"), (21, "x" * 90000, "s")]


def test_exact_duplicates(spark):
    rows = ODD + [(100 + i, "hot text", "s") for i in range(300)]
    got = exact_dedup.exact_duplicates(table(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[hashlib.sha256(normal(t).encode()).hexdigest()].append(i)
    want = []
    for i, t, _ in rows:
        h = hashlib.sha256(normal(t).encode()).hexdigest()
        keep = min((x for x in groups[h] if x is not None), default=None)
        want.append((i, keep, len(groups[h]), i == keep, h))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0
    left = exact_dedup.deduplicate(table(spark, rows))
    assert left.columns == table(spark, []).columns
    assert left.count() == len(groups)


def test_index_opens_with_the_buckets_it_was_made_with(spark):
    rows = [(i, f"text {i}", "s") for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        first = DigestIndex(spark)
        exact_dedup.exact_duplicates(table(spark, rows), first).count()
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = DigestIndex(spark, first.path)
        assert again.buckets == 16
        got = exact_dedup.exact_duplicates(table(spark, [(i + 1000, t, s) for i, t, s in rows] + [(5000, "new", "s")]), again).collect()
        assert {r.doc_id for r in got if r.kept} == {5000}
        assert again.read().count() == 201
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="16 buckets"):
        DigestIndex(spark, first.path, buckets=7)
    unnoted = f"{first.path}-unnoted"
    spark.range(3).write.parquet(unnoted)
    with pytest.raises(ValueError, match="how many buckets"):
        DigestIndex(spark, unnoted)


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3), (2, "a  b", 4, 5, 6)], "doc_id long, text string, id long, ID_ long, digest long")
    assert exact_dedup.deduplicate(docs).collect() == docs.where("doc_id = 1").collect()


def test_index_outlives_its_name(spark):
    first = DigestIndex(spark, buckets=4)
    exact_dedup.exact_duplicates(table(spark, [(1, "one", "s"), (2, "two", "s")]), first)
    again = DigestIndex(spark, first.path, buckets=4)
    got = exact_dedup.exact_duplicates(table(spark, [(10, "two", "s"), (11, "three", "s"), (12, "three", "s")]), again)
    assert {r.doc_id: (r.keep_id, r.kept) for r in got.collect()} == {10: (2, False), 11: (11, True), 12: (11, False)}
    assert again.read().count() == 3


def covered(texts, length):
    """Per text, which bytes a string of ``length`` bytes covers that starts at two places."""
    counts = collections.Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append(gone)
    return out


def run_lengths(flags):
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return (edge[1::2] - edge[::2]).tolist()


def repeats(rows, length, report):
    texts = [(t or "").encode() for _, t, _ in rows]
    out = []
    for (i, _, _), b, gone, shared in zip(rows, texts, covered(texts, length), covered(texts, report), strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), len(run_lengths(gone)), hashlib.sha256(kept).hexdigest(), int(shared.sum()), max(run_lengths(shared), default=0)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [4096, 2])
def test_repeated_strings(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", most)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    passage, line = noise(150), "the same line over and over again\n"
    rows = [(i, noise(rng.randrange(300)), "s") for i in range(25)]
    rows += [(50 + i, noise(rng.randrange(60)) + passage[rng.randrange(20) :] + noise(rng.randrange(60)) + passage[: 100 + rng.randrange(50)], "s") for i in range(12)]
    rows += [(80, line * 30, "s"), (81, "x" * 500, "s"), (82, None, None), (83, "", "s"), (84, passage, "s"), (84, passage, "s"), (None, noise(10) + passage, "s"), (85, "y" * 60, "s"), (86, "ab" * 100, "s")]
    for length, report, anchor in ((60, 40, 20), (61, 61, 31), (90, 33, 8)):
        got = suffix_dedup.remove_repeats(table(spark, rows), length, report, anchor).drop("kept").collect()
        assert sorted(map(tuple, got), key=repr) == repeats(rows, length, report)
    assert suffix_dedup.remove_repeats(table(spark, []), 60, 40, 20).count() == 0


def test_repeats_in_a_text_of_several_pieces(spark):
    rng = np.random.default_rng(7)
    noise = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage, short = noise(900), noise(300)
    cut = suffix_dedup.PIECE - 500
    long = noise(cut) + passage + noise(60000) + short + noise(20) + passage[:450]
    rows = [(1, long, "s"), (2, noise(50) + passage + noise(50), "s"), (3, short, "s"), (4, noise(5000), "s")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    want = long[:cut] + long[cut + 900 : -450]
    assert (got[1].n_removed, got[1].n_spans, got[1].n_repeated, got[1].longest_repeat) == (1350, 2, 1650, 900)
    assert got[1].kept_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert [(got[i].n_removed, got[i].n_repeated) for i in (2, 3, 4)] == [(900, 900), (0, 300), (0, 0)]


def test_very_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    import pyarrow as pa

    rng = random.Random(6)
    text = "".join(rng.choice("abcd") for _ in range(suffix_dedup.PIECE * 5))
    batch = pa.RecordBatch.from_pydict({"key": pa.array([1]), "batch": pa.array([0], pa.int32()), "text": pa.array([text * 500])})
    covered = set()
    for out in suffix_dedup._indexer(60, 60, 20)(iter([batch.slice(0, 1)])):
        for first, run in zip(out.column("first").to_pylist(), out.column("run").to_pylist(), strict=True):
            covered.update(range(first, first + run + 1))
        if len(covered) > 5000:
            break
    assert covered >= set(range(0, 3000))


def test_levels_merge_geometrically(spark):
    from readloom.llm.common import Scratch

    rows = [(i, "".join(random.Random(i).choice("abc") for _ in range(200)), "s") for i in range(16)]
    docs = table(spark, rows).selectExpr("doc_id AS key", "cast(doc_id % 4 as int) AS batch", "text")
    scratch = Scratch(spark, "levels")
    entries = scratch.table(docs.mapInArrow(suffix_dedup._indexer(60, 60, 20), suffix_dedup._ENTRIES), "entries")
    index = suffix_dedup.SuffixIndex(scratch)
    sizes = []
    for b in range(4):
        index.add(entries.where(f"batch = {b}"))
        sizes.append([level[0] for level in index.levels])
    assert sizes == [[1], [2], [2, 1], [4]]


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [3, 1, 2], 1.5, 2) == pytest.approx([20, 25 / 3, 50 / 3])
    sizes, weights = [5.0, 100, 1, 0, 30], [3.0, 1, 2, 3, 1]
    target = mixing.water_fill(sizes, weights, 1.5, 2)
    assert sum(target) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(target, sizes))


def test_fit_budget_is_exact_where_a_subset_is():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 7)))
        counts = rng.integers(0, 4, len(lengths))
        reach = {0}
        for length, c in zip(lengths.tolist(), counts.tolist()):
            reach = {r + k * length for r in reach for k in range(c + 1)}
        budget = int(rng.integers(0, 200))
        take = mixing.fit_budget(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all()
        assert int((take * lengths).sum()) == max(r for r in reach if r <= budget)
    lengths, counts = np.arange(1, 3000), rng.integers(0, 500, 2999)
    budget = int((lengths * counts).sum()) // 3
    assert int((mixing.fit_budget(lengths, counts, budget) * lengths).sum()) == budget


def check_mix(rows, got):
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(sources, mixing.water_fill([float(sizes[s]) for s in sources], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))], 1.5, 2.0)))
    assert len(got) == len(rows)
    taken = collections.Counter()
    owner = {i: s for i, _, s in rows}
    for r in got:
        s = owner[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    return {s: (taken[s], target[s]) for s in sources}


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), rng.choice(["b", "a", "é", "Z", None])) for i in range(400)]
    rows += [(1000 + i, "same length text here", "a") for i in range(300)] + [(5000, None, "only null"), (5001, "", "a")]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    for taken, target in check_mix(rows, got).values():
        assert abs(taken - target) <= 1
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    times = {r.doc_id: r.taken // r.size for r in got if r.size}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {i: t for i, t in times.items() if t}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(table(spark, [(1, None, "s"), (2, " ", None)])).collect())


def test_queries_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op5_suffix_dedup(spark, sf).collect()), key=repr) == repeats(rows, 400, 256)
    for taken, target in check_mix(rows, queries.op7_mix_sources(spark, sf).collect()).values():
        assert abs(taken - target) <= max(1, 0.02 * target)
