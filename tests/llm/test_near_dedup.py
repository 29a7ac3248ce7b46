"""Circulant MinHash near-dedup against brute force."""

import random
import re

import numpy as np
import pytest

from readloom.llm import near_dedup, queries
from readloom.llm.common import Scratch
from readloom.llm.graph import connected_components
from readloom.llm.near_dedup import NearOptions

SCHEMA = "doc_id long, text string, node string, bands string"


def brute_force(rows, n, percent):
    sets, parent = {}, {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[doc_id] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
        parent[doc_id] = doc_id

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, size, words=120, most=9):
    """Copies of copies with a few changed words each."""
    texts = [[f"w{rng.randrange(4000)}" for _ in range(words)]]
    while len(texts) < size:
        text = list(rng.choice(texts[: 1 + len(texts) // 3]))
        for _ in range(rng.randrange(most)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(4000)}"
        texts.append(text)
    return [" ".join(t) for t in texts]


def test_families_and_odd_texts(spark):
    rng = random.Random(4)
    texts = family(rng, 40) + family(rng, 25, 60) + ["", None, " \t ", "One two", "one  TWO", "one", "a b c", "A b C", "x " * 3000, "x " * 2000]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    docs = spark.createDataFrame([(i, t, "n", "b") for i, t in rows], SCHEMA)
    for options in (NearOptions(shingle=3, percent=85), NearOptions()):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, options).collect()}
        assert got == brute_force(rows, options.shingle, options.percent)
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute_force(rows, 5, 80).values()})


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_one_bucket_of_many_loses_no_link(spark, percent):
    rng = random.Random(percent)
    rows = list(enumerate(family(rng, 150, 80, 12) + family(rng, 60, 80, 6)))
    want = brute_force(rows, 3, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark, "test")
    sets = scratch.table(docs.select("text").mapInArrow(near_dedup._set_maker(3), "node binary, shingles binary").dropDuplicates(["node"]), "sets")
    signed = docs.mapInArrow(near_dedup._signer(NearOptions(shingle=3)), "doc_id long, n_shingles long, node binary, bands array<long>")
    node = {r.doc_id: bytes(r.node) for r in signed.collect()}
    members = scratch.table(sets.selectExpr("7L AS bucket", "node"), "members")
    sizes = scratch.table(sets.selectExpr("node", "octet_length(shingles) / 8 AS n"), "sizes")
    roots = {bytes(r.node): bytes(r.root) for r in near_dedup.linked_components(members, sets, sizes, percent, scratch).collect()}
    groups, wanted = {}, {}
    for i in node:
        groups.setdefault(roots.get(node[i], node[i]), set()).add(i)
        wanted.setdefault(want[i][1], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, "q r s t u"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(near_dedup.near_duplicates(docs).collect(), key=repr)
    assert len(got) == 6
    assert all(r.component_id == 1 for r in got if r.doc_id == 1)
    assert sum(r.kept for r in got) == 5
    # different texts without a doc_id stay, each once
    assert near_dedup.without_near_duplicates(docs).count() == 4
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_signature_is_the_shifted_minimum():
    options = NearOptions(bands=4, rows=3)
    shingles = np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2)
    scatter, windows = near_dedup.permutations(options)
    circle = windows[:, 0]
    start = scatter[(shingles >> np.uint64(44)).astype(int)]
    want = [min(circle[(s + k) % len(circle)] for s in start) for k in range(12)]
    assert near_dedup.signature(shingles, options).tolist() == want


def test_components_of_paths_and_cycles(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200), (300, 301), (301, 300)] + [(500, rng.randrange(501, 560)) for _ in range(40)]
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(table, Scratch(spark, "cc"), "t").collect()}
    assert all(got[i] == 0 for i in range(61))
    assert got[102] == 100 and got[301] == 300 and 200 not in got
    assert all(root == 500 for node, root in got.items() if node >= 500)


def test_query_on_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_minhash_near_dedup(spark, sf).collect()}
    assert got == brute_force(rows, 3, 85)


def test_counts_of_shingles_in_rounds(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 50).astype(np.uint64) & np.uint64(0xFFC0000000000000 | (1 << 20) - 1)) for _ in range(300)]
    want = np.zeros(1 << near_dedup.SKETCH_BITS, np.int64)
    for s in sets:
        np.add.at(want, (s >> np.uint64(64 - near_dedup.SKETCH_BITS)).astype(np.int64), 1)
    rows = spark.createDataFrame([(s.tobytes(),) for s in sets], "shingles binary").repartition(13)
    for fan_in in (2, 5, 64):
        got = near_dedup.shingle_counts(rows, Scratch(spark, "counts"), fan_in)
        assert (got == want).all()


def test_pairs_with_a_much_met_centre(spark):
    sets = spark.createDataFrame([(bytes([i % 256, i // 256]), bytes([i % 256])) for i in range(1500)], "node binary, shingles binary")
    rows = [(bytes([i % 256, i // 256]), bytes([7, 0])) for i in range(1500) if i != 7] + [(bytes([1, 0]), bytes([2, 0]))]
    stars = spark.createDataFrame(rows, "a binary, b binary")
    met = stars.groupBy("b").count().withColumnRenamed("count", "met")
    got = near_dedup._with_centres(stars.join(met, "b"), met, sets).collect()
    assert sorted((bytes(r.a), bytes(r.b)) for r in got) == sorted(rows)
    assert all(bytes(r.left_set) == bytes(r.a[:1]) and bytes(r.right_set) == bytes(r.b[:1]) for r in got)


def test_rows_that_share_a_doc_id_and_clashing_columns(spark):
    near = family(random.Random(8), 3, 80, 2)
    rows = [(1, near[0], 5, 6), (1, near[0], 5, 6), (1, "quite another text under the same id", 5, 6), (2, near[0].upper(), 5, 6), (None, "no id here", 5, 6), (None, "no id here", 5, 6), (None, near[0], 5, 6), (3, None, 5, 6), (3, "", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, mark int")
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr) == sorted([(1, near[0]), (1, rows[2][1]), (None, "no id here"), (3, "")], key=repr)


def test_a_very_long_text_and_its_near_copy(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 150000)]
    changed = list(words)
    changed[70000] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:75000])), (4, " ".join(words[:100]))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
