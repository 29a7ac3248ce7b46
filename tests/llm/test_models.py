"""Toxicity and nearest neighbours."""

import math
import random
import zlib

import numpy as np

from readloom.llm import ann, queries, toxicity

SCHEMA = "doc_id long, text string, score string, label string"


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["awful", "Nasty", "vile"]))
        rows.append((i, " ".join(words), "s", "l"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(random.Random(1), 900)
    docs = spark.createDataFrame([*rows, (5000, None, None, None), (5001, "", None, None), (None, "w1 awful vile nasty awful", None, None), (0, rows[0][1], None, None)], SCHEMA)
    known = spark.createDataFrame([*labels, (1, None), (99999, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxic_scores(docs, known).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    left = toxicity.without_toxic(docs, known)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} >= {i for i, t in labels if not t} - {r.doc_id for r in got if r.predicted}
    none = known.limit(0)
    assert {r.score for r in toxicity.toxic_scores(docs.limit(3), none).collect()} == {0.5}
    assert toxicity.toxic_scores(docs.limit(0), known).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = labelled(random.Random(2), 200)
    docs = spark.createDataFrame(rows, SCHEMA)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.toxic_scores(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def exact(vectors, query_id, query, k):
    scored = []
    for i, v in ((i, np.asarray(v, float)) for i, v in vectors):
        if i != query_id and len(v) == len(query):
            scored.append((-float((v * query).sum() / (np.sqrt((v * v).sum()) * np.sqrt((query * query).sum()))), i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(32).astype(np.float32)) for i in range(1500)]
    rows += [(2000 + i, rows[7][1] + 0.01 * rng.standard_normal(32).astype(np.float32)) for i in range(6)]
    rows += [(3000 + i, rows[11][1]) for i in range(40)]
    good = list(rows)
    table = [(i, [float(x) for x in v], "s") for i, v in rows]
    table += [(4000, None, "s"), (4001, [0.0] * 32, "s"), (4002, [1.0, None], "s"), (4003, [float("nan")] * 32, "s"), (4004, [float("inf")] * 32, "s"), (4005, [], "s"), (4006, [1.0, 2.0], "s"), (4007, [2.0, 1.0], "s"), (None, [1.0] * 32, "s")]
    good += [(4006, np.array([1.0, 2.0])), (4007, np.array([2.0, 1.0]))]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<float>, score string")
    options = ann.AnnOptions(tile_rows=600, tile_queries=40)
    asked = [i for i, _ in good if i % 20 == 0 or i in (7, 11, 3001, 4006)]
    got = {}
    for r in ann.nearest(vectors, vectors.where(f"vec_id IN ({','.join(map(str, asked))}) OR vec_id > 3999"), 5, options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    by_id = dict(good)
    hits = total = 0
    for i in asked:
        want = exact(good, i, np.asarray(by_id[i], float), 5)
        found = [(v, s) for _, v, s in sorted(got[i])]
        hits += len({v for v, _ in found} & {v for v, _ in want})
        total += len(want)
        truth = dict(exact(good, i, np.asarray(by_id[i], float), len(good)))
        assert all(abs(truth[v] - s) < 1e-12 for v, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert hits >= 0.9 * total
    assert [v for _, v, _ in sorted(got[3001])] == [11, 3000, 3002, 3003, 3004]
    assert [v for _, v, _ in sorted(got[4006])] == [4007]
    assert not {4000, 4001, 4002, 4003, 4004, 4005} & set(got)
    assert ann.nearest(vectors.limit(0), vectors, 5).count() == 0


def test_query_recall(spark):
    sf = "/root/testdata/sf0.001"
    good = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {}
    for r in queries.op1_collision_ann(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {i: {v for v, _ in exact(good, i, q, 5)} for i, q in good if i % 50 == 0}
    assert got.keys() == want.keys()
    assert sum(len(got[i] & want[i]) for i in want) >= 0.9 * sum(map(len, want.values()))


def plain_ftrl(rows, o):
    """The published update, coordinate by coordinate."""
    z, n = {}, {}

    def weight(i, l1):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((o.beta + math.sqrt(n[i])) / o.alpha + o.l2)

    for epoch in range(o.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, label = rows[k]
            w = {i: weight(i, 0.0 if i == "bias" else o.l1) for i in [*at, "bias"]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for i, v in w.items():
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / o.alpha * v
                n[i] = before + g * g
    return {i: v for i in z if (v := weight(i, 0.0 if i == "bias" else o.l1))}


def test_training_against_a_plain_loop():
    rng = random.Random(6)
    rows = [(np.array(sorted(rng.sample(range(60), rng.randrange(1, 15)))), rng.randrange(2)) for _ in range(120)]
    for options in (toxicity.FtrlOptions(l1=0.5, epochs=3), toxicity.FtrlOptions(alpha=0.3, l1=0.1, l2=0.7, epochs=2)):
        at, weight, bias = toxicity.train(rows, options)
        want = plain_ftrl([(a.tolist(), y) for a, y in rows], options)
        assert dict(zip(at.tolist(), weight.tolist())).keys() == want.keys() - {"bias"}
        assert all(math.isclose(w, want[i], rel_tol=1e-9, abs_tol=1e-12) for i, w in zip(at.tolist(), weight.tolist())) and math.isclose(bias, want["bias"], rel_tol=1e-9)


def test_features_against_a_plain_list():
    import pyarrow as pa

    from readloom.llm.kernels import text_slices

    texts = ["One two  three one two", "", "solo", None, "a b a b a b"]
    for _, data, offsets in text_slices(pa.array(texts)):
        value, bounds = toxicity.features(data, offsets)
    sizes = []
    for t in texts:
        w = (t or "").lower().split()
        sizes.append(len(w) + max(len(w) - 1, 0) + max(len(w) - 2, 0))
    assert np.diff(bounds).tolist() == sizes
    repeated = value[bounds[4] : bounds[5]]
    assert len(set(repeated.tolist())) == 6  # a, b, ab, ba, a-a, b-b


def test_very_long_toxic_text(spark):
    rows, labels = labelled(random.Random(9), 300)
    rows += [(9001, "w1 w2 w3 " * 300000, "s", "l"), (9002, "w1 w2 w3 " * 300000 + "awful vile nasty awful vile", "s", "l")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.score for r in toxicity.toxic_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[9002] > got[9001]
    everything = toxicity.without_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert everything.count() == len(rows)


def test_neighbours_with_clashing_columns_and_long_vectors(spark):
    rng = np.random.default_rng(8)
    good = [(i, rng.standard_normal(3000)) for i in range(60)]
    rows = [(i, v.tolist(), 1, 2.0, "t", 4, 5.0) for i, v in good]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int, v double, tile string, query_tile int, score double")
    got = {}
    for r in ann.nearest(docs, docs.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for i in (0, 20, 40):
        assert [v for _, v in sorted(got[i])] == [v for v, _ in exact(good, i, good[i][1], 5)]
