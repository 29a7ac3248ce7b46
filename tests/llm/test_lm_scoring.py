"""Stupid backoff against brute force."""

import math
import random
import re
from collections import Counter

from readloom.llm import lm_scoring

SCHEMA = "doc_id long, text string, n_words string, lot string"


def grams(text, order):
    w = ["<s>"] * (order - 1) + re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w))]


def counted(train, order):
    counts, contexts = Counter(), Counter()
    for _, text in train:
        for g in grams(text, order):
            for k in range(1, order + 1):
                counts[g[order - k :]] += 1
                contexts[g[order - k : -1]] += 1
    return counts, contexts


def scored(i, text, counts, contexts, order, alpha):
    n = contexts[()]

    def score(g):
        if len(g) == 1:
            return max(counts[g], 0.5) / max(n, 1)
        return counts[g] / contexts[g[:-1]] if counts[g] else alpha * score(g[1:])

    found = grams(text, order)
    return i, len(found), sum(math.log(score(g)) for g in found) if found else None, sum(not counts[g] for g in found)


def brute_force(docs, train, order, alpha):
    return [scored(i, t, *counted(train, order), order, alpha)[:3] for i, t in docs]


def left_out(docs, alpha):
    """Each row by the counts of all other rows."""
    counts, contexts = counted(docs, 2)
    out = []
    for i, t in docs:
        own = counted([(i, t)], 2)
        others = [Counter({g: c - mine[g] for g, c in all_.items()}) for all_, mine in zip((counts, contexts), own)]
        out.append(scored(i, t, *others, 2, alpha))
    return out


def same(got, want):
    got, want = sorted(((r.doc_id, r.n_words, r.log_score) for r in got), key=repr), sorted(want, key=repr)
    return len(got) == len(want) and all(g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (w[2] is None or math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9)) for g, w in zip(got, want, strict=True))


def rows_of(rng):
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "One", "one", "a b " * 2000, "zebra a quagga b", " \t"]
    return list(enumerate(texts)) + [(None, "a b c only"), (3, "again"), (3, "again")]


def test_scores_by_all_other_documents(spark):
    rows = rows_of(random.Random(2))
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for parts in (docs.coalesce(1), docs.repartition(7)):
        got, want = lm_scoring.score_left_out(parts).collect(), left_out(rows, 0.4)
        assert same(got, [w[:3] for w in want])
        assert sorted((r.backed_off for r in got)) == sorted(w[3] for w in want) and any(w[3] for w in want)
        assert all(r.mean_log_score is None or math.isclose(r.mean_log_score, r.log_score / r.n_words) for r in got)


def test_lots_and_parts(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.1)), 70000)}" for _ in range(rng.randrange(300)))) for i in range(150)]
    rows += [(500, " ".join(f"v{i}" for i in range(70000)))]  # more distinct words than 16 bits number
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 20000)
    got = lm_scoring.score_left_out(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert same(got, [w[:3] for w in left_out(rows, 0.4)])


def test_copies_score_apart(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(200)]
    rows = list(enumerate(texts + texts[:20]))
    means = {r.doc_id: r.mean_log_score for r in lm_scoring.score_left_out(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = {*range(20), *range(200, 220)}
    assert min(means[i] for i in twice) > max(m for i, m in means.items() if i not in twice)


def test_scores_against_another_corpus(spark):
    rows = [r for r in rows_of(random.Random(3)) if r[0] is not None]
    odd, even = [r for r in rows if r[0] % 2], [r for r in rows if r[0] % 2 == 0]
    unseen = [*odd, (99, "zebra a b zebra"), (None, "a b"), (7, "a b"), (7, "a b"), (8, None)]
    schema = "doc_id long, text string"
    got = lm_scoring.score_against(spark.createDataFrame(unseen, schema), spark.createDataFrame(even, schema))
    assert same(got.collect(), brute_force(unseen, even, 3, 0.4))
    assert same(lm_scoring.score_against(spark.createDataFrame(odd, schema), spark.createDataFrame([], schema)).collect(), brute_force(odd, [], 3, 0.4))
    assert lm_scoring.score_against(spark.createDataFrame([], schema), spark.createDataFrame(even, schema)).count() == 0


def test_empty_table(spark):
    assert lm_scoring.score_left_out(spark.createDataFrame([], "doc_id long, text string")).count() == 0
