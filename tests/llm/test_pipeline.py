"""The pipeline, stage by stage, against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from test_dedup_and_mix import check_mix, normal
from test_near_dedup import brute_force

from readloom.llm import queries, toxicity
from readloom.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(rng):
    """Documents with toxic ones, copies, near copies, odd rows and columns named as the stages' own; and labels."""
    rows, labels = [], []
    for i in range(240):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 90))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["awful", "Nasty", "vile"]))
        rows.append((i, " ".join(words), rng.choice(["b", "a", None])))
        labels.append((i, int(toxic)))
    for i in range(30):
        words = rows[3 * i + 1][1].split()
        changed = list(words)
        changed[rng.randrange(len(changed))] = "changed"
        rows.append((300 + i, ("  ".join(words) if i % 2 else " ".join(changed)), "a"))
    rows += [(400, None, "a"), (401, "", "b"), (402, " \t", None), (403, "solo", "c"), (403, "solo", "c"), (403, "other text under the same id", "c"), (404, "long " * 30000, "c")]
    rows += [(None, "a text without an id", "a"), (None, "another text without an id", "a"), (None, rows[5][1], "a")]
    return [(i, t, s, "m", "d", 1) for i, t, s in rows], labels


def key(r):
    return r[0] if r[0] is not None else float("inf")


@pytest.fixture
def made(spark, tmp_path):
    rows, labels = corpus(random.Random(12))
    schema = "doc_id long, text string, source string, mark string, digest string, id int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, labels


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_brute_force(spark, made):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf, rows, labels = made
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark, "stages")

    scores = toxicity.toxic_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    flagged = collections.Counter((r.doc_id for r in scores if r.predicted))
    after = scratch.table(stages["toxicity"](spark, docs, sf), "toxicity")
    assert after.columns == docs.columns
    left = tuples(after)
    assert not collections.Counter(left) - collections.Counter(rows)
    assert collections.Counter(r[0] for r in rows) - collections.Counter(r[0] for r in left) == flagged
    truth = dict(labels)
    assert sum(truth[i] for i in flagged if i in truth) >= 0.9 * sum(truth.values()) and sum(1 - truth.get(i, 0) for i in flagged) <= 2

    want = {}
    for r in sorted(left, key=key):
        want.setdefault(normal(r[1]), r)
    after = scratch.table(stages["exact_dedup"](spark, after, sf), "exact")
    left = tuples(after)
    assert after.columns == docs.columns and sorted(left, key=repr) == sorted(want.values(), key=repr)

    # brute force on rows of their own ids; those without a doc_id join equal sets only
    known = [r for r in left if r[0] is not None]
    groups = brute_force([(n, r[1]) for n, r in enumerate(known)], 5, 80)
    best = collections.defaultdict(list)
    for n, r in enumerate(known):
        best[groups[n][1]].append(r)
    kept = {min(r[0] for r in g) for g in best.values()}
    after = scratch.table(stages["near_dedup"](spark, after, sf), "near")
    left = tuples(after)
    assert after.columns == docs.columns
    assert collections.Counter(r[0] for r in left if r[0] is not None) == collections.Counter(min(r[0] for r in g) for g in best.values())
    assert kept and {r[1] for r in left if r[0] is None} == {r[1] for r in want.values() if r[0] is None}

    after = scratch.table(stages["mix_sources"](spark, after, sf), "mix")
    mixed = collections.Counter(tuples(after))
    assert after.columns == docs.columns and not set(mixed) - set(left) and max(mixed.values()) <= 2
    taken = collections.namedtuple("Taken", "doc_id size source_size target taken")
    sizes = collections.Counter()
    for r in left:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    from readloom.llm import mixing

    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(sources, mixing.water_fill([float(sizes[s]) for s in sources], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))], 1.5, 2.0)))
    unique = [(n, r[1], r[2]) for n, r in enumerate(left)]
    report = [taken(n, len(WORD.findall(r[1] or "")), sizes[r[2]], targets[r[2]], len(WORD.findall(r[1] or "")) * mixed[r]) for n, r in enumerate(left)]
    largest = {s: max(r.size for r, row in zip(report, left) if row[2] == s) for s in sources}
    for source, (got, target) in check_mix(unique, report).items():
        assert abs(got - target) <= max(1, 0.02 * target, largest[source] / 2)

    library = Tokenizer.from_file(queries.tokenizer_path())
    packed = stages["pack_sequences"](spark, after, sf).collect()
    lengths = collections.Counter()
    for r, times in mixed.items():
        lengths[r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1] += times
    got = collections.defaultdict(int)
    ends = [r for r in packed if r.start + r.length in {n for i, n in lengths if i == r.doc_id} and (r.length < 2048 or (r.doc_id, r.start + r.length) in lengths)]
    for r in ends:
        got[r.doc_id, r.start + r.length] += 1
    assert {k: v for k, v in got.items() if k in lengths} == dict(lengths)
    assert sum(r.length for r in packed) == sum(n * c for (_, n), c in lengths.items())
    full = collections.defaultdict(list)
    for r in packed:
        full[r.sequence_id].append((r.offset, r.length))
    for spans in full.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist() and sum(n for _, n in spans) <= 2048
    assert len(full) <= 1.1 * sum(r.length for r in packed) / 2048 + 1

    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in packed)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_the_smallest_table(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    scratch = Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    full = packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n")
    assert full.where("n > 2048").count() == 0
    assert packed.where("piece = 0").count() == seen[4]
