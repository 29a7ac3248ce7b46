"""Operators against SQL on the smallest tables, and against plain models."""

import functools
import os
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.functions import expr as E
from readloom.functions.ordinal import previous, running_sum, with_ordinal
from readloom.operators import duplicates, order, profile, sample
from readloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def plain(value):
    return None if value is None else round(float(value), 9) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    expected = sorted((tuple(plain(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def blocks_model(ids, m):
    out, at = [], 0
    while m and at + 2 * m <= len(ids):
        if ids[at : at + m] == ids[at + m : at + 2 * m]:
            n = m
            while at + 2 * (n + 1) <= len(ids) and ids[at : at + n + 1] == ids[at + n + 1 : at + 2 * n + 2]:
                n += 1
            out.append((at, at + n, n))
            at += 2 * n
        else:
            at += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 4))
def test_greedy_blocks_against_the_model(ids, m):
    def runs(lag, least):
        equal = [i + lag < len(ids) and ids[i] == ids[i + lag] for i in range(len(ids))]
        found, start = [], None
        for i, e in enumerate([*equal, False]):
            if e and start is None:
                start = i
            elif not e and start is not None:
                if i - start >= least:
                    found.append((start, i))
                start = None
        return found

    constant = [(a, z + 1) for a, z in runs(1, 2 * m + 1)]
    assert duplicates.greedy_blocks(runs(m, m), constant, m) == blocks_model(ids, m)


def collection(spark, ids):
    return spark.createDataFrame([(i, f"r{v}", "ACGT", "IIII") for i, v in enumerate(ids)], "ordinal long, read_name string, sequence string, quality string").repartition(3)


def test_blocks_on_spark(spark):
    rng = random.Random(1)
    ids = [rng.randrange(1000) for _ in range(30)] + list(range(2000, 2020)) * 2 + [7] * 9
    assert duplicates.adjacent_blocks(collection(spark, ids), 20) == blocks_model(ids, 20) == [(30, 50, 20)]
    distinct = list(range(60)) * 2
    assert duplicates.adjacent_blocks(collection(spark, distinct), 50) == []
    assert duplicates.adjacent_blocks(collection(spark, distinct), 50, strategy="any_length") == [(0, 60, 60)]
    assert duplicates.adjacent_blocks(collection(spark, distinct), 0) == []
    triple = list(range(10)) * 3
    left = duplicates.deduplicate(collection(spark, triple), min_block=10)
    assert sorted(r.ordinal for r in left.collect()) == [*range(10), *range(20, 30)]
    assert sorted(r.ordinal for r in duplicates.deduplicate(collection(spark, triple), keep="last", min_block=10).collect()) == [*range(10, 30)]
    assert duplicates.deduplicate(collection(spark, distinct), "whole-file-append", min_block=60).count() == 60


def natural(a, b):
    """Compare as lists of numbers (with their lengths) and single bytes."""
    import re

    def key(s):
        return [((0x30, len(x.lstrip("0") or "0"), (x.lstrip("0") or "0"), len(x)) if x.isdigit() else (ord(x), 0, "", 0)) for x in re.findall(r"[0-9]+|[^0-9]", s)]

    ka, kb = key(a), key(b)
    return (ka > kb) - (ka < kb)


def test_natural_order(spark):
    rng = random.Random(3)
    names = ["r1", "r10", "r2", "r02", "r002", "a", "a1b2", "a1b10", "", "00", "0", "r1a", "r1_", "x9", "x09y"] + ["".join(rng.choice("ab019:") for _ in range(rng.randrange(8))) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "read_name string").orderBy(E.natural_key(), "read_name").collect()]
    for a, b in zip(got, got[1:]):
        assert natural(a, b) <= 0
    assert sorted(got) == sorted(names) and sorted(set(names), key=functools.cmp_to_key(natural)) == list(dict.fromkeys(got))


def test_ordinals_and_stitching(spark):
    keys = random.Random(2).sample(range(-500, 5000), 900)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long").repartition(5)
    ranked = with_ordinal(df, "k", width=64)
    assert {r.k: r.ordinal for r in ranked.collect()} == {k: i for i, k in enumerate(sorted(keys))}
    lagged = previous(ranked, {"before": F.col("k")}, width=32)
    want = dict(zip(sorted(keys), [None, *sorted(keys)]))
    assert {r.k: r.before for r in lagged.collect()} == want
    total, at = {}, 0
    for k in sorted(keys):
        at += k % 7
        total[k] = at
    assert {r.k: r.s for r in running_sum(ranked, F.col("v"), "s", width=32).collect()} == total


def test_bounded_scans_at_the_edge(spark):
    reads = spark.range(100).selectExpr("id AS ordinal", "0 AS ref_id", "0 AS flags", "5 AS mapq")
    for limit, mode in ((99, "bounded_scan"), (100, "bounded_scan"), (101, "full_scan")):
        assert profile.summary(reads, limit, 1).first()["mode"] == mode
    assert not profile.reached_end(100, 100) and profile.reached_end(99, 100) and profile.reached_end(5, None)
    empty = profile.summary(reads.limit(0), None, 1).first()
    assert empty["mapping_status"] == "indeterminate" and empty["mapped_fraction"] is None and empty["confidence"] == "low"


def test_sort_check_verdicts(spark):
    def reads(rows):
        return spark.createDataFrame([(i, n, r, p, 0, 0) for i, (n, r, p) in enumerate(rows)], "ordinal long, read_name string, ref_id int, pos int, flags int, mapq int")

    placed = [(f"q{(i * 7) % 50}", 0, i) for i in range(50)]
    named = [(f"q{i:03}", 0, (i * 7) % 50) for i in range(50)]
    assert order.check_sort(reads(placed), 100).first()["order"] == "coordinate"
    assert order.check_sort(reads(named), 100, "coordinate").first()["agrees_with_header"] is False
    one = order.check_sort(reads([("q", 0, 1)] * 3), 100, "coordinate").first()
    assert one["order"] == "coordinate" and one["agrees_with_header"] is True
    assert order.check_sort(reads([("q", 0, 1)] * 3), 100).first()["order"] == "indeterminate"
    mess = [(f"q{(i * 7) % 50}", 0, (i * 11) % 50) for i in range(50)]
    bad = order.check_sort(reads(mess), 100, "coordinate").first()
    assert bad["order"] == "unsorted" and bad["first_violation"] is not None and bad["confidence"] == "high"
    assert order.check_sort(reads(placed), 100, "unsorted", "unsorted:template-coordinate").first()["order"] == "coordinate"
    assert order.check_sort(reads(placed), 100, "unsorted", "template-coordinate").first()["order"] == "indeterminate"


def test_subsamples(spark):
    reads = spark.range(2000).selectExpr("id AS ordinal", "concat('r', id) AS read_name", "cast(id % 3 - 1 as int) AS ref_id", "0 AS flags")
    assert sample.subsample_random(reads, 1.0, 3).count() == 2000
    small, large = ({r.ordinal for r in sample.subsample_random(reads, f, 3).collect()} for f in (0.2, 0.7))
    assert small <= large and 300 < len(small) < 500
    again = {r.ordinal for r in sample.subsample_random(reads.repartition(7), 0.2, 3).collect()}
    assert again == small
    mapped = sample.subsample_random(reads, 0.5, 3, mapped_only=True)
    assert mapped.where("ref_id < 0").count() == 0


def test_whole_tables_are_deduplicated(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert catalog.QUERIES["dedup_apply"](spark, SF).count() == documents > 180
    assert [tuple(r) for r in catalog.QUERIES["adjacent_blocks"](spark, SF).collect()] == [(0, documents, documents)]


def test_full_scans_see_every_record(spark):
    records = spark.read.parquet(f"{SF}/events.parquet").count()
    assert catalog.QUERIES["check_map_full"](spark, SF).first()["records_examined"] == records
    absent = catalog.QUERIES["check_tag_full"](spark, SF).where("tag = 'ZZ'").first()
    assert (absent["result"], absent["records_examined"]) == ("absent_in_full_scan", records)
