"""What comes to the driver and what one task holds don't follow the input; results are those of plain models."""

import hashlib
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.ordinal import placed
from readloom.functions.sha import Sha256, library
from readloom.operators import checksum
from readloom.plans import catalog


def test_a_state_is_taken_out_and_put_back():
    assert library(), "no library whose state can be taken out; checksums stream through the driver"
    rng = random.Random(5)
    for _ in range(50):
        parts = [rng.randbytes(rng.choice((0, 1, 55, 56, 63, 64, 65, 1000))) for _ in range(rng.randrange(6))]
        state = Sha256().state()
        for part in parts:
            hasher = Sha256(state)
            hasher.update(part)
            state = hasher.state()
        assert Sha256(state).hexdigest() == Sha256(state).hexdigest() == hashlib.sha256(b"".join(parts)).hexdigest()


def values(n):
    rng = random.Random(n)
    return [rng.randbytes(rng.choice((0, 1, 7, 64, 300))) for _ in range(n)]


def model(parts, before=None):
    start = b"" if before is None else checksum.framed(before)
    return hashlib.sha256(start + b"".join(map(checksum.framed, parts))).hexdigest()


@pytest.mark.parametrize(("block", "piece"), [(1 << 18, 1 << 26), (300, 1500)])
def test_streamed_digests_do_not_pass_values_to_the_driver(spark, monkeypatch, block, piece):
    monkeypatch.setattr(checksum, "BLOCK", block)
    monkeypatch.setattr(checksum, "PIECE", piece)

    def never(self, prefetchPartitions=False):  # noqa: N803
        raise AssertionError("rows come to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", never)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = values(60)
    rows = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(parts)], "at long, v binary").repartition(5).orderBy("at")
    assert checksum.stream_digest(rows, "v") == model(parts)
    assert checksum.stream_digest(rows, "v", b"head") == model(parts, b"head")
    assert checksum.stream_digest(rows.where("at < 0"), "v", b"head") == model([], b"head")
    assert checksum.stream_digest(rows.select("at", F.hex("v").alias("v")).orderBy("v"), "v") == model(sorted(v.hex().upper().encode() for v in parts))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == kept


def test_without_the_library_the_driver_hashes_the_same(spark, monkeypatch):
    monkeypatch.setattr(checksum, "library", lambda: None)
    monkeypatch.setattr(checksum, "BLOCK", 300)
    monkeypatch.setattr(checksum, "PIECE", 1500)
    parts = values(40)
    rows = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(parts)], "at long, v binary").repartition(3).orderBy("at")
    assert checksum.stream_digest(rows, "v", b"head") == model(parts, b"head")


def test_a_value_that_is_missing_is_an_error(spark):
    with pytest.raises(Exception, match="a record without bytes"):
        checksum.stream_digest(spark.createDataFrame([(None,)], "v binary"), "v")


@pytest.fixture
def apart(spark):
    """Small partitions stay apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, kept)


def test_no_task_of_a_coordinate_sort_has_all_rows(apart):
    rows = catalog.QUERIES["sort_coordinate"](apart, "/root/testdata/sf0.001")
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 1000 and max(sizes) < 600


def test_places_in_a_total_order(apart):
    rng = random.Random(2)
    rows = [(i, rng.choice((None, 0, 0, 0, 0, 7, -3)), rng.choice("ab")) for i in range(300)]
    df = apart.createDataFrame(rows, "ordinal long, k int, unused string").repartition(6)
    got = placed(df, [F.col("k"), F.col("ordinal").desc()], ["ordinal", "k"], "place")
    assert got.columns == ["ordinal", "k", "place"]
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [(i, k, n) for n, (i, k, _) in enumerate(want, 1)]
    assert placed(df.where("k > 9"), [F.col("ordinal")], ["ordinal"], "place").collect() == []
