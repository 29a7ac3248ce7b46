"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

New rows are digested, reduced to one row per digest, compared with the index by a
sort-merge anti-join that shuffles only the new side, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, is_empty_folder, join_groups, read_note, shared_root, shuffle_partitions, unused, write_note


def text_digest(text: Column) -> Column:
    """SHA-256, as 32 bytes, of the text with each run of ASCII white space made one space; null counts as empty."""
    normal = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")
    return F.unhex(F.sha2(normal, 256))


class DigestIndex:
    """A table (digest, keep_id), bucketed and sorted by digest, that outlives the session that made it.

    Files lie under ``path``; opening the same path again registers them anew. The
    number of buckets is fixed when the index is made and noted beside the files,
    since appended ones must agree with those there: an index that is opened again
    has the buckets it was made with, whatever the session's partitions, and asking
    for another number is an error, as is a folder with files but no note.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT"
    NOTE = "_buckets"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{shared_root(spark)}/digest-index-{uuid.uuid4().hex[:12]}"
        noted = read_note(spark, f"{self.path}/{self.NOTE}")
        if noted is None:
            if not is_empty_folder(spark, self.path):
                raise ValueError(f"{self.path} holds files but not how many buckets they are in")
            self.buckets = buckets or shuffle_partitions(spark)
            write_note(spark, f"{self.path}/{self.NOTE}", str(self.buckets))
        else:
            self.buckets = int(noted)
            if buckets not in (None, self.buckets):
                raise ValueError(f"{self.path} has {self.buckets} buckets, not {buckets}")
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} ({self.SCHEMA}) USING parquet OPTIONS (path '{self.path}') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add digests that the index doesn't hold yet; those that it holds keep their row."""
        fresh = groups.select("digest", "keep_id").join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.repartition(self.buckets, "digest")
        fresh.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)


def digest_groups(digests: DataFrame) -> DataFrame:
    """One row per digest: the smallest doc_id and the number of rows. Counts are taken before the shuffle too, so a hot digest moves as one row a task."""
    return digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def batches_by_id(digests: DataFrame, batches: int) -> list[DataFrame]:
    """The rows as they would arrive: consecutive ranges of doc_id of about equal numbers of rows; null ids come last."""
    cuts = digests.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        where = F.lit(True)
        if low is not None:
            where &= (F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low
        if high is not None:
            where &= F.col("doc_id") <= high
        out.append(digests.where(where))
    return out


def ingest(index: DigestIndex, digests: DataFrame, scratch: Scratch, name: str) -> None:
    """Deduplicate a batch of (doc_id, digest) within itself and against the index, and append what is new.

    The groups are written first: otherwise the optimizer moves the anti-join below
    the aggregation, and every row of a hot digest would be shuffled.
    """
    index.append(scratch.table(digest_groups(digests), name))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents pass into the index in ``batches`` ranges of ascending doc_id, so
    that of equal texts the smallest doc_id gets the index row. With an index
    that already holds earlier documents, those stay and new copies go.

    Null texts count as empty; empty texts are copies of each other. Rows that
    repeat the smallest doc_id of their group are all reported as kept. A group
    whose ids are all null has a null keep_id, and its rows count as kept. An
    empty table gives no rows. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    digests = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest")), "digests")
    index = index or DigestIndex(spark, scratch.path("index"))
    for i, batch in enumerate(batches_by_id(digests, batches)):
        ingest(index, batch, scratch, f"groups-{i}")
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = scratch.table(sizes.join(index.read().hint("merge"), "digest"), "groups")
    total = digests.count()
    found = join_groups(digests, groups, ["digest"], "group_size", total)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents without all but the smallest doc_id of equal texts, with the columns of ``docs`` whatever their names.

    Rows that repeat both doc_id and text are kept once. Null ids count as one id.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    id_, digest = unused(docs, "id"), unused(docs, "digest")
    plain = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    report = exact_duplicates(docs, index)
    kept = scratch.table(report.where("kept").select(plain.alias(id_), F.unhex("text_sha256").alias(digest)).distinct(), "kept")
    marked = docs.withColumns({id_: plain, digest: text_digest(F.col("text"))})
    # one key names one row here, but for whole repeated rows
    return marked.join(kept.hint("merge"), [id_, digest], "left_semi").dropDuplicates([id_, digest]).select(*docs.columns)
