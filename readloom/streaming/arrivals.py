"""An extension: running read counts over FASTQ text that arrives as files. The batch operators don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving_records(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, records, bases) per arriving plain-text FASTQ file; whole files are read, so each should be of moderate size."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    lines = F.split(F.rtrim(F.col("value")), "\n")
    sequences = F.filter(lines, lambda _, i: i % 4 == 1)
    bases = F.aggregate(sequences, F.lit(0).cast("long"), lambda total, s: total + F.length(s))
    return files.select(F.col("_metadata.file_path").alias("path"), F.size(sequences).cast("long").alias("records"), bases.alias("bases"))


def running_counts(records: DataFrame) -> DataFrame:
    """Totals over everything that has arrived; use output mode ``complete``."""
    return records.groupBy().agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.sum("bases").alias("bases"))
