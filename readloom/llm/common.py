"""Session helpers shared by the corpus operators: small files in the shared folder, skew-safe joins, table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.shared import BATCH_ROWS, Scratch, remove, shared_root  # noqa: F401

#: ASCII white space, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"

def small_batches(spark: SparkSession) -> None:
    """Let frames that are written later pass texts to Python ``BATCH_ROWS`` rows at a time as well, for the rest of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_note(spark: SparkSession, path: str) -> str | None:
    """The text of a small file in a shared folder; None where there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file to a shared folder; an existing one is an error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def is_empty_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not files.exists(target) or len(files.listStatus(target)) == 0


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, slots: int = 2000) -> DataFrame:
    """Inner join of rows to one row per key, when a few keys may own most of the rows.

    A key that holds more than ``total / slots`` rows is hot. There can be no more
    than ``slots`` of them whatever the input, so their side is broadcast; the
    rest meet in a shuffled join in which no key exceeds ``total / slots`` rows.
    Both inputs should be written tables, as they are read twice. Keys that are
    null meet nothing.
    """
    floor = max(total // slots, 1)
    hot = F.broadcast(groups.where(F.col(count) > floor))
    cold = groups.where(F.col(count) <= floor)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold.hint("merge"), keys))
