"""Tables written once to the folder that the driver and all executors share, and read back."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that pass to Python at a time while tables are written; texts may be long.
BATCH_ROWS = 2000

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where the cluster names one; a local folder of
    our own serves only where that is unset and all runs in one process, as in tests.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="readloom-")
        atexit.register(_remove_local, _local_root)
    return _local_root


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_scratch() -> None:
    """When the driver ends, its scratch folders go, as far as its session still runs."""
    for spark, base in _made:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                remove(spark, base)


class Scratch:
    """Intermediate tables of one query, each written once to the shared folder and read back.

    They stay until the driver ends, since results are read from them.

    A written table cuts lineage: a lost executor makes later stages reread files
    rather than recompute everything that came before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _made.append((spark, self.base))

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(BATCH_ROWS))
        try:
            writer.parquet(self.path(name))
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Let go of what finished steps left behind: shuffle files and broadcasts go when the driver's garbage is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        remove(self.spark, self.path(name))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
