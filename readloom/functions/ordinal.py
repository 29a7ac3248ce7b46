"""Encounter order without a single-partition window: rows are worked on in ranges of their order, and ranges are stitched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions.shared import Scratch

#: Ordinals of a range; a window never holds more rows than this (as keys are unique).
WIDTH = 1 << 16


def with_ordinal(df: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """Add ``ordinal``, the 0-based rank by a unique integer key."""
    part = F.floor(F.col(key) / width).alias("__part")
    ahead = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = df.groupBy(part).agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(ahead, F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return df.withColumn("__part", F.floor(F.col(key) / width)).withColumn("__local", local).join(starts, "__part").withColumn("ordinal", F.col("__start") + F.col("__local")).drop("__part", "__local", "__start")


def previous(df: DataFrame, columns: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Add columns with the values of expressions on the row before; null on the first. Only the last row of each range meets the next range's first."""
    df = df.withColumn("__part", F.floor(F.col("ordinal") / width))
    order = Window.partitionBy("__part").orderBy("ordinal")
    inside = df.select("*", *[F.lag(e).over(order).alias(f"__in_{n}") for n, e in columns.items()])
    edges = df.where(F.col("ordinal") % width == width - 1).select((F.col("__part") + 1).alias("__part"), *[e.alias(f"__edge_{n}") for n, e in columns.items()])
    joined = inside.join(edges, "__part", "left")
    first = F.col("ordinal") % width == 0
    return joined.select(*[c for c in df.columns if c != "__part"], *[F.when(first, F.col(f"__edge_{n}")).otherwise(F.col(f"__in_{n}")).alias(n) for n in columns])


def running_sum(df: DataFrame, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """Add the inclusive running sum of an expression along ``ordinal``: sums inside ranges, plus those of the ranges before."""
    df = df.withColumn("__part", F.floor(F.col("ordinal") / width)).withColumn("__value", value)
    inside = F.sum("__value").over(Window.partitionBy("__part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = df.groupBy("__part").agg(F.sum("__value").alias("__sum")).select("__part", F.coalesce(ahead, F.lit(0)).alias("__start"))
    return df.withColumn("__inside", inside).join(starts, "__part").withColumn(name, F.col("__start") + F.col("__inside")).drop("__part", "__value", "__inside", "__start")


def placed(df: DataFrame, keys: list[Column], columns: list[str], name: str) -> DataFrame:
    """Some columns and ``name``, the 1-based place of each row in a total order.

    Tasks sort a range each, number its rows and write them; a row's place is its number plus the rows of the ranges
    before. Sorting again could cut other ranges, so the counts and the rows are of the same written table.
    """
    at = F.monotonically_increasing_id()  # the task in the upper bits, from the 34th, the row in the lower
    rows = Scratch(df.sparkSession, "placed").table(df.orderBy(*keys).select(*columns, at.alias("__at")), "rows")
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    ahead = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(ahead, F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__part").select(*columns, (F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias(name))
