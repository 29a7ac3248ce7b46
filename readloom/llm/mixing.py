"""Mix sources to target weights by fitting token budgets exactly.

Documents are counted by source and exact length. Each source takes every document
a whole number of times, then fills what is left of its budget by a bounded-knapsack
dynamic program over the length counts, and seeded documents of each length are
selected to match.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Scratch, join_groups, unused

#: Remaining budget that the dynamic program fits; above it, counts are taken in proportion.
DP_BUDGET = 1 << 17
#: Ranges of the selection hash; a group's rows are ranked within ranges, so no task ranks a whole group.
RANGES = 4096
#: Stands for a null source inside the operator.
_NULL = "\0null"


def water_fill(sizes: list[float], weights: list[float], share: float, limit: float) -> list[float]:
    """Targets in proportion to weights that sum to share x all sizes, none above limit x its own size; the excess is shared anew by weight."""
    left = share * sum(sizes)
    target = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > limit * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = limit * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the lengths sum to the budget, or as near below it as can be found.

    Counts are taken in proportion first, the longest lengths that still fit next,
    and a subset-sum table over bounded counts (binary-split multiplicities) fits
    the last ``DP_BUDGET`` exactly.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    keep_back = DP_BUDGET // 2
    part = max(budget - keep_back, 0)
    take = np.array([int(c) * part // total for c in counts.tolist()], np.int64)
    left = budget - int((take * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        spare = left - keep_back
        if spare <= 0:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - take[i]), spare // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    left_counts = counts - take
    parent = np.full(left + 1, -1, np.int64)
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in order:
        length, spare = int(lengths[i]), int(left_counts[i])
        if length <= 0 or length > left:
            continue
        spare, step = min(spare, left // length), 1
        while spare > 0:
            many = min(step, spare)
            weight = length * many
            fresh = reach[: left + 1 - weight] & ~reach[weight:]
            if fresh.any():
                parent[weight:][fresh] = len(items)
                reach[weight:] |= fresh
                items.append((int(i), many))
            spare -= many
            step *= 2
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        i, many = items[parent[at]]
        take[i] += many
        at -= many * int(lengths[i])
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source: the number of times that all documents are taken, and of how many of each length one more is."""
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = min(int(target // source_size), 2) if source_size else 0
    rest = int(round(target - whole * source_size)) if source_size else 0
    extra = fit_budget(lengths, counts, rest) if whole < 2 else np.zeros(len(lengths), np.int64)
    return pd.DataFrame({"source": pdf["source"], "size": lengths, "source_size": source_size, "target": target, "whole": whole, "extra": extra, "n": counts})


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Size is the number of words between ASCII white space; a null text has 0.
    Sources in order of code points, null last, weigh ``weights`` in turn; their
    targets come to ``share`` times all sizes, none above ``limit`` (1 or 2) times
    its source. ``taken`` is size times 0, 1 or 2. The selection depends on the
    seed, doc_id (of rows without one, the text) and size alone, so reruns agree. Documents of size 0 take no
    part; a table of such documents has targets of 0, an empty one gives no rows.
    Repeated rows are separate documents; ties between them are equal in every
    column of the result.

    One row per source reaches the driver (its total size); nothing per document
    or per length does.
    """
    return _mixed(docs, weights, share, limit, seed).select("doc_id", "size", "source_size", "target", "taken")


def _mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: int = 2, seed: int = 17) -> DataFrame:
    """The rows of ``mix`` with a hash of the text, the source, and how many times the document is taken."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")
    id_, mark = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    spread = F.xxhash64(F.lit(seed), F.when(id_.isNull(), mark).otherwise(id_))
    sized = scratch.table(
        docs.select(
            id_.alias("doc_id"),
            mark.alias("mark"),
            F.coalesce(F.col("source").cast("string"), F.lit(_NULL)).alias("source"),
            words.alias("size"),
            spread.alias("spread"),
            F.pmod(spread, F.lit(RANGES)).cast("int").alias("part"),
        ),
        "sized",
    )
    cells = scratch.table(sized.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n_part")), "cells")
    lengths = scratch.table(cells.groupBy("source", "size").agg(F.sum("n_part").alias("n")), "lengths")
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")).collect()
    totals.sort(key=lambda r: (r["source"] == _NULL, r["source"].encode()))
    targets = water_fill([float(r["source_size"]) for r in totals], [float(weights[i % len(weights)]) for i in range(len(totals))], share, float(limit))
    table = spark.createDataFrame([(r["source"], int(r["source_size"]), t) for r, t in zip(totals, targets, strict=True)], "source string, source_size long, target double")
    plan = (
        lengths.join(table, "source")
        .groupBy("source")
        .applyInPandas(_plan, "source string, size long, source_size long, target double, whole long, extra long, n long")
    )
    plan = scratch.table(plan, "plan")
    # where in the ranges of the selection hash each length's number is reached
    ahead = F.sum("n_part").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    cut = plan.join(cells, ["source", "size"]).where((F.col("ahead") <= F.col("extra")) & (F.col("extra") < F.col("ahead") + F.col("n_part")))
    cut = cut.select("source", "size", F.col("part").alias("cut_part"), (F.col("extra") - F.col("ahead")).alias("in_part"))
    plan = scratch.table(plan.join(cut, ["source", "size"], "left"), "cuts")
    rows = join_groups(sized, plan, ["source", "size"], "n", sum(int(r["rows"]) for r in totals))
    all_ = F.col("cut_part").isNull() & (F.col("extra") > 0)
    sure = rows.where(~F.col("part").eqNullSafe(F.col("cut_part"))).withColumn("more", F.when(all_ | (F.col("part") < F.col("cut_part")), 1).otherwise(0))
    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("spread", "doc_id", "mark"))
    edge = rows.where(F.col("part").eqNullSafe(F.col("cut_part"))).withColumn("more", F.when(place <= F.col("in_part"), 1).otherwise(0))
    times = F.col("whole") + F.col("more")
    every = sure.unionByName(edge).withColumn("times", F.when(F.col("size") > 0, times).otherwise(0).cast("long"))
    return every.select("doc_id", "mark", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns of ``docs`` whatever their names, each as often as it is taken.

    Documents of no words, of which the mix takes nothing, are left out; rows with a
    null doc_id are documents as others are. Rows that agree in doc_id, text and
    source come as often as all of them are taken together, with the other columns
    of one of them. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    names = [unused(docs, n) for n in ("id", "mark", "origin", "times", "copy")]
    id_, mark, origin, times, copy = names
    plain = {id_: F.col("doc_id").cast("long"), mark: F.xxhash64(F.col("text").cast("string")), origin: F.coalesce(F.col("source").cast("string"), F.lit(_NULL))}
    least = F.lit(-(1 << 63))
    chosen = _mixed(docs, **options).where("times > 0").groupBy(F.coalesce("doc_id", least).alias(id_), F.col("mark").alias(mark), F.col("source").alias(origin)).agg(F.sum("times").alias(times))
    chosen = scratch.table(chosen, "chosen")
    rows = docs.withColumns(plain | {id_: F.coalesce(plain[id_], least)}).join(chosen.hint("merge"), [id_, mark, origin]).dropDuplicates([id_, mark, origin])
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
