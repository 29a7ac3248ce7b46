"""Profiles of a reads relation: counts, fractions, mapping quality, mapping by reference. One aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import schema as S
from readloom.functions import expr as E


def flag_decode(reads: DataFrame) -> DataFrame:
    return reads.select("ordinal", *[E.flag(bit).alias(name) for name, bit in E.FLAG_NAMES.items()])


def mapped_only(reads: DataFrame) -> DataFrame:
    return reads.where(E.is_mapped())


def primary_only(reads: DataFrame) -> DataFrame:
    return reads.where(E.is_primary())


def contradictory(reads: DataFrame) -> DataFrame:
    return reads.where(E.is_contradictory())


def bounded(reads: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` records in encounter order; all of them for None. The filter reaches the source."""
    return reads if limit is None else reads.where(F.col("ordinal") < limit)


def reached_end(total: int, limit: int | None) -> bool:
    """Whether a scan saw the end: a scan that stops at exactly the last record did not."""
    return limit is None or total < limit


def _count(where: Column, name: str) -> Column:
    return F.count_if(where).alias(name)


def count_columns() -> list[Column]:
    """Aggregates of the record counts; a record that is both secondary and supplementary counts as secondary."""
    secondary, supplementary = E.flag(S.SECONDARY), E.flag(S.SUPPLEMENTARY)
    kinds = {
        "examined": F.lit(True),
        "mapped": E.is_mapped(),
        "unmapped": ~E.is_mapped(),
        "secondary": secondary,
        "supplementary": ~secondary & supplementary,
        "primary": ~secondary & ~supplementary,
        "duplicate": E.flag(S.DUPLICATE),
        "qc_fail": E.flag(S.QC_FAIL),
        "paired": E.flag(S.PAIRED),
        "properly_paired": E.flag(S.PROPER_PAIR),
        "read1": E.flag(S.READ1),
        "read2": E.flag(S.READ2),
        "reverse_strand": E.flag(S.REVERSE),
        "contradictory": E.is_contradictory(),
    }
    names = {"examined": "records_examined"}
    return [_count(where, names.get(kind, f"{kind}_records")) for kind, where in kinds.items()]


def summary_counts(reads: DataFrame) -> DataFrame:
    """Record counts."""
    return reads.agg(*count_columns())


#: Counts that a summary shows as flag categories.
FLAG_CATEGORIES = ("paired", "properly_paired", "read1", "read2", "reverse_strand")
FRACTIONS = ("mapped", "primary", "secondary", "supplementary", "duplicate", "qc_fail")


def summary_fractions(reads: DataFrame) -> DataFrame:
    """Shares of the examined records; null where none were."""
    counts = summary_counts(reads)
    return counts.select(*[E.fraction(F.col(f"{n}_records"), F.col("records_examined")).alias(f"{n}_fraction") for n in FRACTIONS])


def mapq_columns() -> list[Column]:
    return [
        F.min("mapq").alias("mapq_min"),
        F.max("mapq").alias("mapq_max"),
        E.fraction(F.sum(F.col("mapq").cast("long")), F.count(F.lit(1))).alias("mapq_mean"),
        F.count_if(F.col("mapq") == 0).alias("mapq_zero_count"),
    ]


def mapq_stats(reads: DataFrame) -> DataFrame:
    return reads.agg(*mapq_columns())


def mapq_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy("mapq").agg(F.count(F.lit(1)).alias("records"))


def refs_with_mapped(reads: DataFrame) -> DataFrame:
    return reads.where(E.is_mapped()).agg(F.count_distinct("ref_id").alias("references_with_mapped_reads"))


def summary(reads: DataFrame, limit: int | None, references: int) -> DataFrame:
    """The whole summary in one row: mode, counts, fractions, mapping status and confidence, in one aggregation over the scanned records.

    A scan that ends at its limit hasn't seen the end, even if no record follows.
    """
    stopped = F.lit(False) if limit is None else F.count(F.lit(1)) >= limit
    one = bounded(reads, limit).agg(*count_columns(), *mapq_columns(), F.count_distinct(F.when(E.is_mapped(), F.col("ref_id"))).alias("references_with_mapped_reads"), stopped.alias("bounded"))
    names = [c for c in one.columns if c.startswith("records_") or c.endswith("_records")]
    status = F.when(F.col("records_examined") == 0, "indeterminate").when(F.col("mapped_records") > 0, "mapped").otherwise("unmapped")
    confidence = F.when(F.col("records_examined") == 0, "low").when(F.col("bounded"), "medium").otherwise("high")
    shares = [E.fraction(F.col(f"{n}_records"), F.col("records_examined")).alias(f"{n}_fraction") for n in FRACTIONS]
    return one.select(
        F.when(F.col("bounded"), "bounded_scan").otherwise("full_scan").alias("mode"),
        F.lit(references).cast("long").alias("references_defined"),
        *[F.col(c) for c in names],
        F.when(~F.col("bounded"), F.col("records_examined")).alias("records_total_known"),
        *shares,
        "mapq_min",
        "mapq_max",
        "mapq_mean",
        "mapq_zero_count",
        "references_with_mapped_reads",
        status.alias("mapping_status"),
        confidence.alias("confidence"),
    )


def refs_counts(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """Mapped and placed-unmapped records of every reference, zero where there are none."""
    counts = reads.where("ref_id >= 0").groupBy("ref_id").agg(F.count_if(E.is_mapped()).alias("mapped"), F.count_if(E.flag(S.UNMAPPED)).alias("placed_unmapped"))
    joined = refs.join(counts, refs["index"] == counts["ref_id"], "left")
    return joined.select("index", "name", "length", F.coalesce("mapped", F.lit(0)).alias("mapped_reads"), F.coalesce("placed_unmapped", F.lit(0)).alias("unmapped_reads"))


def check_map(reads: DataFrame, limit: int | None) -> DataFrame:
    """Mapping status of the scanned records and how sure it is; contradictory records lower the confidence."""
    source = bounded(reads, limit)
    seen_end = F.lit(True) if limit is None else F.count_if(F.col("ordinal") >= limit - 1) == 0
    one = source.agg(
        F.count(F.lit(1)).alias("records_examined"),
        _count(E.is_mapped(), "mapped_records_observed"),
        _count(~E.is_mapped(), "unmapped_records_observed"),
        _count(E.is_contradictory(), "inconsistent_records_observed"),
        F.count_distinct(F.when(E.is_mapped(), F.col("ref_id"))).alias("references_with_mapped_reads_observed"),
        seen_end.alias("reached_end"),
    )
    none, mapped, clean = F.col("records_examined") == 0, F.col("mapped_records_observed") > 0, F.col("inconsistent_records_observed") == 0
    return one.select(
        "*",
        F.when(none, "indeterminate").when(mapped, "mapped").otherwise("unmapped").alias("mapping_status"),
        F.when(none | ~clean, "low").when(mapped | ~F.col("reached_end"), "medium").otherwise("high").alias("confidence"),
    )


def enumerate_records(reads: DataFrame) -> DataFrame:
    return reads.groupBy("source").agg(F.count(F.lit(1)).alias("records"))


def read_ref_name(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """Reads with their reference's name; null where there is none. The reference dictionary holds a million names at most and is left to the optimizer."""
    return reads.join(refs.select(F.col("index").alias("ref_id"), F.col("name").alias("reference_name")), "ref_id", "left")


def check_tag(reads: DataFrame, tag: str, limit: int | None, kind: str | None = None, count_hits: bool = False) -> DataFrame:
    """Whether an aux tag occurs. Without counting, the scan is reported as ending at the first hit.

    ``reads`` has ``aux``, an array of structs with tag and type.
    """
    hit = F.exists("aux", lambda a: (a["tag"] == tag) & (F.lit(True) if kind is None else a["type"] == kind))
    source = bounded(reads, limit)
    one = source.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(hit, F.col("ordinal"))).alias("first"), F.count_if(hit).alias("hits"))
    complete = F.lit(limit is None) | (F.col("n") < F.lit(limit if limit is not None else 0))
    early = F.lit(not count_hits) & F.col("first").isNotNull()
    return one.select(
        F.lit(tag).alias("tag"),
        F.when(F.col("first").isNotNull(), "observed_present").when(F.col("n") == 0, "indeterminate").when(complete, "absent_in_full_scan").otherwise("not_found_in_examined_records").alias("result"),
        F.when(early, F.col("first") + 1).otherwise(F.col("n")).alias("records_examined"),
        F.when(early, F.lit(1)).otherwise(F.col("hits")).cast("long").alias("records_with_tag"),
    )
