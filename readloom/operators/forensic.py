"""Provenance findings over headers and records: each rule is a small DataFrame; findings are ordered, capped and assessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import duplicates, order, rewrite

FINDING = "category string, severity string, confidence string, evidence_strength string, message string"
SCOPES = ("header", "rg", "pg", "readnames", "tags", "duplication")


def _rule(df: DataFrame, category: str, severity: str, confidence: str, strength: str, message) -> DataFrame:
    fixed = {"category": category, "severity": severity, "confidence": confidence, "evidence_strength": strength}
    return df.select(*[F.lit(v).alias(n) for n, v in fixed.items()], message.cast("string").alias("message"))


def header_rules(groups: DataFrame, comments: int = 0, programs: DataFrame | None = None) -> list[DataFrame]:
    twice = rewrite.duplicate_ids(groups)
    missing = groups.where("id IS NULL").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    several = rewrite.sample_platforms(groups)
    rules = [
        _rule(twice, "header_anomaly", "high", "high", "strong", F.concat(F.lit("Read group declared more than once: "), "id")),
        _rule(missing, "header_anomaly", "warning", "high", "moderate", F.concat(F.col("n").cast("string"), F.lit(" read groups have no ID"))),
        _rule(several, "header_anomaly", "warning", "medium", "moderate", F.concat(F.lit("Sample on several platforms: "), "sample", F.lit(" ("), "platforms", F.lit(")"))),
    ]
    if programs is not None and comments == 0:
        n = groups.agg(F.count(F.lit(1)).alias("g")).join(programs.agg(F.count(F.lit(1)).alias("p")))
        rules.append(_rule(n.where("g = 0 AND p = 0"), "header_anomaly", "info", "low", "limited", F.lit("The header has no read groups, programs or comments")))
    return rules


def program_rules(programs: DataFrame) -> list[DataFrame]:
    missing = programs.where("id IS NULL").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    roots = rewrite.program_roots(programs).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return [
        _rule(rewrite.duplicate_ids(programs), "program_chain_anomaly", "high", "high", "strong", F.concat(F.lit("Program declared more than once: "), "id")),
        _rule(missing, "program_chain_anomaly", "warning", "high", "moderate", F.concat(F.col("n").cast("string"), F.lit(" programs have no ID"))),
        _rule(rewrite.broken_parents(programs), "program_chain_anomaly", "warning", "high", "strong", F.concat(F.lit("Parent of "), "id", F.lit(" isn't declared: "), "previous_program_id")),
        _rule(roots, "program_chain_anomaly", "warning", "medium", "moderate", F.concat(F.lit("Program chains are not connected; roots: "), F.col("n").cast("string"))),
    ]


def body_rules(reads: DataFrame, groups: DataFrame) -> list[DataFrame]:
    missing = reads.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rg").isNull()).alias("none")).where("none >= 0.1 * n AND none < n AND n > 0")
    return [
        _rule(rewrite.undeclared_read_groups(reads, groups), "read_group_anomaly", "high", "high", "strong", F.concat(F.lit("Records name an undeclared read group: "), "id")),
        _rule(missing, "read_group_anomaly", "warning", "medium", "moderate", F.concat(F.col("none").cast("string"), F.lit(" records have no read group while others do"))),
        _rule(order.rg_boundary(reads), "ordering_anomaly", "warning", "medium", "moderate", F.concat(F.lit("Read group changes from "), "first_label", F.lit(" to "), "second_label", F.lit(" at record "), (F.col("boundary_ordinal") + 1).cast("string"))),
    ]


def name_rules(reads: DataFrame) -> list[DataFrame]:
    return [_rule(order.readname_regime(reads), "read_name_regime_shift", "high", "medium", "moderate", F.concat(F.lit("Read names change from "), "start_style", F.lit(" to "), "end_style"))]


def tag_rules(reads: DataFrame) -> list[DataFrame]:
    return [_rule(order.tag_schema_shift(reads), "tag_schema_anomaly", "warning", "medium", "moderate", F.concat(F.lit("Prevalent tags change from ["), "start_prevalent", F.lit("] to ["), "end_prevalent", F.lit("]")))]


def block_rules(reads: DataFrame, min_block: int = 10) -> list[DataFrame]:
    blocks = duplicates.adjacent_blocks(reads, min_block)
    table = reads.sparkSession.createDataFrame(blocks, "first long, second long, records long")
    return [_rule(table, "duplicate_block_hallmark", "high", "high", "strong", F.concat(F.lit("Block of "), F.col("records").cast("string"), F.lit(" records repeats at record "), (F.col("second") + 1).cast("string")))]


_RANK = {"severity": ("high", "warning", "info"), "confidence": ("high", "medium", "low"), "evidence_strength": ("strong", "moderate", "limited")}


def ordered(findings: DataFrame, limit: int) -> DataFrame:
    """Findings by severity, confidence, evidence, category and message, cut at ``limit``."""
    ranks = [F.array_position(F.array(*map(F.lit, values)), F.col(name)) for name, values in _RANK.items()]
    return findings.orderBy(*ranks, "category", "message").limit(limit)


def forensic_findings(reads: DataFrame | None, groups: DataFrame, programs: DataFrame, scopes: tuple[str, ...] = SCOPES, comments: int = 0, max_findings: int = 25) -> DataFrame:
    """All findings of the scopes asked for. Without reads only headers are looked at."""
    rules: list[DataFrame] = []
    if "header" in scopes:
        rules += header_rules(groups, comments, programs)
    if "pg" in scopes:
        rules += program_rules(programs)
    if reads is not None:
        if "rg" in scopes:
            rules += body_rules(reads, groups)
        if "readnames" in scopes:
            rules += name_rules(reads)
        if "tags" in scopes:
            rules += tag_rules(reads)
        if "duplication" in scopes:
            rules += block_rules(reads)
    return ordered(reduce(DataFrame.unionByName, rules), max_findings)


def assessment(findings: DataFrame, full_scan: bool, body: bool) -> DataFrame:
    """One row: whether anything is suspicious, and whether concatenation is likely (null where a bounded scan can't tell).

    It is computed over the findings that the cap left.
    """
    strong = (F.col("severity") == "high") & F.col("category").isin("concatenation_hallmark", "duplicate_block_hallmark", "read_name_regime_shift", "ordering_anomaly")
    one = findings.agg(F.count(F.lit(1)).alias("findings"), F.count_if(strong).alias("strong"))
    likely = F.when(F.col("strong") > 0, True).when(F.lit(full_scan) & ((F.col("findings") > 0) | F.lit(body)), False)
    return one.select("findings", (F.col("findings") > 0).alias("suspicion_detected"), likely.alias("likely_concatenation_or_coercion"))
