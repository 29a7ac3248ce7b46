"""Validation: every rule is a filter over reads or a header relation that gives findings; findings are one union."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom import schema as S
from readloom.errors import ReadloomError
from readloom.functions import expr as E
from readloom.functions.kernels import aux_tags
from readloom.sources.bgzf import EOF_MARKER
from readloom.sources.header import parse_binary

#: What parsing a damaged header may raise.
HEADER_ERRORS = (ReadloomError, ValueError, IndexError, KeyError, struct.error)

#: (code, severity, condition) of record rules; conditions are SQL text over a reads row.
RECORD_RULES: tuple[tuple[str, str, str], ...] = (
    ("invalid_block_size", "error", "block_size < 32"),
    ("empty_read_name", "error", "read_name = ''"),
    ("control_character_in_read_name", "warning", r"read_name rlike '[\\x00-\\x1f\\x7f]'"),
    ("contradictory_mapping_state", "error", "(ref_id >= 0) = (flags & 4 <> 0)"),
    ("negative_position_for_mapped_record", "error", "flags & 4 = 0 AND pos < 0"),
    ("mate_position_inconsistency", "warning", "next_ref_id >= 0 AND next_pos < 0"),
    ("proper_pair_without_paired_flag", "warning", "flags & 2 <> 0 AND flags & 1 = 0"),
    ("read1_and_read2_both_set", "warning", "flags & 192 = 192"),
    ("secondary_and_supplementary_both_set", "warning", "flags & 2304 = 2304"),
    ("mapped_record_without_cigar", "warning", "flags & 4 = 0 AND n_cigar = 0"),
)


def record_findings(reads: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(severity, scope, code, record_index) of each broken record rule, 1-based; all rules in one pass over the reads."""
    rules = F.array(*[F.when(F.expr(condition), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for code, severity, condition in RECORD_RULES])
    found = reads.select("ordinal", F.explode(F.array_compact(rules)).alias("f"))
    return found.select("f.severity", F.lit("record").alias("scope"), "f.code", (F.col("ordinal") + 1).alias("record_index"))


def aux_findings(reads: DataFrame) -> DataFrame:
    """(severity, scope, code, record_index, tag) for each aux tag that its record had before. ``tags`` is an array of tag names."""
    again = F.expr("filter(transform(tags, (t, i) -> if(array_position(tags, t) <= i, t, null)), t -> t is not null)")
    repeated = reads.select((F.col("ordinal") + 1).alias("record_index"), F.explode(again).alias("tag"))
    return repeated.select(F.lit("warning").alias("severity"), F.lit("aux").alias("scope"), F.lit("duplicate_aux_tag").alias("code"), "record_index", "tag")


def _check_aux(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        repeated, malformed = [], []
        for raw in batch.column("aux_bytes").to_pylist():
            tags, problem = aux_tags(raw or b"")
            repeated.append([t for i, t in enumerate(tags) if t in tags[:i]] if len(set(tags)) < len(tags) else [])
            malformed.append(problem)
        columns = [*batch.columns, pa.array(repeated, pa.list_(pa.string())), pa.array(malformed, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "repeated", "malformed"])


def _entry(severity: str, scope: str, code: str, tag: Column | None = None) -> Column:
    values = {"severity": F.lit(severity), "scope": F.lit(scope), "code": F.lit(code), "tag": F.lit(None).cast("string") if tag is None else tag}
    return F.struct(*[v.alias(n) for n, v in values.items()])


def aux_region_findings(reads: DataFrame) -> DataFrame:
    """The findings of ``aux_findings`` and those on aux regions that can't be read to their end, from ``aux_bytes``."""
    checked = reads.select("ordinal", "aux_bytes").mapInArrow(_check_aux, "ordinal long, aux_bytes binary, repeated array<string>, malformed string")
    return _exploded(checked, [])


def body_findings(raw: DataFrame) -> DataFrame:
    """All findings on records in one pass over raw reads: (severity, scope, code, tag, record_index, place), in the order of rules; a record without a name couldn't be decoded."""
    names = raw.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.schema.fields)
    checked = raw.select(*names).mapInArrow(_check_aux, types + ", repeated array<string>, malformed string")
    rules = [F.when(F.expr(condition), _entry(severity, "record", code)) for code, severity, condition in RECORD_RULES]
    return _exploded(checked, [F.when(F.col("read_name").isNull(), _entry("error", "record", "invalid_record")), *rules])


def _exploded(checked: DataFrame, rules: list[Column]) -> DataFrame:
    again = F.transform("repeated", lambda t: _entry("warning", "aux", "duplicate_aux_tag", t))
    broken = F.when(F.col("malformed").isNotNull(), _entry("error", "aux", "malformed_aux_region"))
    entries = F.concat(F.array_compact(F.array(*rules)), again, F.array_compact(F.array(broken))) if rules else F.concat(again, F.array_compact(F.array(broken)))
    found = checked.select((F.col("ordinal") + 1).alias("record_index"), F.posexplode(entries).alias("place", "f"))
    return found.select("f.severity", "f.scope", "f.code", "f.tag", "record_index", "place")


def damage_findings(layout: DataFrame) -> DataFrame:
    """The first record that can't be read: (severity, scope, code, record_index), no row if all can.

    ``layout`` has, of each record, its ordinal, block_size, the bytes its fields
    take (fields_size) and those there are (available). Reading ends there.
    """
    code = (
        F.when(F.col("block_size") < 32, "invalid_record")
        .when(F.col("available") < F.col("block_size"), "truncated_record")
        .when(F.col("fields_size") > F.col("block_size"), "invalid_record")
    )
    first = layout.select("ordinal", code.alias("code")).where("code IS NOT NULL").agg(F.min(F.struct("ordinal", "code")).alias("f")).where("f IS NOT NULL")
    return first.select(F.lit("error").alias("severity"), F.lit("record").alias("scope"), "f.code", (F.col("f.ordinal") + 1).alias("record_index"))


def eof_findings(tails: DataFrame) -> DataFrame:
    """(severity, scope, code, source): whether each file, of which ``tail`` has the last bytes, ends in the end marker of blocked gzip."""
    there = F.substring("tail", -len(EOF_MARKER), len(EOF_MARKER)) == F.lit(EOF_MARKER)
    there = F.coalesce(there, F.lit(False))
    return tails.select(
        F.when(there, "info").otherwise("warning").alias("severity"),
        F.lit("file").alias("scope"),
        F.when(there, "bgzf_eof_present").otherwise("missing_bgzf_eof").alias("code"),
        "source",
    )


def _parse_headers(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        bad = []
        for source, raw in zip(batch.column("source").to_pylist(), batch.column("header").to_pylist(), strict=True):
            try:
                parse_binary(raw or b"")
            except HEADER_ERRORS:
                bad.append(source)
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["source"])


def header_parse_findings(headers: DataFrame) -> DataFrame:
    """(severity, scope, code, source) of files whose binary ``header`` can't be parsed."""
    bad = headers.select(F.col("source").cast("string").alias("source"), "header").mapInArrow(_parse_headers, "source string")
    return bad.select(F.lit("error").alias("severity"), F.lit("header").alias("scope"), F.lit("invalid_header").alias("code"), "source")


def header_findings(refs: DataFrame, sq: DataFrame, groups: DataFrame, programs: DataFrame) -> DataFrame:
    """(severity, scope, code, reference_name) of header rules; the last column holds the reference or the id at fault."""

    def rule(df: DataFrame, code: str, severity: str, name: Column) -> DataFrame:
        return df.select(F.lit(severity).alias("severity"), F.lit("header").alias("scope"), F.lit(code).alias("code"), name.alias("reference_name"))

    twice = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lengths = refs.join(sq.select("name", F.col("length").alias("text_length")), "name").where("length <> text_length")
    rules = [
        rule(refs.where("name = ''"), "empty_reference_name", "error", F.col("name")),
        rule(twice(refs, "name"), "duplicate_reference_name", "error", F.col("name")),
        rule(lengths, "reference_length_mismatch", "warning", F.col("name")),
        rule(sq.join(refs.select("name"), "name", "left_anti"), "textual_sq_not_in_binary_dictionary", "warning", F.col("name")),
        rule(twice(programs, "id"), "duplicate_program_id", "warning", F.col("id")),
        rule(twice(groups, "id"), "duplicate_read_group_id", "warning", F.col("id")),
    ]
    return reduce(DataFrame.unionByName, rules)


def capped(findings: DataFrame, max_errors: int = 100, max_warnings: int = 100) -> DataFrame:
    """The findings that a report stores: the first of each severity in record order. Counts are taken before this cap."""
    caps = F.when(F.col("severity") == "error", max_errors).otherwise(max_warnings)
    first = findings.where("severity = 'error'").orderBy("record_index", "code").limit(max_errors)
    second = findings.where("severity <> 'error'").orderBy("record_index", "code").limit(max_warnings)
    both = first.unionByName(second)
    rank = F.row_number().over(Window.partitionBy("severity").orderBy("record_index", "code"))
    return both.withColumn("rank", rank).where(F.col("rank") <= caps)


def finding_rollup(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("findings"))


def validity(reads: DataFrame, fail_fast: bool = False, record_limit: int | None = None) -> DataFrame:
    """One row: records examined, errors, warnings, valid. With fail_fast the scan counts as ended at the first record with an error."""
    source = reads if record_limit is None else reads.where(F.col("ordinal") < record_limit)
    errors = sum((F.when(F.expr(c), 1).otherwise(0) for _, s, c in RECORD_RULES if s == "error"), F.lit(0))
    warnings = sum((F.when(F.expr(c), 1).otherwise(0) for _, s, c in RECORD_RULES if s == "warning"), F.lit(0))
    marked = source.select("ordinal", errors.alias("e"), warnings.alias("w"))
    if fail_fast:
        first = marked.where("e > 0").agg(F.min("ordinal").alias("stop"))
        marked = marked.join(F.broadcast(first)).where("stop IS NULL OR ordinal <= stop")
    return marked.agg(
        F.count(F.lit(1)).alias("records_examined"), F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("warnings")
    ).withColumn("valid", F.col("errors") == 0)


def contradiction_kind() -> Column:
    return F.when((F.col("ref_id") >= 0) & E.flag(S.UNMAPPED), "placed_but_unmapped").when((F.col("ref_id") < 0) & ~E.flag(S.UNMAPPED), "mapped_but_unplaced")
