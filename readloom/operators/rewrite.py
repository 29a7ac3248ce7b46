"""Rewrites of reads and header relations, and bag unions of collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom import schema as S
from readloom.errors import ReadloomError
from readloom.functions import expr as E
from readloom.operators.order import sort_reads

# Aux tags that speak of an alignment and go when a record is unmapped.
MAPPING_TAGS = (
    "AM", "AS", "BQ", "CC", "CG", "CM", "CP", "H0", "H1", "H2", "HI", "IH", "MC", "MD", "MQ", "NH", "NM", "OA", "OC", "OP", "PQ", "SA", "SM", "UQ",
    "XS", "cm", "ms", "s1", "s2", "tp", "ts",
    "cg", "cs", "de", "dv", "nn", "rl", "zd",
)


def exclude_tags(aux: Column, tags: tuple[str, ...]) -> Column:
    """An aux array without the given tags."""
    return F.filter(aux, lambda a: ~a["tag"].isin(*tags)) if tags else aux


def unmap(reads: DataFrame, tags: tuple[str, ...] = MAPPING_TAGS) -> DataFrame:
    """Records without alignment: flags, places and mapping tags reset; secondary and supplementary bits stay."""
    flags = F.col("flags").bitwiseOR(S.UNMAPPED).bitwiseAND(F.lit(~(S.PROPER_PAIR | S.REVERSE | S.MATE_REVERSE)))
    flags = F.when(E.flag(S.PAIRED), flags.bitwiseOR(S.MATE_UNMAPPED)).otherwise(flags)
    changes = {"flags": flags.cast("int"), "ref_id": F.lit(-1), "pos": F.lit(-1), "next_ref_id": F.lit(-1), "next_pos": F.lit(-1), "tlen": F.lit(0), "mapq": F.lit(0), "bin": F.lit(S.UNMAPPED_BIN), "n_cigar": F.lit(0), "cigar": F.lit(b"")}
    out = reads.withColumns({c: v for c, v in changes.items() if c in reads.columns})
    if "aux" in reads.columns:
        out = out.withColumns({"aux": exclude_tags(F.col("aux"), tags), "tags_removed": F.size("aux") - F.size(exclude_tags(F.col("aux"), tags))})
    return out


def annotate_rg(reads: DataFrame, rg_id: str, mode: str = "fail-on-conflict") -> DataFrame:
    """Reads with ``rg`` set, and what was done to each: inserted, matching, replaced, kept or conflict.

    Records without a read group get one in every mode; those with another one
    are replaced, kept or in conflict by mode.
    """
    other = {"only-missing": "kept", "replace-existing": "replaced", "fail-on-conflict": "conflict"}
    if mode not in other:
        raise ReadloomError("invalid_argument", f"no such mode: {mode}")
    action = F.when(F.col("rg").isNull(), "inserted").when(F.col("rg") == rg_id, "matching").otherwise(other[mode])
    group = F.when(F.col("rg").isNull() | F.lit(mode == "replace-existing"), F.lit(rg_id)).otherwise(F.col("rg"))
    return reads.withColumns({"action": action, "rg": group})


def annotate_rg_counts(reads: DataFrame, rg_id: str, mode: str = "fail-on-conflict") -> DataFrame:
    done = annotate_rg(reads, rg_id, mode)
    return done.agg(F.count(F.lit(1)).alias("records_examined"), *[F.count_if(F.col("action") == a).alias(f"records_{a}") for a in ("inserted", "matching", "replaced", "kept", "conflict")])


def checked_annotate_rg(reads: DataFrame, rg_id: str, mode: str = "fail-on-conflict") -> DataFrame:
    """As ``annotate_rg``, but a conflict is an error before anything is written."""
    counts = annotate_rg_counts(reads, rg_id, mode).first()
    if counts["records_conflict"]:
        raise ReadloomError("read_group_conflict", f"{counts['records_conflict']} records carry another read group")
    return annotate_rg(reads, rg_id, mode)


def merge(inputs: list[DataFrame], sort: str | None = None) -> DataFrame:
    """Bag union in input order with ordinals that go on from input to input; sorted by coordinate on request."""
    if not inputs:
        raise ReadloomError("invalid_argument", "nothing to merge")
    numbered = [df.withColumn("file_no", F.lit(i)) for i, df in enumerate(inputs)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    sizes = union.groupBy("file_no").agg(F.max("ordinal").alias("last"))
    starts, at = {}, 0
    for r in sorted(sizes.collect(), key=lambda r: r["file_no"]):  # a row per input
        starts[r["file_no"]] = at
        at += r["last"] + 1
    shift = reduce(lambda c, kv: c.when(F.col("file_no") == kv[0], F.lit(kv[1])), starts.items(), F.when(F.lit(False), F.lit(0))).otherwise(0)
    merged = union.withColumn("ordinal", F.col("ordinal") + shift.cast("long"))
    return sort_reads(merged, sort) if sort else merged


def dictionary_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places at which two reference dictionaries differ in name or length, or one is shorter; none if they agree."""
    right = b.select(F.col("index"), F.col("name").alias("other_name"), F.col("length").alias("other_length"))
    joined = a.select("index", "name", "length").join(right, "index", "full_outer")
    return joined.where(~F.col("name").eqNullSafe(F.col("other_name")) | ~F.col("length").eqNullSafe(F.col("other_length")))


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations hold the same rows the same number of times."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def fastq_to_unmapped(fastq: DataFrame, read_group: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw reads as unmapped records, with further columns to keep. A quality of ``*`` or none is missing; sequence and quality must be of one length."""
    missing = F.col("quality").isNull() | (F.col("quality") == "*")
    return fastq.select(
        "source",
        "ordinal",
        F.col("read_name"),
        F.lit(-1).alias("ref_id"),
        F.lit(-1).alias("pos"),
        F.lit(0).alias("mapq"),
        F.lit(S.UNMAPPED).alias("flags"),
        F.lit(S.UNMAPPED_BIN).alias("bin"),
        F.length("sequence").alias("l_seq"),
        F.upper("sequence").alias("sequence"),
        F.when(~missing, F.col("quality")).alias("quality"),
        F.lit(read_group).cast("string").alias("rg"),
        *keep,
    )


def to_fastq_text(reads: DataFrame) -> DataFrame:
    """Four-line text of each record in encounter order; missing qualities are written as ``!``."""
    quality = F.coalesce(F.col("quality"), F.repeat(F.lit("!"), F.length("sequence")))
    return reads.select("ordinal", F.concat(F.lit("@"), F.col("read_name"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), quality, F.lit("\n")).alias("record"))


# implicit joins of header relations


def refs_left_sq(refs: DataFrame, sq: DataFrame) -> DataFrame:
    """Binary references with the header text's length where that differs."""
    text = sq.select("name", F.col("length").alias("text_length"))
    return refs.join(text, "name", "left").select("index", "name", "length", F.when(F.col("text_length") != F.col("length"), F.col("text_length")).alias("text_header_length"))


def sq_anti_refs(sq: DataFrame, refs: DataFrame) -> DataFrame:
    return sq.join(refs.select("name"), "name", "left_anti")


def undeclared_read_groups(reads: DataFrame, groups: DataFrame) -> DataFrame:
    used = reads.where("rg IS NOT NULL").select(F.col("rg").alias("id")).distinct()
    return used.join(groups.select("id"), "id", "left_anti")


def broken_parents(programs: DataFrame) -> DataFrame:
    """Programs whose parent isn't declared."""
    child = programs.where("previous_program_id IS NOT NULL")
    ids = programs.select(F.col("id").alias("previous_program_id")).distinct()
    return child.join(ids, "previous_program_id", "left_anti").select("id", "previous_program_id")


def program_roots(programs: DataFrame) -> DataFrame:
    """Programs without a resolvable parent; more than one means disconnected chains."""
    ids = programs.select(F.col("id").alias("previous_program_id")).distinct()
    return programs.join(ids, "previous_program_id", "left_anti").select("id")


def duplicate_ids(header: DataFrame) -> DataFrame:
    return header.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sample_platforms(groups: DataFrame) -> DataFrame:
    """Samples that claim several platforms, with the platforms in order."""
    sets = groups.where("sample IS NOT NULL AND platform IS NOT NULL").groupBy("sample").agg(F.array_sort(F.collect_set("platform")).alias("p"))
    return sets.where(F.size("p") > 1).select("sample", F.array_join("p", ",").alias("platforms"))
