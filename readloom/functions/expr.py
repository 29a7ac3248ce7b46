"""Column expressions over reads; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom import schema as S

FLAG_NAMES = {
    "is_paired": S.PAIRED,
    "is_proper_pair": S.PROPER_PAIR,
    "is_unmapped": S.UNMAPPED,
    "is_reverse": S.REVERSE,
    "is_read1": S.READ1,
    "is_read2": S.READ2,
    "is_secondary": S.SECONDARY,
    "is_qc_fail": S.QC_FAIL,
    "is_duplicate": S.DUPLICATE,
    "is_supplementary": S.SUPPLEMENTARY,
}


def flag(bit: int, flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(bit) != 0


def is_mapped() -> Column:
    """Placed on a reference and not flagged as unmapped."""
    return (F.col("ref_id") >= 0) & ~flag(S.UNMAPPED)


def is_primary() -> Column:
    return ~flag(S.SECONDARY | S.SUPPLEMENTARY)


def is_contradictory() -> Column:
    """Placed but flagged as unmapped, or not placed and not flagged."""
    return (F.col("ref_id") >= 0) == flag(S.UNMAPPED)


def fraction(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def sort_key_coordinate() -> list[Column]:
    """The order that sorting by coordinate writes; unmapped or unplaced records come last."""
    last = (F.col("ref_id") < 0) | flag(S.UNMAPPED)
    return [last, *map(F.col, ("ref_id", "pos")), flag(S.REVERSE), *map(F.col, ("read_name", "flags", "next_ref_id", "next_pos", "tlen", "ordinal"))]


def sort_key_queryname() -> list[Column]:
    return [F.col(c) for c in ("read_name", "ref_id", "pos", "flags", "next_ref_id", "next_pos", "tlen", "ordinal")]


def check_key_coordinate() -> Column:
    """The order that the sort check compares by: unplaced records last, otherwise without names or mates."""
    placed = F.col("ref_id") >= 0
    top = F.lit(2**31 - 1)
    bits = [flag(b).cast("int").alias(f"f{b}") for b in (S.REVERSE, S.SECONDARY, S.SUPPLEMENTARY, S.READ1, S.READ2)]
    return F.struct(
        (~placed).alias("unplaced"),
        F.when(placed, F.col("ref_id")).otherwise(top).alias("ref"),
        F.when(placed, F.greatest("pos", F.lit(0))).otherwise(top).alias("at"),
        *bits,
        F.col("flags").alias("flags"),
    )


def natural_key(name: str = "read_name") -> Column:
    """A string whose byte order is natural order: runs of digits compare as numbers, then by their own length.

    A run becomes the digit 0, the count of its digits without leading zeros (ten
    places), those digits, then its count of all digits; other bytes stay. Digits
    sort against other bytes as digits do, since the run still starts with one.
    """
    parts = F.regexp_extract_all(F.col(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def encode(part: Column) -> Column:
        trimmed = F.regexp_replace(part, "^0+(?=[0-9])", "")
        number = F.concat(F.lit("0"), F.lpad(F.length(trimmed).cast("string"), 10, "0"), trimmed, F.lpad(F.length(part).cast("string"), 10, "0"))
        return F.when(part.rlike("^[0-9]"), number).otherwise(part)

    return F.array_join(F.transform(parts, encode), "")


def identity(mode: str, name: str = "read_name", sequence: str = "sequence", quality: str = "quality", read_group: str = "rg") -> Column:
    """Record identity: qname_seq, qname_seq_qual or qname_seq_qual_rg, joined by the unit separator."""
    parts = [F.col(name), F.col(sequence)]
    if mode in ("qname_seq_qual", "qname_seq_qual_rg"):
        parts.append(F.coalesce(F.col(quality), F.lit("*")))
    if mode == "qname_seq_qual_rg":
        parts.append(F.coalesce(F.col(read_group), F.lit("")))
    return F.concat_ws("\x1f", *parts)


def name_style(name: str = "read_name") -> Column:
    """The naming scheme of a read name; the first that fits."""
    n = F.col(name)
    hexes = "[0-9A-Fa-f]{1,12}"
    return (
        F.when(F.regexp_count(n, F.lit(":")) >= 3, "colon_delimited")
        .when(n.contains(" "), "space_delimited")
        .when(n.contains("/"), "slash_delimited")
        .when(n.rlike(f"^{hexes}(-{hexes}){{4}}$"), "uuid_like")
        .when(n.contains("_") | n.contains("-"), "underscore_or_dash")
        .otherwise("simple")
    )


def preview(text: str, width: int = 24) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(F.col(text))


def reg2bin(begin: Column, end: Column) -> Column:
    """The bin of the public binning index for a half-open interval; an empty one counts as one base."""
    last = F.greatest(end, begin + 1) - 1
    out = F.lit(0)
    for shift, base in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(begin, shift) == F.shiftright(last, shift), F.lit(base) + F.shiftright(begin, shift)).otherwise(out)
    return out.cast("int")


def cigar_span(cigar: str) -> Column:
    """Reference bases that a CIGAR text covers (operations M, D, N, =, X)."""
    lengths = F.regexp_extract_all(F.col(cigar), F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n.cast("long"))
