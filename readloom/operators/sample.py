"""Subsampling: a seeded stream of draws over eligible records, or by a hash of record identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.errors import ReadloomError
from readloom.functions import expr as E
from readloom.functions.kernels import fnv1a64_udf, keep_threshold, splitmix64_udf
from readloom.functions.ordinal import running_sum


def _unsigned_at_most(value: Column, limit: int) -> Column:
    """value <= limit as unsigned 64-bit numbers, for longs that hold their bits."""
    signed = limit - (1 << 64) if limit >= 1 << 63 else limit
    if limit < 1 << 63:
        return (value >= 0) & (value <= signed)
    return (value >= 0) | (value <= signed)


def _eligible(mapped_only: bool, primary_only: bool) -> Column:
    where = F.lit(True)
    if mapped_only:
        where &= E.is_mapped()
    if primary_only:
        where &= E.is_primary()
    return where


def _check(fraction: float) -> None:
    if not 0 < fraction <= 1:
        raise ReadloomError("invalid_argument", "fraction must be above 0 and at most 1")


def subsample_random(reads: DataFrame, fraction: float, seed: int, mapped_only: bool = False, primary_only: bool = False) -> DataFrame:
    """Eligible records whose draw is low enough. The n-th eligible record gets the n-th output of the seed's stream, which needs no state."""
    _check(fraction)
    eligible = _eligible(mapped_only, primary_only)
    ranked = running_sum(reads, eligible.cast("long"), "__rank").where(eligible)
    draw = splitmix64_udf(seed)(F.col("__rank") - 1)
    return ranked.where(_unsigned_at_most(draw, keep_threshold(fraction))).drop("__rank")


def subsample_hash(reads: DataFrame, fraction: float, identity: Column, mapped_only: bool = False, primary_only: bool = False) -> DataFrame:
    """Eligible records whose identity (a binary column) hashes low enough; the same reads at every run, and nested for nested fractions."""
    _check(fraction)
    return reads.where(_eligible(mapped_only, primary_only)).where(_unsigned_at_most(fnv1a64_udf(identity), keep_threshold(fraction)))


def fastq_identity(mode: str) -> Column:
    """Identity bytes of a raw read: name, or name, NUL and sequence, or its four lines with NUL between them (``raw_header`` is without its mark)."""
    name, nul = F.encode("read_name", "UTF-8"), F.lit(b"\x00")
    if mode == "qname":
        return name
    if mode == "qname_seq":
        return F.concat(name, nul, F.encode("sequence", "UTF-8"))
    if mode != "full_record":
        raise ReadloomError("invalid_argument", f"no such identity: {mode}")
    lines = [F.concat(F.lit(b"@"), F.encode("raw_header", "UTF-8")), *[F.encode(c, "UTF-8") for c in ("sequence", "plus_line", "quality")]]
    return F.concat(lines[0], nul, lines[1], nul, lines[2], nul, lines[3])
