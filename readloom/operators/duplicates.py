"""Record and block duplication, and conservative removal of duplicate blocks."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.errors import ReadloomError, unimplemented
from readloom.functions import expr as E
from readloom.functions.ordinal import WIDTH, previous, running_sum


def identity_counts(reads: DataFrame, mode: str) -> DataFrame:
    """One row per identity with its number of records and first ordinal. Counts are partial before the shuffle, so a hot identity is one row a task."""
    return reads.select("ordinal", "read_name", "sequence", E.identity(mode).alias("identity")).groupBy("identity").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ordinal", "read_name", "sequence")).alias("first")
    )


def dup_summary(reads: DataFrame, mode: str = "qname_seq_qual") -> DataFrame:
    n, many = F.col("n"), F.col("n") > 1
    one = identity_counts(reads, mode).agg(
        F.count(F.lit(1)).alias("unique_identities"),
        F.count_if(many).alias("duplicate_identities"),
        F.coalesce(F.sum(F.when(many, n)), F.lit(0)).alias("duplicate_records"),
        F.coalesce(F.sum(F.when(many, n - 1)), F.lit(0)).alias("duplicate_instances_beyond_first"),
        F.coalesce(F.sum(n), F.lit(0)).alias("records"),
    )
    whole = F.greatest("records", F.lit(1))
    return one.select(
        "unique_identities",
        "duplicate_identities",
        "duplicate_records",
        "duplicate_instances_beyond_first",
        E.fraction(F.col("duplicate_records"), whole).alias("fraction_duplicate_records"),
        E.fraction(F.col("duplicate_instances_beyond_first"), whole).alias("fraction_duplicate_instances_beyond_first"),
    )


def dup_examples(reads: DataFrame, mode: str = "qname_seq_qual", k: int = 3) -> DataFrame:
    """The k commonest repeated identities, by count, then name."""
    many = identity_counts(reads, mode).where("n > 1")
    shown = many.select(F.col("first.read_name").alias("read_name"), F.col("n").alias("records"), F.col("first.sequence").alias("sequence"))
    return shown.select("read_name", "records", E.preview("sequence").alias("sequence_preview")).orderBy(F.desc("records"), "read_name", "sequence_preview").limit(k)


def repeats_at(reads: DataFrame, lag: int, mode: str = "qname_seq_qual") -> DataFrame:
    """(ordinal, equal): whether a record's identity is that of the record ``lag`` later. A self-join on the ordinal, as no window spans the whole order."""
    ids = reads.select("ordinal", F.sha2(E.identity(mode), 256).alias("id"))
    later = ids.select((F.col("ordinal") - lag).alias("ordinal"), F.col("id").alias("later"))
    return ids.join(later, "ordinal", "left").select("ordinal", F.coalesce(F.col("id") == F.col("later"), F.lit(False)).alias("equal"))


def repeat_runs(reads: DataFrame, lag: int, mode: str = "qname_seq_qual") -> DataFrame:
    """Maximal runs of at least ``lag`` records that equal the record ``lag`` later: (first_ordinal, records)."""
    flags = previous(repeats_at(reads, lag, mode), {"before": F.col("equal")})
    runs = running_sum(flags, (F.col("equal") & ~F.coalesce("before", F.lit(False))).cast("long"), "run").where("equal")
    return runs.groupBy("run").agg(F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("records")).where(F.col("records") >= lag).drop("run")


def adjacent_blocks(reads: DataFrame, min_block: int = 50, mode: str = "qname_seq_qual", strategy: str = "compat") -> list[tuple[int, int, int]]:
    """Blocks that are repeated right after themselves, as (first, second, records), greedily from the left.

    ``compat`` seeds a block by ``min_block`` records that equal the next
    ``min_block``, then lets it grow by one record while the longer block also
    equals what follows it. A block of distinct records repeats only at its own
    length, so it is found only if that is ``min_block``. ``any_length`` takes
    every period from ``min_block`` up.

    Runs reach the driver, a row each of ``min_block`` records at least, and no
    identity does.
    """
    if min_block <= 0:
        return []
    if strategy == "any_length":
        return _any_length(reads, min_block, mode)
    runs = _collected(repeat_runs(reads, min_block, mode))
    if not runs:
        return []
    # a block that repeats at two neighbouring lengths is one identity over and over
    same = repeat_runs(reads, 1, mode).where(F.col("records") > 2 * min_block)
    return greedy_blocks(runs, [(a, z + 1) for a, z in _collected(same)], min_block)


def _collected(runs: DataFrame) -> list[tuple[int, int]]:
    return sorted((r["first_ordinal"], r["first_ordinal"] + r["records"]) for r in runs.collect())


def greedy_blocks(runs: list[tuple[int, int]], constant: list[tuple[int, int]], m: int) -> list[tuple[int, int, int]]:
    """The left-to-right pass over candidate runs [first, end); a block found moves the pass beyond both of its copies.

    ``constant`` has the stretches [first, end) of one identity that hold more than
    two blocks; there a block takes half of what is left of the stretch.
    """
    out, free = [], 0
    starts = [a for a, _ in constant]
    for first, end in runs:
        at = max(first, free)
        while end - at >= m:
            i = bisect_right(starts, at) - 1
            size = max(m, (constant[i][1] - at) // 2) if i >= 0 else m
            out.append((at, at + size, size))
            at += 2 * size
        free = max(free, at)
    return out


def _any_length(reads: DataFrame, m: int, mode: str) -> list[tuple[int, int, int]]:
    """Periods are the distances between neighbouring equal identities; each is tried as a lag."""
    ids = reads.select("ordinal", F.sha2(E.identity(mode), 256).alias("id"))
    from pyspark.sql.window import Window

    step = F.lead("ordinal").over(Window.partitionBy("id").orderBy("ordinal")) - F.col("ordinal")
    lags = ids.select(step.alias("lag")).where(F.col("lag") >= m).groupBy("lag").agg(F.count(F.lit(1)).alias("n")).where("n >= lag")
    found = []
    for lag in sorted(r["lag"] for r in lags.collect()):
        found += [(int(r["first_ordinal"]), int(lag)) for r in repeat_runs(reads, lag, mode).collect()]
    out, free = [], 0
    for at, size in sorted(found):
        if at >= free:
            out.append((at, at + size, size))
            free = at + 2 * size
    return out


def removal_ranges(blocks: list[tuple[int, int, int]], keep: str = "first") -> list[tuple[int, int]]:
    """[first, end) of the copies to remove. Of three copies in a row one is removed, so a second pass may find more."""
    if keep not in ("first", "last"):
        raise ReadloomError("invalid_argument", f"keep must be first or last, not {keep}")
    return [(b, b + n) if keep == "first" else (a, a + n) for a, b, n in blocks]


def remove_ranges(reads: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Reads outside the ranges. Ranges are cut at multiples of ``WIDTH``, so that the join has a key; the optimizer broadcasts them if they are few."""
    if not ranges:
        return reads
    table = reads.sparkSession.createDataFrame([(int(a), int(z)) for a, z in ranges], "__a long, __z long")
    table = table.withColumn("__part", F.explode(F.sequence(F.expr(f"__a div {WIDTH}"), F.expr(f"(__z - 1) div {WIDTH}"))))
    marked = reads.withColumn("__part", F.expr(f"ordinal div {WIDTH}"))
    inside = (marked["__part"] == table["__part"]) & (marked["ordinal"] >= table["__a"]) & (marked["ordinal"] < table["__z"])
    return marked.join(table, inside, "left_anti").drop("__part")


def blocks_to_remove(reads: DataFrame, mode: str = "contiguous-block", identity: str = "qname_seq_qual", keep: str = "first", min_block: int = 50) -> list[tuple[int, int]]:
    """[first, end) of what a mode removes; ``whole-file-append`` removes only a second half that equals the first."""
    if mode == "global-exact":
        raise unimplemented("global-exact deduplication")
    if mode not in ("contiguous-block", "whole-file-append"):
        raise ReadloomError("invalid_argument", f"no such mode: {mode}")
    blocks = adjacent_blocks(reads, max(min_block, 1), identity)
    if mode == "whole-file-append":
        total = reads.count()
        blocks = [b for b in blocks if b[0] == 0 and 2 * b[2] == total]
    return removal_ranges(blocks, keep)


def deduplicate(reads: DataFrame, mode: str = "contiguous-block", identity: str = "qname_seq_qual", keep: str = "first", min_block: int = 50) -> DataFrame:
    """Reads without what ``blocks_to_remove`` finds."""
    return remove_ranges(reads, blocks_to_remove(reads, mode, identity, keep, min_block))


def duplication_findings(reads: DataFrame, identity: str = "qname_seq_qual", min_block: int = 50, max_findings: int = 25) -> DataFrame:
    """Blocks first, then one finding on repeated identities: (finding, confidence, evidence_strength, first_1, last_1, first_2, last_2), 1-based and inclusive."""
    total = reads.count()
    rows = []
    for a, b, n in adjacent_blocks(reads, min_block, identity):
        kind = "whole_file_append_duplicate" if a == 0 and 2 * n == total else "contiguous_block_duplicate"
        rows.append((kind, "high", "strong", a + 1, a + n, b + 1, b + n))
    s = dup_summary(reads, identity).first()
    if s["duplicate_identities"] and len(rows) < max_findings:
        large = s["fraction_duplicate_records"] >= 0.25
        rows.append(("partial_collection_duplicate" if not rows and large else "exact_record_duplicate", "high" if large else "medium", "moderate", None, None, None, None))
    return reads.sparkSession.createDataFrame(
        rows[:max_findings], "finding string, confidence string, evidence_strength string, first_1 long, last_1 long, first_2 long, last_2 long"
    )
