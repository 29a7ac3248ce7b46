"""Order: sorting, sort checks, and run-length structure along encounter order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.errors import ReadloomError, unimplemented
from readloom.functions import expr as E
from readloom.functions.ordinal import previous, running_sum
from readloom.operators.profile import bounded


def sort_reads(reads: DataFrame, order: str = "coordinate", suborder: str | None = None) -> DataFrame:
    """Totally ordered reads: a range exchange and a spilling sort."""
    if suborder == "natural":
        raise unimplemented("natural queryname order")
    if order == "coordinate":
        return reads.orderBy(*E.sort_key_coordinate())
    if order == "queryname":
        return reads.orderBy(*E.sort_key_queryname())
    raise ReadloomError("invalid_argument", f"no such order: {order}")


def sort_violations(reads: DataFrame, limit: int | None) -> DataFrame:
    """One row: the 1-based index of the first record that breaks each order (null if none), and the records examined.

    A check stops once all three orders are broken.
    """
    keys = {"coordinate": E.check_key_coordinate(), "lexicographic": F.col("read_name"), "natural": E.natural_key()}
    scanned = previous(bounded(reads, limit), {f"before_{n}": k for n, k in keys.items()})
    broken = {n: F.min(F.when(F.col(f"before_{n}") > k, F.col("ordinal") + 1)).alias(f"{n}_violation") for n, k in keys.items()}
    one = scanned.agg(F.count(F.lit(1)).alias("scanned"), *broken.values())
    violations = [F.col(f"{n}_violation") for n in keys]
    every = violations[0].isNotNull() & violations[1].isNotNull() & violations[2].isNotNull()
    return one.select(*violations, F.when(every, F.greatest(*violations)).otherwise(F.col("scanned")).alias("records_examined"), "scanned")


def check_sort(reads: DataFrame, limit: int | None, declared: str | None = None, declared_sub: str | None = None) -> DataFrame:
    """What order the records appear to be in, against what the header declares, with evidence strength and confidence; without a limit every record is seen."""
    v = sort_violations(reads, limit)
    special = declared_sub if declared_sub and (declared_sub == "template-coordinate" or "minhash" in declared_sub) else None
    n, end = F.col("records_examined"), F.lit(True) if limit is None else F.col("scanned") < limit
    limit = (1 << 62) if limit is None else limit
    coordinate, lexical, natural = (F.col(f"{k}_violation").isNull() for k in ("coordinate", "lexicographic", "natural"))
    query = lexical | natural
    nothing = n == 0
    unsorted = ~coordinate & ~query | (F.lit(bool(special and "minhash" in special)) & ~coordinate)
    template = F.lit(special == "template-coordinate")
    as_coordinate = coordinate & (~query | F.lit(declared == "coordinate"))
    as_query = query & (~coordinate | F.lit(declared == "queryname"))
    order = F.when(nothing, "indeterminate").when(unsorted & ~(template & (coordinate | query)), "unsorted").when(template, "indeterminate").when(as_coordinate, "coordinate").when(as_query, "queryname").otherwise("indeterminate")
    plain = F.when(end | (n >= limit), "strong").when((n >= limit // 2) | (n >= 250), "moderate").otherwise("limited")
    mild = F.when(end, "moderate").otherwise("limited")
    strength = (
        F.when(nothing, "limited")
        .when(F.col("order") == "unsorted", "strong")
        .when(template, mild)
        .when(F.col("order") == "coordinate", mild if special else plain)
        .when(F.col("order") == "queryname", plain)
        .when(end & (n >= limit // 2), "moderate")
        .otherwise("limited")
    )
    sorted_ = F.when(F.col("order") == "unsorted", False).when(F.col("order").isin("coordinate", "queryname"), True)
    agreement = F.lit(None).cast("boolean")
    if declared in ("coordinate", "queryname"):
        other = "queryname" if declared == "coordinate" else "coordinate"
        agreement = F.when(F.col("order") == declared, True).when(F.col("order").isin(other, "unsorted"), False)
    elif declared == "unsorted":
        agreement = F.when(F.col("order") == "unsorted", True)
    confidence = F.when((F.col("evidence_strength") == "strong") & (F.col("order") != "indeterminate"), "high").when((F.col("evidence_strength") == "limited") & (F.col("order") == "indeterminate"), "low").otherwise("medium")
    first = F.when(F.col("order") == "unsorted", F.least("coordinate_violation", "lexicographic_violation", "natural_violation"))
    return (
        v.withColumn("order", order)
        .withColumn("evidence_strength", strength)
        .select("order", sorted_.alias("appears_sorted"), n.cast("long").alias("records_examined"), first.alias("first_violation"), "evidence_strength", agreement.alias("agrees_with_header"), confidence.alias("confidence"))
    )


def segments(reads: DataFrame, label: str = "rg") -> DataFrame:
    """Run-length segments of a label along encounter order; a missing label is ``<missing>``."""
    named = reads.select("ordinal", F.coalesce(F.col(label), F.lit("<missing>")).alias("label"))
    marked = previous(named, {"before": F.col("label")})
    change = (F.col("before").isNull() | (F.col("before") != F.col("label"))).cast("long")
    runs = running_sum(marked, change, "segment")
    return runs.groupBy("segment", "label").agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.count(F.lit(1)).alias("records"))


def rg_boundary(reads: DataFrame, label: str = "rg") -> DataFrame:
    """The first two large read-group segments, if they differ: (first_label, second_label, boundary ordinal); no row without a finding.

    A large segment has a tenth of the records, 50 at least, and a label; under 100 records nothing is reported.
    """
    n = reads.agg(F.count(F.lit(1)).alias("n"))
    large = segments(reads, label).join(n).where("n >= 100 AND label <> '<missing>' AND records >= greatest(n div 10, 50)")
    two = large.orderBy("first_ordinal").limit(2)
    one = two.agg(F.count(F.lit(1)).alias("k"), F.min_by("label", "first_ordinal").alias("first_label"), F.max_by("label", "first_ordinal").alias("second_label"), F.max("first_ordinal").alias("boundary_ordinal"))
    return one.where("k = 2 AND first_label <> second_label").drop("k")


def edge_windows(reads: DataFrame, width: int = 256) -> DataFrame:
    """The first and the last ``width`` records, marked start and end; a record may be in both."""
    n = reads.agg(F.max("ordinal").alias("__last"))
    marked = reads.join(F.broadcast(n)).where((F.col("ordinal") < width) | (F.col("ordinal") > F.col("__last") - width))
    sides = F.array_compact(F.array(F.when(F.col("ordinal") < width, F.lit("start")), F.when(F.col("ordinal") > F.col("__last") - width, F.lit("end"))))
    return marked.withColumn("edge", F.explode(sides)).drop("__last")


def readname_regime(reads: DataFrame, width: int = 256, least: int = 16, share: float = 0.8) -> DataFrame:
    """The dominant name style at both ends, where both have enough records of one style and they differ; else no row."""
    styles = edge_windows(reads, width).groupBy("edge", E.name_style().alias("style")).agg(F.count(F.lit(1)).alias("n"))
    sizes = styles.groupBy("edge").agg(F.sum("n").alias("size"))
    ruling = styles.join(sizes, "edge").where((F.col("size") >= least) & (F.col("n") >= share * F.col("size")))
    one = ruling.agg(F.max(F.when(F.col("edge") == "start", F.col("style"))).alias("start_style"), F.max(F.when(F.col("edge") == "end", F.col("style"))).alias("end_style"))
    return one.where("start_style <> end_style")


def tag_schema_shift(reads: DataFrame, width: int = 256, least: int = 16, gap: float = 1.5, share: float = 0.6) -> DataFrame:
    """Mean aux tags at both ends and whether the prevalent tag sets differ; a row only where that is a finding. ``tags`` is an array of tag names."""
    window = edge_windows(reads.select("ordinal", "tags"), width)
    sizes = window.groupBy("edge").agg(F.count(F.lit(1)).alias("size"), F.sum(F.size("tags")).alias("tag_count"))
    common = window.select("edge", "ordinal", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("edge", "tag").agg(F.count(F.lit(1)).alias("n"))
    prevalent = common.join(sizes, "edge").where(F.col("n") >= share * F.col("size")).groupBy("edge").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("prevalent"))
    both = sizes.join(prevalent, "edge", "left")
    at = lambda side, c: F.max(F.when(F.col("edge") == side, c))
    mean = F.col("tag_count").cast("double") / F.col("size")
    one = both.agg(
        at("start", F.col("size")).alias("n_start"),
        at("end", F.col("size")).alias("n_end"),
        at("start", mean).alias("start_mean_tags"),
        at("end", mean).alias("end_mean_tags"),
        F.coalesce(at("start", F.col("prevalent")), F.lit("")).alias("start_prevalent"),
        F.coalesce(at("end", F.col("prevalent")), F.lit("")).alias("end_prevalent"),
    )
    wide = F.abs(F.col("start_mean_tags") - F.col("end_mean_tags")) >= gap
    shifted = wide | (F.col("start_prevalent") != F.col("end_prevalent"))
    return one.where((F.col("n_start") >= least) & (F.col("n_end") >= least) & shifted).drop("n_start", "n_end")
