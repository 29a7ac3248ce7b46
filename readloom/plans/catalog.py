"""Named queries over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import expr as E
from readloom.functions.ordinal import placed
from readloom.operators import checksum, duplicates, forensic, order, profile, rewrite, sample, validate
from readloom.plans import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

MAPPED = "(ref_id >= 0 AND flags & 4 = 0)"
SECONDARY, SUPPLEMENTARY = "(flags & 256 <> 0)", "(flags & 2048 <> 0)"
CONTRADICTORY = "((ref_id >= 0) = (flags & 4 <> 0))"


def query(name: str, sql: str | None = None, *bases: str):
    """Register a query; ``bases`` are the relations that its SQL names."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (f"WITH {', '.join(bases)} " if bases else "") + sql
        return f

    return add


COUNTS_SQL = f"""count(*) AS records_examined, count(*) FILTER (WHERE {MAPPED}) AS mapped_records, count(*) FILTER (WHERE NOT {MAPPED}) AS unmapped_records,
    count(*) FILTER (WHERE {SECONDARY}) AS secondary_records, count(*) FILTER (WHERE NOT {SECONDARY} AND {SUPPLEMENTARY}) AS supplementary_records,
    count(*) FILTER (WHERE NOT {SECONDARY} AND NOT {SUPPLEMENTARY}) AS primary_records, count(*) FILTER (WHERE flags & 1024 <> 0) AS duplicate_records,
    count(*) FILTER (WHERE flags & 512 <> 0) AS qc_fail_records, count(*) FILTER (WHERE flags & 1 <> 0) AS paired_records,
    count(*) FILTER (WHERE flags & 2 <> 0) AS properly_paired_records, count(*) FILTER (WHERE flags & 64 <> 0) AS read1_records,
    count(*) FILTER (WHERE flags & 128 <> 0) AS read2_records, count(*) FILTER (WHERE flags & 16 <> 0) AS reverse_strand_records,
    count(*) FILTER (WHERE {CONTRADICTORY}) AS contradictory_records"""
SHARES_SQL = ", ".join(f"CAST({n}_records AS double) / nullif(records_examined, 0) AS {n}_fraction" for n in profile.FRACTIONS)


@query("summary_counts", f"SELECT {COUNTS_SQL} FROM reads", A.READS_SQL)
def summary_counts(spark, sf):
    return profile.summary_counts(A.reads(spark, sf))


@query("summary_fractions", f"SELECT {SHARES_SQL} FROM (SELECT {COUNTS_SQL} FROM reads)", A.READS_SQL)
def summary_fractions(spark, sf):
    return profile.summary_fractions(A.reads(spark, sf))


@query("flag_decode", "SELECT ordinal, " + ", ".join(f"flags & {b} <> 0 AS {n}" for n, b in E.FLAG_NAMES.items()) + " FROM reads", A.READS_SQL)
def flag_decode(spark, sf):
    return profile.flag_decode(A.reads(spark, sf))


@query("filter_mapped_only", f"SELECT ordinal, ref_id, flags FROM reads WHERE {MAPPED}", A.READS_SQL)
def filter_mapped_only(spark, sf):
    return profile.mapped_only(A.reads(spark, sf)).select("ordinal", "ref_id", "flags")


@query("filter_primary_only", "SELECT ordinal, ref_id, flags FROM reads WHERE flags & 2304 = 0", A.READS_SQL)
def filter_primary_only(spark, sf):
    return profile.primary_only(A.reads(spark, sf)).select("ordinal", "ref_id", "flags")


@query("contradictory_state", f"SELECT ordinal, ref_id, flags FROM reads WHERE {CONTRADICTORY}", A.READS_SQL)
def contradictory_state(spark, sf):
    return profile.contradictory(A.reads(spark, sf)).select("ordinal", "ref_id", "flags")


@query("bounded_scan", "SELECT (SELECT count(*) FROM reads WHERE ordinal < 500) AS records_examined, (SELECT count(*) FROM reads) < 500 AS reached_eof", A.READS_SQL)
def bounded_scan(spark, sf):
    reads = A.reads(spark, sf)
    return reads.agg(F.count_if(F.col("ordinal") < 500).alias("records_examined"), (F.count(F.lit(1)) < 500).alias("reached_eof"))


@query("mapq_stats", "SELECT min(mapq) AS mapq_min, max(mapq) AS mapq_max, CAST(sum(mapq) AS double) / nullif(count(*), 0) AS mapq_mean, count(*) FILTER (WHERE mapq = 0) AS mapq_zero_count FROM reads", A.READS_SQL)
def mapq_stats(spark, sf):
    return profile.mapq_stats(A.reads(spark, sf))


@query("mapq_histogram", "SELECT mapq, count(*) AS records FROM reads GROUP BY mapq", A.READS_SQL)
def mapq_histogram(spark, sf):
    return profile.mapq_histogram(A.reads(spark, sf))


@query("refs_with_mapped", f"SELECT count(DISTINCT ref_id) AS references_with_mapped_reads FROM reads WHERE {MAPPED}", A.READS_SQL)
def refs_with_mapped(spark, sf):
    return profile.refs_with_mapped(A.reads(spark, sf))


SUMMARY_SQL = f"""SELECT 'full_scan' AS mode, CAST(25 AS bigint) AS references_defined, *, records_examined AS records_total_known, {SHARES_SQL},
    CASE WHEN records_examined = 0 THEN 'indeterminate' WHEN mapped_records > 0 THEN 'mapped' ELSE 'unmapped' END AS mapping_status,
    CASE WHEN records_examined = 0 THEN 'low' ELSE 'high' END AS confidence
  FROM (SELECT {COUNTS_SQL}, min(mapq) AS mapq_min, max(mapq) AS mapq_max, CAST(sum(mapq) AS double) / nullif(count(*), 0) AS mapq_mean,
    count(*) FILTER (WHERE mapq = 0) AS mapq_zero_count, count(DISTINCT CASE WHEN {MAPPED} THEN ref_id END) AS references_with_mapped_reads FROM reads)"""


@query("summary", SUMMARY_SQL, A.READS_SQL)
def summary(spark, sf):
    return profile.summary(A.reads(spark, sf), None, 25)


@query("summary_bounded", SUMMARY_SQL.replace("FROM reads)", "FROM reads WHERE ordinal < 700)").replace("'full_scan'", "'bounded_scan'").replace("records_examined AS records_total_known", "CAST(NULL AS bigint) AS records_total_known").replace("ELSE 'high'", "ELSE 'medium'"), A.READS_SQL)
def summary_bounded(spark, sf):
    return profile.summary(A.reads(spark, sf), 700, 25)


@query(
    "refs_counts",
    f"""SELECT r.index, r.name, r.length, coalesce(c.m, 0) AS mapped_reads, coalesce(c.u, 0) AS unmapped_reads FROM refs r
    LEFT JOIN (SELECT ref_id, count(*) FILTER (WHERE {MAPPED}) AS m, count(*) FILTER (WHERE flags & 4 <> 0) AS u FROM reads WHERE ref_id >= 0 GROUP BY ref_id) c ON c.ref_id = r.index""",
    A.READS_SQL,
    A.REFS_SQL,
)
def refs_counts(spark, sf):
    return profile.refs_counts(A.reads(spark, sf), A.refs(spark, sf))


@query(
    "check_map",
    f"""SELECT *, CASE WHEN records_examined = 0 THEN 'indeterminate' WHEN mapped_records_observed > 0 THEN 'mapped' ELSE 'unmapped' END AS mapping_status,
    CASE WHEN records_examined = 0 OR inconsistent_records_observed > 0 THEN 'low' WHEN mapped_records_observed > 0 OR NOT reached_end THEN 'medium' ELSE 'high' END AS confidence
    FROM (SELECT count(*) AS records_examined, count(*) FILTER (WHERE {MAPPED}) AS mapped_records_observed, count(*) FILTER (WHERE NOT {MAPPED}) AS unmapped_records_observed,
      count(*) FILTER (WHERE {CONTRADICTORY}) AS inconsistent_records_observed, count(DISTINCT CASE WHEN {MAPPED} THEN ref_id END) AS references_with_mapped_reads_observed,
      (SELECT count(*) FROM reads) < 800 AS reached_end FROM reads WHERE ordinal < 800)""",
    A.READS_SQL,
)
def check_map(spark, sf):
    return profile.check_map(A.reads(spark, sf), 800)


@query(
    "check_map_full",
    f"""SELECT *, CASE WHEN records_examined = 0 THEN 'indeterminate' WHEN mapped_records_observed > 0 THEN 'mapped' ELSE 'unmapped' END AS mapping_status,
    CASE WHEN records_examined = 0 OR inconsistent_records_observed > 0 THEN 'low' WHEN mapped_records_observed > 0 THEN 'medium' ELSE 'high' END AS confidence
    FROM (SELECT count(*) AS records_examined, count(*) FILTER (WHERE {MAPPED}) AS mapped_records_observed, count(*) FILTER (WHERE NOT {MAPPED}) AS unmapped_records_observed,
      count(*) FILTER (WHERE {CONTRADICTORY}) AS inconsistent_records_observed, count(DISTINCT CASE WHEN {MAPPED} THEN ref_id END) AS references_with_mapped_reads_observed, true AS reached_end FROM reads)""",
    A.READS_SQL,
)
def check_map_full(spark, sf):
    return profile.check_map(A.reads(spark, sf), None)


@query("enumerate", "SELECT 'events' AS source, count(*) AS records FROM reads", A.READS_SQL)
def enumerate_(spark, sf):
    return profile.enumerate_records(A.reads(spark, sf))


@query("read_ref_name", "SELECT ordinal, name AS reference_name FROM reads LEFT JOIN refs ON reads.ref_id = refs.index", A.READS_SQL, A.REFS_SQL)
def read_ref_name(spark, sf):
    return profile.read_ref_name(A.reads(spark, sf), A.refs(spark, sf)).select("ordinal", "reference_name")


def _aux(reads: DataFrame) -> DataFrame:
    return reads.withColumn("aux", F.transform("tags", lambda t: F.struct(t.alias("tag"), F.lit("Z").alias("type"))))


@query(
    "check_tag",
    """SELECT tag, CASE WHEN first IS NOT NULL THEN 'observed_present' WHEN n = 0 THEN 'indeterminate' WHEN n < 300 THEN 'absent_in_full_scan' ELSE 'not_found_in_examined_records' END AS result,
    CASE WHEN first IS NOT NULL THEN first + 1 ELSE n END AS records_examined, CAST(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END AS bigint) AS records_with_tag
    FROM (SELECT t.tag, count(*) AS n, min(CASE WHEN contains(tag_text, t.tag) THEN ordinal END) AS first FROM reads, (VALUES ('MD'), ('ZZ')) AS t(tag) WHERE ordinal < 300 GROUP BY t.tag)""",
    A.READS_SQL,
)
def check_tag(spark, sf):
    reads = _aux(A.reads(spark, sf))
    return profile.check_tag(reads, "MD", 300).unionByName(profile.check_tag(reads, "ZZ", 300))


@query(
    "check_tag_full",
    """SELECT tag, CASE WHEN first IS NOT NULL THEN 'observed_present' WHEN n = 0 THEN 'indeterminate' ELSE 'absent_in_full_scan' END AS result,
    CASE WHEN first IS NOT NULL THEN first + 1 ELSE n END AS records_examined, CAST(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END AS bigint) AS records_with_tag
    FROM (SELECT t.tag, count(ordinal) AS n, min(CASE WHEN contains(tag_text, t.tag) THEN ordinal END) AS first FROM (VALUES ('MD'), ('ZZ')) AS t(tag) LEFT JOIN reads ON true GROUP BY t.tag)""",
    A.READS_SQL,
)
def check_tag_full(spark, sf):
    reads = _aux(A.reads(spark, sf))
    return profile.check_tag(reads, "MD", None).unionByName(profile.check_tag(reads, "ZZ", None))


@query(
    "unmap",
    """SELECT ordinal, CASE WHEN flags & 1 <> 0 THEN ((flags | 4) & ~50) | 8 ELSE (flags | 4) & ~50 END AS flags, -1 AS ref_id, -1 AS pos, -1 AS next_ref_id, -1 AS next_pos, 0 AS tlen, 0 AS mapq, 0 AS n_cigar,
    CASE tag_text WHEN 'NM' THEN 1 WHEN 'NM,MD' THEN 2 ELSE 3 END AS tags_removed FROM reads""",
    A.READS_SQL,
)
def unmap(spark, sf):
    done = rewrite.unmap(_aux(A.reads(spark, sf)))
    return done.select("ordinal", "flags", "ref_id", "pos", "next_ref_id", "next_pos", "tlen", "mapq", "n_cigar", "tags_removed")


@query(
    "annotate_rg",
    """SELECT ordinal, CASE WHEN rg IS NULL THEN 'inserted' WHEN rg = 'click' THEN 'matching' ELSE 'replaced' END AS action, 'click' AS rg FROM reads""",
    A.READS_SQL,
)
def annotate_rg(spark, sf):
    return rewrite.annotate_rg(A.reads(spark, sf), "click", "replace-existing").select("ordinal", "action", "rg")


@query(
    "annotate_rg_counts",
    """SELECT count(*) AS records_examined, count(*) FILTER (WHERE rg IS NULL) AS records_inserted, count(*) FILTER (WHERE rg = 'click') AS records_matching, CAST(0 AS bigint) AS records_replaced, CAST(0 AS bigint) AS records_kept,
    count(*) FILTER (WHERE rg <> 'click') AS records_conflict FROM reads""",
    A.READS_SQL,
)
def annotate_rg_counts(spark, sf):
    return rewrite.annotate_rg_counts(A.reads(spark, sf), "click")


@query("refs_left_sq", "SELECT index, refs.name, refs.length, CASE WHEN sq.length <> refs.length THEN sq.length ELSE -1 END AS text_header_length FROM refs LEFT JOIN sq ON refs.name = sq.name", A.REFS_SQL, A.SQ_SQL)
def refs_left_sq(spark, sf):
    return rewrite.refs_left_sq(A.refs(spark, sf), A.sq(spark, sf)).fillna(-1, ["text_header_length"])


@query("sq_anti_refs", "SELECT name, length FROM sq WHERE name NOT IN (SELECT name FROM refs)", A.REFS_SQL, A.SQ_SQL)
def sq_anti_refs(spark, sf):
    return rewrite.sq_anti_refs(A.sq(spark, sf), A.refs(spark, sf))


@query("rg_undeclared", "SELECT DISTINCT rg AS id FROM reads WHERE rg IS NOT NULL AND rg NOT IN (SELECT id FROM groups)", A.READS_SQL, A.GROUPS_SQL)
def rg_undeclared(spark, sf):
    return rewrite.undeclared_read_groups(A.reads(spark, sf), A.groups(spark, sf))


@query("pg_broken_parent", "SELECT id, previous_program_id FROM programs WHERE previous_program_id IS NOT NULL AND previous_program_id NOT IN (SELECT id FROM programs)", A.PROGRAMS_SQL)
def pg_broken_parent(spark, sf):
    return rewrite.broken_parents(A.programs(spark, sf))


@query("pg_roots", "SELECT id FROM programs WHERE previous_program_id IS NULL OR previous_program_id NOT IN (SELECT id FROM programs)", A.PROGRAMS_SQL)
def pg_roots(spark, sf):
    return rewrite.program_roots(A.programs(spark, sf))


@query("duplicate_ids", "SELECT id, count(*) AS n FROM programs GROUP BY id HAVING count(*) > 1", A.PROGRAMS_SQL)
def duplicate_ids(spark, sf):
    return rewrite.duplicate_ids(A.programs(spark, sf))


@query("sample_platforms", "SELECT sample, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM groups GROUP BY sample HAVING count(DISTINCT platform) > 1", A.GROUPS_SQL)
def sample_platforms(spark, sf):
    return rewrite.sample_platforms(A.groups(spark, sf))


@query("dict_equal", "SELECT refs.index, refs.name, refs.length, refs.name AS other_name, refs.length + 1 AS other_length FROM refs WHERE index % 6 = 0", A.REFS_SQL)
def dict_equal(spark, sf):
    refs = A.refs(spark, sf)
    return rewrite.dictionary_differences(refs, refs.withColumn("length", F.expr("length + case when index % 6 = 0 then 1 else 0 end")))


@query(
    "check_sort_violations",
    """SELECT min(CASE WHEN ordinal > 0 AND (p_u, p_ref, p_at, p_1, p_2, p_3, p_4, p_5, p_flags) > (u, ref, at_, f1, f2, f3, f4, f5, flags) THEN ordinal + 1 END) AS coordinate_violation,
      min(CASE WHEN p_name > read_name THEN ordinal + 1 END) AS lexicographic_violation, count(*) AS scanned
    FROM (SELECT *, lag(u) OVER w AS p_u, lag(ref) OVER w AS p_ref, lag(at_) OVER w AS p_at, lag(f1) OVER w AS p_1, lag(f2) OVER w AS p_2, lag(f3) OVER w AS p_3, lag(f4) OVER w AS p_4, lag(f5) OVER w AS p_5,
        lag(flags) OVER w AS p_flags, lag(read_name) OVER w AS p_name
      FROM (SELECT ordinal, read_name, flags, ref_id < 0 AS u, CASE WHEN ref_id < 0 THEN 2147483647 ELSE ref_id END AS ref, CASE WHEN ref_id < 0 THEN 2147483647 ELSE greatest(pos, 0) END AS at_,
          flags & 16 <> 0 AS f1, flags & 256 <> 0 AS f2, flags & 2048 <> 0 AS f3, flags & 64 <> 0 AS f4, flags & 128 <> 0 AS f5 FROM reads WHERE ordinal < 5000)
      WINDOW w AS (ORDER BY ordinal))""",
    A.READS_SQL,
)
def check_sort_violations(spark, sf):
    return order.sort_violations(A.reads(spark, sf), 5000).select("coordinate_violation", "lexicographic_violation", "scanned")


#: Names are a word, a colon and a number, so natural order is that of the word, then of the number and its length.
CHECK_SORT_SQL = """SELECT CASE WHEN n = 0 THEN 'indeterminate' WHEN c IS NULL THEN 'coordinate' WHEN l IS NULL OR m IS NULL THEN 'queryname' ELSE 'unsorted' END AS order,
      CASE WHEN n > 0 THEN c IS NULL OR l IS NULL OR m IS NULL END AS appears_sorted,
      CASE WHEN c IS NOT NULL AND l IS NOT NULL AND m IS NOT NULL THEN greatest(c, l, m) ELSE n END AS records_examined,
      CASE WHEN c IS NOT NULL AND l IS NOT NULL AND m IS NOT NULL THEN least(c, l, m) END AS first_violation,
      CASE WHEN n = 0 THEN 'limited' ELSE 'strong' END AS evidence_strength,
      CASE WHEN n > 0 THEN c IS NULL END AS agrees_with_header, CASE WHEN n = 0 THEN 'low' ELSE 'high' END AS confidence
    FROM (SELECT count(*) AS n, min(CASE WHEN before_place > place THEN ordinal + 1 END) AS c, min(CASE WHEN before_name > read_name THEN ordinal + 1 END) AS l, min(CASE WHEN before_digits > digits THEN ordinal + 1 END) AS m
      FROM (SELECT *, lag(place) OVER w AS before_place, lag(read_name) OVER w AS before_name, lag(digits) OVER w AS before_digits
        FROM (SELECT ordinal, read_name, (split_part(read_name, ':', 1), CAST(split_part(read_name, ':', 2) AS bigint), length(read_name)) AS digits,
            (ref_id < 0, CASE WHEN ref_id < 0 THEN 2147483647 ELSE ref_id END, CASE WHEN ref_id < 0 THEN 2147483647 ELSE greatest(pos, 0) END, (flags // 16) % 2, (flags // 256) % 2, (flags // 2048) % 2, (flags // 64) % 2, (flags // 128) % 2, flags) AS place
          FROM reads WHERE ordinal < LIMIT_OF_SCAN) WINDOW w AS (ORDER BY ordinal)))"""


@query("check_sort", CHECK_SORT_SQL.replace("LIMIT_OF_SCAN", "10000"), A.READS_SQL)
def check_sort(spark, sf):
    return order.check_sort(A.reads(spark, sf), 10000, "coordinate")


@query("check_sort_strict", CHECK_SORT_SQL.replace("WHERE ordinal < LIMIT_OF_SCAN", ""), A.READS_SQL)
def check_sort_strict(spark, sf):
    return order.check_sort(A.reads(spark, sf), None, "coordinate")


SORT_COLUMNS = "ordinal, ref_id, pos, read_name, flags"


@query(
    "sort_coordinate",
    f"SELECT {SORT_COLUMNS}, row_number() OVER (ORDER BY (ref_id < 0 OR flags & 4 <> 0), ref_id, pos, flags & 16 <> 0, read_name, flags, next_ref_id, next_pos, tlen, ordinal) AS place FROM reads",
    A.READS_SQL,
)
def sort_coordinate(spark, sf):
    return placed(A.reads(spark, sf), E.sort_key_coordinate(), SORT_COLUMNS.split(", "), "place")


@query("sort_queryname", f"SELECT {SORT_COLUMNS} FROM reads ORDER BY read_name, ref_id, pos, flags, next_ref_id, next_pos, tlen, ordinal", A.READS_SQL)
def sort_queryname(spark, sf):
    return order.sort_reads(A.reads(spark, sf), "queryname").select(*SORT_COLUMNS.split(", "))


SEGMENTS_SQL = """segments AS (SELECT segment, label, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal, count(*) AS records FROM (
      SELECT *, sum(CASE WHEN before IS NULL OR before <> label THEN 1 ELSE 0 END) OVER (ORDER BY ordinal) AS segment FROM (
        SELECT ordinal, coalesce(rg, '<missing>') AS label, lag(coalesce(rg, '<missing>')) OVER (ORDER BY ordinal) AS before FROM reads)) GROUP BY segment, label)"""


@query("rg_segments", "SELECT CAST(segment AS bigint) AS segment, label, first_ordinal, last_ordinal, records FROM segments", A.READS_SQL, SEGMENTS_SQL)
def rg_segments(spark, sf):
    return order.segments(A.reads(spark, sf))


REGIME_SQL = A.READS_SQL.replace(A.READ_COLUMNS["rg"], "case when event_id < (SELECT (min(event_id) + max(event_id)) / 2 FROM events) then 'rgA' else 'rgB' end")


@query(
    "rg_boundary",
    """SELECT min_by(label, first_ordinal) AS first_label, max_by(label, first_ordinal) AS second_label, max(first_ordinal) AS boundary_ordinal FROM (
      SELECT * FROM segments WHERE label <> '<missing>' AND records >= (SELECT greatest(count(*) // 10, 50) FROM reads) ORDER BY first_ordinal LIMIT 2)
    HAVING count(*) = 2 AND min_by(label, first_ordinal) <> max_by(label, first_ordinal) AND (SELECT count(*) FROM reads) >= 100""",
    REGIME_SQL,
    SEGMENTS_SQL,
)
def rg_boundary(spark, sf):
    events = A._table(spark, sf, "events")
    middle = events.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("middle"))
    halves = A.with_ordinal(events.select("event_id"), "event_id").join(F.broadcast(middle)).selectExpr("ordinal", "case when event_id < middle then 'rgA' else 'rgB' end AS rg")
    return order.rg_boundary(halves)


@query(
    "readname_regime_styles",
    """SELECT edge, style, count(*) AS records FROM (SELECT edge, CASE WHEN length(read_name) - length(replace(read_name, ':', '')) >= 3 THEN 'colon_delimited' WHEN contains(read_name, ' ') THEN 'space_delimited'
      WHEN contains(read_name, '/') THEN 'slash_delimited' WHEN regexp_full_match(read_name, '[0-9A-Fa-f]{1,12}(-[0-9A-Fa-f]{1,12}){4}') THEN 'uuid_like'
      WHEN contains(read_name, '_') OR contains(read_name, '-') THEN 'underscore_or_dash' ELSE 'simple' END AS style
      FROM (SELECT read_name, 'start' AS edge FROM reads WHERE ordinal < 256 UNION ALL SELECT read_name, 'end' AS edge FROM reads WHERE ordinal >= (SELECT count(*) FROM reads) - 256)) GROUP BY edge, style""",
    A.READS_SQL,
)
def readname_regime_styles(spark, sf):
    return order.edge_windows(A.reads(spark, sf)).groupBy("edge", E.name_style().alias("style")).agg(F.count(F.lit(1)).alias("records"))


@query(
    "readname_regime",
    """SELECT max(CASE WHEN edge = 'start' THEN style END) AS start_style, max(CASE WHEN edge = 'end' THEN style END) AS end_style
    FROM (SELECT edge, CASE WHEN read_name LIKE '%:%:%:%' THEN 'colon_delimited' WHEN read_name LIKE '%\\_%' ESCAPE '\\' THEN 'underscore_or_dash' ELSE 'simple' END AS style, count(*) AS n, sum(count(*)) OVER (PARTITION BY edge) AS size
      FROM (SELECT edge, CASE WHEN ordinal * 2 > last THEN 'run_' || ordinal ELSE 'a:b:c:d' END AS read_name
        FROM (SELECT ordinal, max(ordinal) OVER () AS last FROM reads) JOIN (VALUES ('start'), ('end')) AS e(edge) ON (edge = 'start' AND ordinal < 256) OR (edge = 'end' AND ordinal > last - 256))
      GROUP BY 1, 2) WHERE size >= 16 AND n >= 0.8 * size
    HAVING max(CASE WHEN edge = 'start' THEN style END) <> max(CASE WHEN edge = 'end' THEN style END)""",
    A.READS_SQL,
)
def readname_regime(spark, sf):
    reads = A.reads(spark, sf)
    last = reads.agg(F.max("ordinal").alias("last"))
    shifted = reads.join(F.broadcast(last)).withColumn("read_name", F.when(F.col("ordinal") > F.col("last") / 2, F.concat(F.lit("run_"), F.col("ordinal").cast("string"))).otherwise(F.lit("a:b:c:d")))
    return order.readname_regime(shifted.drop("last"))


@query(
    "tag_schema_shift",
    """SELECT s.mean AS start_mean_tags, e.mean AS end_mean_tags, s.tags AS start_prevalent, e.tags AS end_prevalent FROM
      (SELECT count(*) AS n, avg(CASE WHEN ordinal < 300 THEN 3 ELSE 1 END) AS mean, CASE WHEN 10 * count(*) FILTER (WHERE ordinal < 300) >= 6 * count(*) THEN 'AS,MD,NM' ELSE 'NM' END AS tags FROM reads WHERE ordinal < 256) s,
      (SELECT count(*) AS n, avg(CASE WHEN ordinal < 300 THEN 3 ELSE 1 END) AS mean, CASE WHEN 10 * count(*) FILTER (WHERE ordinal < 300) >= 6 * count(*) THEN 'AS,MD,NM' ELSE 'NM' END AS tags FROM reads WHERE ordinal >= (SELECT count(*) FROM reads) - 256) e
    WHERE s.n >= 16 AND e.n >= 16 AND (abs(s.mean - e.mean) >= 1.5 OR s.tags <> e.tags)""",
    A.READS_SQL,
)
def tag_schema_shift(spark, sf):
    reads = A.reads(spark, sf)
    return order.tag_schema_shift(reads.withColumn("tags", F.when(F.col("ordinal") < 300, F.array(F.lit("NM"), F.lit("MD"), F.lit("AS"))).otherwise(F.array(F.lit("NM")))))


IDENTITY_SQL = "read_name || chr(31) || sequence || chr(31) || coalesce(quality, '*')"


@query(
    "dup_summary",
    f"""SELECT count(*) AS unique_identities, count(*) FILTER (WHERE n > 1) AS duplicate_identities, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS bigint) AS duplicate_records,
    CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS bigint) AS duplicate_instances_beyond_first, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS double) / greatest(sum(n), 1) AS fraction_duplicate_records,
    CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS double) / greatest(sum(n), 1) AS fraction_duplicate_instances_beyond_first FROM (SELECT count(*) AS n FROM copies GROUP BY {IDENTITY_SQL})""",
    A.COPIES_SQL,
)
def dup_summary(spark, sf):
    return duplicates.dup_summary(A.copies(spark, sf))


@query(
    "dup_examples",
    f"""SELECT min_by(read_name, ordinal) AS read_name, count(*) AS records, min_by(CASE WHEN length(sequence) > 24 THEN substring(sequence, 1, 24) || '...' ELSE sequence END, ordinal) AS sequence_preview
    FROM copies GROUP BY {IDENTITY_SQL} HAVING count(*) > 1 ORDER BY records DESC, read_name, sequence_preview LIMIT 3""",
    A.COPIES_SQL,
)
def dup_examples(spark, sf):
    return duplicates.dup_examples(A.copies(spark, sf))


@query("block_self_join", "SELECT a.ordinal, coalesce(a.read_name = b.read_name AND a.sequence = b.sequence, false) AS equal FROM copies a LEFT JOIN copies b ON b.ordinal = a.ordinal + 3", A.COPIES_SQL)
def block_self_join(spark, sf):
    return duplicates.repeats_at(A.copies(spark, sf), 3)


def _doubled(spark, sf) -> tuple[DataFrame, int]:
    """All documents and then all of them again, and how many they are."""
    copies = A.copies(spark, sf)
    count = copies.count()
    return copies.unionByName(copies.withColumn("ordinal", F.col("ordinal") + count)), count


DOUBLED_SQL = "doubled AS (SELECT ordinal, read_name, sequence FROM copies UNION ALL SELECT ordinal + (SELECT count(*) FROM copies) AS ordinal, read_name, sequence FROM copies)"


DOUBLED_LEFT_SQL = """SELECT ordinal, read_name FROM doubled d WHERE NOT EXISTS (SELECT 1 FROM doubled e
    WHERE e.ordinal = d.ordinal - (SELECT count(*) FROM copies) AND e.read_name = d.read_name AND e.sequence = d.sequence)"""


@query("dedup_apply", DOUBLED_LEFT_SQL, A.COPIES_SQL, DOUBLED_SQL)
def dedup_apply(spark, sf):
    doubled, count = _doubled(spark, sf)
    return duplicates.deduplicate(doubled, min_block=count).select("ordinal", "read_name")


@query("dedup_whole_file_append", DOUBLED_LEFT_SQL, A.COPIES_SQL, DOUBLED_SQL)
def dedup_whole_file_append(spark, sf):
    doubled, count = _doubled(spark, sf)
    return duplicates.deduplicate(doubled, "whole-file-append", min_block=count).select("ordinal", "read_name")


@query(
    "adjacent_blocks",
    """SELECT min(a.ordinal) AS first, min(b.ordinal) AS second, count(*) AS records FROM doubled a JOIN doubled b ON b.ordinal = a.ordinal + (SELECT count(*) FROM copies)
    WHERE a.read_name = b.read_name AND a.sequence = b.sequence HAVING count(*) > 0 AND count(*) = (SELECT count(*) FROM copies)""",
    A.COPIES_SQL,
    DOUBLED_SQL,
)
def adjacent_blocks(spark, sf):
    return spark.createDataFrame(duplicates.adjacent_blocks(*_doubled(spark, sf)), "first long, second long, records long")


@query(
    "inspect_duplication",
    """SELECT 'whole_file_append_duplicate' AS finding, 'high' AS confidence, 'strong' AS evidence_strength, 1 AS first_1, n AS last_1, n + 1 AS first_2, 2 * n AS last_2
      FROM (SELECT count(*) AS n FROM copies) WHERE n > 0 AND n = (SELECT count(*) FROM doubled a JOIN doubled b ON b.ordinal = a.ordinal + n WHERE a.read_name = b.read_name AND a.sequence = b.sequence)
    UNION ALL SELECT 'exact_record_duplicate', CASE WHEN 4 * sum(k) FILTER (WHERE k > 1) >= sum(k) THEN 'high' ELSE 'medium' END, 'moderate', NULL, NULL, NULL, NULL
      FROM (SELECT count(*) AS k FROM doubled GROUP BY read_name, sequence) HAVING count(*) FILTER (WHERE k > 1) > 0""",
    A.COPIES_SQL,
    DOUBLED_SQL,
)
def inspect_duplication(spark, sf):
    doubled, count = _doubled(spark, sf)
    return duplicates.duplication_findings(doubled, min_block=count)


@query("merge_input", "SELECT ordinal, read_name, 0 AS file_no FROM reads UNION ALL SELECT ordinal + (SELECT count(*) FROM reads) AS ordinal, read_name, 1 AS file_no FROM reads", A.READS_SQL)
def merge_input(spark, sf):
    reads = A.reads(spark, sf)
    return rewrite.merge([reads, reads]).select("ordinal", "read_name", "file_no")


@query("merge_sorted", f"SELECT ordinal, ref_id, pos FROM (SELECT * FROM reads UNION ALL SELECT * REPLACE (ordinal + (SELECT count(*) FROM reads) AS ordinal) FROM reads)", A.READS_SQL)
def merge_sorted(spark, sf):
    reads = A.reads(spark, sf)
    return rewrite.merge([reads, reads], "coordinate").select("ordinal", "ref_id", "pos")


@query(
    "consume_unmapped",
    "SELECT ordinal, read_name, -1 AS ref_id, -1 AS pos, 0 AS mapq, 4 AS flags, 4680 AS bin, CAST(length(sequence) AS int) AS l_seq FROM copies",
    A.COPIES_SQL,
)
def consume_unmapped(spark, sf):
    fastq = A.copies(spark, sf).withColumn("source", F.lit("documents"))
    return rewrite.fastq_to_unmapped(fastq).select("ordinal", "read_name", "ref_id", "pos", "mapq", "flags", "bin", "l_seq")


@query("bam_to_fastq", "SELECT ordinal, '@' || read_name || chr(10) || sequence || chr(10) || '+' || chr(10) || repeat('!', length(sequence)) || chr(10) AS record FROM copies", A.COPIES_SQL)
def bam_to_fastq(spark, sf):
    return rewrite.to_fastq_text(A.copies(spark, sf))


@query("reg2bin", "SELECT ordinal, CASE WHEN a >> 14 = z >> 14 THEN 4681 + (a >> 14) WHEN a >> 17 = z >> 17 THEN 585 + (a >> 17) WHEN a >> 20 = z >> 20 THEN 73 + (a >> 20) WHEN a >> 23 = z >> 23 THEN 9 + (a >> 23) WHEN a >> 26 = z >> 26 THEN 1 + (a >> 26) ELSE 0 END AS bin FROM (SELECT ordinal, greatest(pos, 0) * 4000 AS a, greatest(pos, 0) * 4000 + l_seq * l_seq * 10 - 1 AS z FROM reads)", A.READS_SQL)
def reg2bin(spark, sf):
    begin = F.greatest(F.col("pos"), F.lit(0)) * 4000
    return A.reads(spark, sf).select("ordinal", E.reg2bin(begin, begin + F.col("l_seq") * F.col("l_seq") * 10).alias("bin"))


#: Written out apart from the rules that they check: (severity, code, condition) with flag bits as remainders.
RULES_SQL = " UNION ALL ".join(
    f"SELECT '{severity}' AS severity, 'record' AS scope, '{code}' AS code, ordinal + 1 AS record_index FROM reads WHERE {condition}"
    for severity, code, condition in (
        ("error", "invalid_block_size", "NOT block_size >= 32"),
        ("error", "empty_read_name", "length(read_name) = 0"),
        ("warning", "control_character_in_read_name", "len(list_filter(string_split(read_name, ''), lambda c: unicode(c) < 32 OR unicode(c) = 127)) > 0"),
        ("error", "contradictory_mapping_state", "CASE WHEN (flags // 4) % 2 = 1 THEN ref_id > -1 ELSE ref_id < 0 END"),
        ("error", "negative_position_for_mapped_record", "(flags // 4) % 2 = 0 AND sign(pos) = -1"),
        ("warning", "mate_position_inconsistency", "next_ref_id > -1 AND sign(next_pos) = -1"),
        ("warning", "proper_pair_without_paired_flag", "flags % 4 = 2"),
        ("warning", "read1_and_read2_both_set", "(flags // 64) % 4 = 3"),
        ("warning", "secondary_and_supplementary_both_set", "(flags // 256) % 2 + (flags // 2048) % 2 = 2"),
        ("warning", "mapped_record_without_cigar", "(flags // 4) % 2 + n_cigar = 0"),
    )
)


@query("validate_records", RULES_SQL, A.READS_SQL)
def validate_records(spark, sf):
    return validate.record_findings(A.reads(spark, sf))


@query("validate_aux", "SELECT 'warning' AS severity, 'aux' AS scope, 'duplicate_aux_tag' AS code, ordinal + 1 AS record_index, 'NM' AS tag FROM reads WHERE tag_text = 'NM,MD,NM'", A.READS_SQL)
def validate_aux(spark, sf):
    return validate.aux_findings(A.reads(spark, sf))


@query(
    "validate_aux_region",
    """SELECT CASE WHEN k IN (0, 6) THEN 'warning' ELSE 'error' END AS severity, 'aux' AS scope, CASE WHEN k IN (0, 6) THEN 'duplicate_aux_tag' ELSE 'malformed_aux_region' END AS code, ordinal + 1 AS record_index, CASE WHEN k = 0 THEN 'NM' WHEN k = 6 THEN 'XB' END AS tag
      FROM (SELECT ordinal, ordinal % 9 AS k FROM reads) WHERE k IN (0, 1, 2, 3, 4, 5, 6)
    UNION ALL SELECT 'error', 'aux', 'malformed_aux_region', ordinal + 1, NULL FROM reads WHERE ordinal % 9 = 6""",
    A.READS_SQL,
)
def validate_aux_region(spark, sf):
    return validate.aux_region_findings(A.aux_regions(spark, sf)).select("severity", "scope", "code", "record_index", "tag")


@query(
    "validate_damage",
    """SELECT 'error' AS severity, 'record' AS scope, CASE WHEN block_size < 32 OR available >= block_size THEN 'invalid_record' ELSE 'truncated_record' END AS code, ordinal + 1 AS record_index
    FROM layout WHERE ordinal = (SELECT min(ordinal) FROM layout WHERE least(block_size - 32, available - block_size, block_size - fields_size) < 0)""",
    A.READS_SQL,
    A.LAYOUT_SQL,
)
def validate_damage(spark, sf):
    return validate.damage_findings(A.layout(spark, sf))


@query(
    "validate_eof",
    """SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'info' ELSE 'warning' END AS severity, 'file' AS scope, CASE WHEN n_nationkey % 3 = 0 THEN 'bgzf_eof_present' ELSE 'missing_bgzf_eof' END AS code, n_name AS source FROM nation""",
)
def validate_eof(spark, sf):
    return validate.eof_findings(A.tails(spark, sf))


@query("validate_header_parse", "SELECT 'error' AS severity, 'header' AS scope, 'invalid_header' AS code, n_name AS source FROM nation WHERE n_nationkey % 5 BETWEEN 1 AND 3")
def validate_header_parse(spark, sf):
    return validate.header_parse_findings(A.binary_headers(spark, sf))


@query(
    "validate_header",
    """SELECT 'warning' AS severity, 'header' AS scope, 'reference_length_mismatch' AS code, refs.name AS reference_name FROM refs JOIN sq ON refs.name = sq.name WHERE refs.length <> sq.length
    UNION ALL SELECT 'warning', 'header', 'textual_sq_not_in_binary_dictionary', name FROM sq WHERE name NOT IN (SELECT name FROM refs)
    UNION ALL SELECT 'warning', 'header', 'duplicate_program_id', id FROM programs GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'warning', 'header', 'duplicate_read_group_id', id FROM groups GROUP BY id HAVING count(*) > 1""",
    A.REFS_SQL,
    A.SQ_SQL,
    A.GROUPS_SQL,
    A.PROGRAMS_SQL,
)
def validate_header(spark, sf):
    return validate.header_findings(A.refs(spark, sf), A.sq(spark, sf), A.groups(spark, sf), A.programs(spark, sf))


@query("finding_rollup", f"SELECT severity, code, count(*) AS findings FROM ({RULES_SQL}) GROUP BY severity, code", A.READS_SQL)
def finding_rollup(spark, sf):
    return validate.finding_rollup(validate.record_findings(A.reads(spark, sf)))


@query(
    "validate_caps",
    f"SELECT severity, code, record_index, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY severity ORDER BY record_index, code) AS int) AS rank FROM ({RULES_SQL})) WHERE rank <= 20",
    A.READS_SQL,
)
def validate_caps(spark, sf):
    return validate.capped(validate.record_findings(A.reads(spark, sf)), 20, 20).select("severity", "code", "record_index", "rank")


RECORD_BYTES_SQL = "octet_length(encode(a)) || ':' || a || '|' || octet_length(encode(read_name)) || ':' || read_name"
RECORD_FIELDS_SQL = "(SELECT *, concat_ws(',', ref_id, pos, mapq, flags, next_ref_id, next_pos, tlen) AS a FROM reads)"


@query("record_digest", f"SELECT ordinal, sha256({RECORD_BYTES_SQL}) AS digest FROM {RECORD_FIELDS_SQL}", A.READS_SQL)
def record_digest(spark, sf):
    return A.reads(spark, sf).select("ordinal", checksum.record_digest().alias("digest"))


@query(
    "checksum_multiset",
    f"""SELECT count(*) AS records, {", ".join(f"bit_xor(w{i}) AS xor_{i}, CAST(sum(w{i}) AS bigint) AS sum_{i}" for i in range(8))}
    FROM (SELECT {", ".join(f"CAST('0x' || substring(d, {1 + 8 * i}, 8) AS bigint) AS w{i}" for i in range(8))} FROM (SELECT sha256({RECORD_BYTES_SQL}) AS d FROM {RECORD_FIELDS_SQL}))""",
    A.READS_SQL,
)
def checksum_multiset(spark, sf):
    return checksum.checksum_multiset(A.reads(spark, sf))


@query(
    "checksum_canonical",
    # lengths are under 128, so a length as 64 bits is its character and seven NULs
    f"""SELECT 'raw' AS mode, sha256(string_agg(chr(CAST(length(b) AS int)) || repeat(chr(0), 7) || b, '' ORDER BY ordinal)) AS digest FROM (SELECT ordinal, {RECORD_BYTES_SQL} AS b FROM {RECORD_FIELDS_SQL})
    UNION ALL SELECT 'canonical', sha256(string_agg(chr(64) || repeat(chr(0), 7) || d, '' ORDER BY d)) FROM (SELECT sha256({RECORD_BYTES_SQL}) AS d FROM {RECORD_FIELDS_SQL})""",
    A.READS_SQL,
)
def checksum_canonical(spark, sf):
    reads = A.reads(spark, sf)
    return spark.createDataFrame([("raw", checksum.checksum_in_order(reads)), ("canonical", checksum.checksum_canonical(reads))], "mode string, digest string")


#: The n-th output of a 64-bit generator with a fixed increment, written with 128-bit products.
DRAW_SQL = """draws AS (SELECT ordinal, read_name, xor(x2, x2 >> 31) AS draw FROM (SELECT *, CAST((CAST(xor(x1, x1 >> 27) AS uhugeint) * 10723151780598845931) % 18446744073709551616 AS ubigint) AS x2
    FROM (SELECT *, CAST((CAST(xor(x0, x0 >> 30) AS uhugeint) * 13787848793156543929) % 18446744073709551616 AS ubigint) AS x1
      FROM (SELECT ordinal, read_name, CAST((7 + CAST(row_number() OVER (ORDER BY ordinal) AS uhugeint) * 11400714819323198485) % 18446744073709551616 AS ubigint) AS x0 FROM reads WHERE ref_id >= 0 AND (flags // 4) % 2 = 0))))"""


@query("subsample_random", "SELECT ordinal, read_name FROM draws WHERE draw <= 4611686018427387904", A.READS_SQL, DRAW_SQL)
def subsample_random(spark, sf):
    return sample.subsample_random(A.reads(spark, sf), 0.25, 7, mapped_only=True).select("ordinal", "read_name")


@query(
    "subsample_hash",
    # a fold over the bytes of name, NUL and text: exclusive or, then a product modulo 2^64; kept up to half of the largest value as a double
    """SELECT ordinal, read_name FROM (SELECT ordinal, read_name, list_reduce(list_prepend(CAST(14695981039346656037 AS uhugeint),
        list_transform(regexp_extract_all(hex(encode(read_name || chr(0) || sequence)), '..'), lambda h: CAST('0x' || h AS uhugeint))),
        lambda v, b: (CAST(xor(CAST(v AS ubigint), CAST(b AS ubigint)) AS uhugeint) * 1099511628211) % 18446744073709551616) AS h FROM copies) WHERE h <= 9223372036854775808""",
    A.COPIES_SQL,
)
def subsample_hash(spark, sf):
    return sample.subsample_hash(A.copies(spark, sf), 0.5, sample.fastq_identity("qname_seq")).select("ordinal", "read_name")


@query(
    "forensic_header",
    """SELECT 'header_anomaly' AS category, 'high' AS severity, 'Read group declared more than once: ' || id AS message FROM groups GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'header_anomaly', 'warning', 'Sample on several platforms: ' || sample || ' (' || string_agg(DISTINCT platform, ',' ORDER BY platform) || ')' FROM groups GROUP BY sample HAVING count(DISTINCT platform) > 1
    UNION ALL SELECT 'program_chain_anomaly', 'high', 'Program declared more than once: ' || id FROM programs GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'program_chain_anomaly', 'warning', 'Parent of ' || id || ' isn''t declared: ' || previous_program_id FROM programs WHERE previous_program_id IS NOT NULL AND previous_program_id NOT IN (SELECT id FROM programs)
    UNION ALL SELECT 'program_chain_anomaly', 'warning', 'Program chains are not connected; roots: ' || count(*) FROM programs WHERE previous_program_id IS NULL OR previous_program_id NOT IN (SELECT id FROM programs) HAVING count(*) > 1""",
    A.GROUPS_SQL,
    A.PROGRAMS_SQL,
)
def forensic_header(spark, sf):
    found = forensic.forensic_findings(None, A.groups(spark, sf), A.programs(spark, sf), ("header", "pg"), max_findings=1000)
    return found.select("category", "severity", "message")


@query(
    "forensic_read_groups",
    """SELECT 'read_group_anomaly' AS category, 'high' AS severity, 'Records name an undeclared read group: ' || rg AS message FROM reads WHERE rg IS NOT NULL AND rg NOT IN (SELECT id FROM groups) GROUP BY rg
    UNION ALL SELECT 'read_group_anomaly', 'warning', count(*) FILTER (WHERE rg IS NULL) || ' records have no read group while others do' FROM reads HAVING count(*) FILTER (WHERE rg IS NULL) >= 0.1 * count(*) AND count(rg) > 0""",
    A.READS_SQL,
    A.GROUPS_SQL,
)
def forensic_read_groups(spark, sf):
    found = forensic.forensic_findings(A.reads(spark, sf), A.groups(spark, sf), A.programs(spark, sf), ("rg",))
    return found.select("category", "severity", "message")


@query(
    "forensic_inspect",
    """SELECT least(n, 25) AS findings, n > 0 AS suspicion_detected, false AS likely_concatenation_or_coercion FROM (SELECT
      (SELECT count(*) FROM (SELECT id FROM groups GROUP BY id HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT sample FROM groups GROUP BY sample HAVING count(DISTINCT platform) > 1))
      + (SELECT count(*) FROM (SELECT id FROM programs GROUP BY id HAVING count(*) > 1)) + (SELECT count(*) FROM programs WHERE previous_program_id IS NOT NULL AND previous_program_id NOT IN (SELECT id FROM programs))
      + (SELECT CASE WHEN count(*) > 1 THEN 1 ELSE 0 END FROM programs WHERE previous_program_id IS NULL OR previous_program_id NOT IN (SELECT id FROM programs)) AS n)""",
    A.GROUPS_SQL,
    A.PROGRAMS_SQL,
)
def forensic_inspect(spark, sf):
    copies = A.copies(spark, sf).withColumn("rg", F.lit(None).cast("string")).withColumn("tags", F.array(F.lit("NM")))
    found = forensic.forensic_findings(copies, A.groups(spark, sf), A.programs(spark, sf))
    return forensic.assessment(found, full_scan=True, body=True)


@query("exclude_tags", "SELECT ordinal, CASE tag_text WHEN 'NM' THEN '' ELSE 'MD' END AS left_tags FROM reads", A.READS_SQL)
def exclude_tags(spark, sf):
    left = rewrite.exclude_tags(F.col("aux"), ("NM",))
    return _aux(A.reads(spark, sf)).select("ordinal", F.array_join(F.transform(left, lambda a: a["tag"]), ",").alias("left_tags"))


@query(
    "identity_modes",
    f"""SELECT ordinal, read_name || chr(31) || sequence AS qname_seq, {IDENTITY_SQL} AS qname_seq_qual, {IDENTITY_SQL} || chr(31) AS qname_seq_qual_rg,
    CASE WHEN length(sequence) > 24 THEN substring(sequence, 1, 24) || '...' ELSE sequence END AS preview FROM copies""",
    A.COPIES_SQL,
)
def identity_modes(spark, sf):
    copies = A.copies(spark, sf).withColumn("rg", F.lit(None).cast("string"))
    return copies.select("ordinal", *[E.identity(m).alias(m) for m in ("qname_seq", "qname_seq_qual", "qname_seq_qual_rg")], E.preview("sequence").alias("preview"))


@query("cigar_span", "SELECT ordinal, CAST(l_seq + 2 * n_cigar + 7 AS bigint) AS span FROM reads", A.READS_SQL)
def cigar_span(spark, sf):
    made = F.concat(F.lit("5S"), F.col("l_seq").cast("string"), F.lit("M3I"), (2 * F.col("n_cigar")).cast("string"), F.lit("D7N4H"))
    return A.reads(spark, sf).withColumn("cigar_text", made).select("ordinal", E.cigar_span("cigar_text").alias("span"))


@query("sam_rname", "SELECT ordinal, CAST(coalesce(refs.index, -1) AS int) AS ref_id FROM (SELECT ordinal, CASE WHEN ref_id < 0 THEN '*' ELSE 'NATION_' || ref_id END AS rname FROM reads) LEFT JOIN refs ON rname = refs.name", A.READS_SQL, A.REFS_SQL)
def sam_rname(spark, sf):
    named = A.reads(spark, sf).select("ordinal", F.when(F.col("ref_id") < 0, "*").otherwise(F.concat(F.lit("NATION_"), F.col("ref_id").cast("string"))).alias("name"))
    return named.join(A.refs(spark, sf).select("name", "index"), "name", "left").select("ordinal", F.coalesce("index", F.lit(-1)).alias("ref_id"))


@query("consume_alignment", "SELECT ordinal, read_name, ref_id FROM reads UNION ALL SELECT ordinal + (SELECT count(*) FROM reads), read_name, ref_id FROM reads", A.READS_SQL)
def consume_alignment(spark, sf):
    refs = A.refs(spark, sf)
    reads = A.reads(spark, sf)
    if not rewrite.dictionary_differences(refs, refs).isEmpty():
        raise ValueError("incompatible references")
    return rewrite.merge([reads, reads]).select("ordinal", "read_name", "ref_id")


MULTISET = "read_name, ref_id, pos, flags, next_ref_id, next_pos, tlen"


@query(
    "multiset_equality",
    f"""SELECT NOT EXISTS (SELECT {MULTISET} FROM (SELECT * FROM reads ORDER BY read_name) EXCEPT ALL SELECT {MULTISET} FROM reads) AS sorted_equals,
    NOT EXISTS (SELECT {MULTISET} FROM reads EXCEPT ALL SELECT {MULTISET} FROM reads WHERE ordinal < 100) AS bounded_equals""",
    A.READS_SQL,
)
def multiset_equality(spark, sf):
    reads = A.reads(spark, sf).select("ordinal", "read_name", "ref_id", "pos", "flags", "next_ref_id", "next_pos", "tlen")
    same = rewrite.same_multiset(reads, order.sort_reads(reads, "queryname"))
    return spark.createDataFrame([(same, rewrite.same_multiset(reads, profile.bounded(reads, 100)))], "sorted_equals boolean, bounded_equals boolean")


@query("finding_order", "SELECT 'header_anomaly' AS category, 'high' AS severity, id AS message FROM (SELECT 'Read group declared more than once: ' || id AS id FROM groups GROUP BY id HAVING count(*) > 1) ORDER BY message LIMIT 1", A.GROUPS_SQL)
def finding_order(spark, sf):
    found = forensic.forensic_findings(None, A.groups(spark, sf), A.programs(spark, sf), ("header",), max_findings=1)
    return found.select("category", "severity", "message")


@query("validity", f"SELECT count(*) AS records_examined, (SELECT count(*) FROM ({RULES_SQL}) WHERE severity = 'error') AS errors, (SELECT count(*) FROM ({RULES_SQL}) WHERE severity = 'warning') AS warnings, false AS valid FROM reads", A.READS_SQL)
def validity(spark, sf):
    return validate.validity(A.reads(spark, sf))


@query("validity_fail_fast", f"SELECT count(*) AS records_examined FROM reads WHERE ordinal < (SELECT min(record_index) FROM ({RULES_SQL}) WHERE severity = 'error')", A.READS_SQL)
def validity_fail_fast(spark, sf):
    return validate.validity(A.reads(spark, sf), fail_fast=True).select("records_examined")
