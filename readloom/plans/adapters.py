"""Reads-shaped and header-shaped relations made from the driver's tables.

Column expressions are text that Spark and DuckDB read alike, so that both sides of
a comparison see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.ordinal import with_ordinal

READ_COLUMNS = {
    "read_name": "event_type || ':' || cast(user_id as varchar(20))",
    "ref_id": "cast(case when event_type = 'error' then -1 else user_id % 8 end as int)",
    "pos": "cast(case when event_id % 89 = 0 then -1 else (event_id * 37) % 5000 end as int)",
    "flags": "cast((event_id * 131) % 4096 as int)",
    "mapq": "cast(event_id % 61 as int)",
    "rg": "case when event_id % 7 = 0 then null else event_type end",
    "next_ref_id": "cast(case when event_id % 5 = 0 then -1 else user_id % 8 end as int)",
    "next_pos": "cast(case when event_id % 3 = 0 then -1 else (event_id * 53) % 5000 end as int)",
    "tlen": "cast((event_id * 17) % 1000 - 500 as int)",
    "l_seq": "cast(50 + event_id % 101 as int)",
    "n_cigar": "cast(event_id % 4 as int)",
    "block_size": "cast(20 + (event_id * 7) % 200 as int)",
    "tag_text": "case when event_id % 3 = 0 then 'NM' when event_id % 11 = 0 then 'NM,MD,NM' else 'NM,MD' end",
}
READS_SQL = "reads AS (SELECT cast(row_number() OVER (ORDER BY event_id) - 1 AS bigint) AS ordinal, " + ", ".join(f"{e} AS {n}" for n, e in READ_COLUMNS.items()) + " FROM events)"

#: Documents as raw reads with repeated identities.
COPIES_SQL = (
    "copies AS (SELECT cast(row_number() OVER (ORDER BY doc_id) - 1 AS bigint) AS ordinal, source AS read_name, text AS sequence, cast(null AS varchar(9)) AS quality FROM documents)"
)
REFS_SQL = "refs AS (SELECT cast(n_nationkey AS int) AS index, n_name AS name, cast(1000 + n_nationkey * 10 AS bigint) AS length FROM nation)"
SQ_SQL = "sq AS (SELECT n_name AS name, cast(1000 + n_nationkey * 10 + case when n_nationkey % 6 = 0 then 1 else 0 end AS bigint) AS length FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT 'extra_' || r_name AS name, cast(1 AS bigint) AS length FROM region)"
GROUPS_SQL = "groups AS (SELECT case when s_suppkey % 10 = 0 then 'click' else s_name end AS id, 'sample' || cast(s_nationkey AS varchar(9)) AS sample, case when s_suppkey % 3 = 0 then 'ILLUMINA' else 'ONT' end AS platform FROM supplier)"
PROGRAMS_SQL = "programs AS (SELECT p.id AS id, p.parent AS previous_program_id FROM (VALUES ('align', null), ('sort', 'align'), ('mark', 'sort'), ('mark', 'sort'), ('call', 'gone'), ('note', null)) AS p(id, parent))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = with_ordinal(_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_id")
    out = events.selectExpr("ordinal", *[f"{e} AS {n}" for n, e in READ_COLUMNS.items()])
    return out.withColumn("tags", F.split("tag_text", ",")).withColumn("source", F.lit("events"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_ordinal(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.selectExpr("ordinal", "source AS read_name", "text AS sequence", "cast(null AS string) AS quality")


def _header(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    body = sql[sql.index("(") + 1 : -1]
    for t in tables:
        body = body.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(body, **{t: _table(spark, sf_dir, t) for t in tables})


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header(spark, sf_dir, REFS_SQL, ("nation",))


def sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header(spark, sf_dir, SQ_SQL, ("nation", "region"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header(spark, sf_dir, GROUPS_SQL, ("supplier",))


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header(spark, sf_dir, PROGRAMS_SQL, ())


# Relations with damage, for validation: column expressions or hexadecimal text by a key.

LAYOUT_SQL = """layout AS (SELECT ordinal, block_size + 40 AS block_size, cast(60 + ordinal % 3 AS int) AS fields_size,
    cast(case when ordinal % 4999 = 4998 then block_size when ordinal % 6007 = 6006 then 10 else block_size + 40 end AS int) AS available FROM reads)"""

#: Aux regions by ordinal modulo 9: a tag twice, and regions that end too soon or hold an unknown type; the seventh is both.
AUX_HEX = (
    "4E4D43014E4D4302",  # NM:C twice
    "4E4D4301584200",  # XB has an unknown type
    "4E4D69010000",  # NM:i of three bytes
    "4D445A4143",  # MD:Z without its end
    "4E4D",  # a tag alone
    "4D4C424303000000010203FF4E",  # one byte too many after ML:B:C
    "5842430158424302584263",  # XB:C twice, then cut
    "4E4D43014D445A414300",  # NM:C, MD:Z
    "",
)


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = LAYOUT_SQL[LAYOUT_SQL.index("(") + 1 : -1].replace("FROM reads", "FROM {reads}")
    return spark.sql(body, reads=reads(spark, sf_dir))


def aux_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = F.array(*[F.unhex(F.lit(h)) for h in AUX_HEX])
    return reads(spark, sf_dir).select("ordinal", F.get(regions, (F.col("ordinal") % len(AUX_HEX)).cast("int")).alias("aux_bytes"))


def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last bytes of files: the end marker behind something, the marker cut short, or something else."""
    marker = "1f8b08040000000000ff0600424302001b0003000000000000000000"
    tail = F.when(F.expr("n_nationkey % 3 = 0"), F.unhex(F.lit("AB" + marker))).when(F.expr("n_nationkey % 3 = 1"), F.unhex(F.lit(marker[:-2]))).otherwise(F.encode("n_name", "UTF-8"))
    return _table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), tail.alias("tail"))


def binary_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary headers: whole for two keys of five, else with another magic, a name cut short, or no number of references."""
    whole = "42414D01" + "05000000" + "40434F0978" + "01000000" + "05000000" + "6368724100" + "88130000"
    kinds = F.array(*[F.unhex(F.lit(h)) for h in (whole, "42414D02" + whole[8:], whole[:-12], whole[:26], whole)])
    return _table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.get(kinds, F.expr("cast(n_nationkey % 5 as int)")).alias("header"))
