"""Queries over the synthetic tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import load
from .exact_dedup import exact_duplicates
from .lm_scoring import score_left_out
from .mixing import mix
from .near_dedup import NearOptions, near_duplicates
from .packing import pack
from .passages import repeated_passages
from .suffix_dedup import remove_repeats
from .token_store import read_token_store, write_token_store
from .toxicity import toxic_scores


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), NearOptions(shingle=3, percent=85, bands=48, rows=8))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), length=400).drop("kept")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_store(load(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return read_token_store(spark, manifest)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms to six places, as the order in which they are summed shows in the last ones."""
    scores = score_left_out(load(spark, sf_dir, "documents"))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op9_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(load(spark, sf_dir, "documents"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_collision_ann": op1_collision_ann,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_store": op6_token_store,
    "op7_mix_sources": op7_mix_sources,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_passage_chains": op9_passage_chains,
    "op10_pack_sequences": op10_pack_sequences,
}



def _repeated(name: str, length: int) -> str:
    """Relations of the maximal runs of bytes that strings of a length cover which start at two places, by texts in hexadecimal."""
    return f"""{name}_windows AS (SELECT k, i, md5_number(substr(hx, 2 * i + 1, {2 * length})) AS h FROM (SELECT k, hx, unnest(range(0, length(hx) // 2 - {length - 1})) AS i FROM d)),
        {name}_starts AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS n FROM {name}_windows) WHERE n > 1),
        {name}_runs AS (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM {name}_starts)),
        {name}_spans AS (SELECT k, run, min(i) AS a, max(i) + {length} AS z FROM {name}_runs GROUP BY k, run)"""


ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents
        ),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), chr(1)) AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.other = edge.a)
        SELECT r.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, r.doc_id = r.component_id AS kept
        FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r LEFT JOIN n ON n.doc_id = r.doc_id
    """,
    "op3_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM d
    """,
    "op5_suffix_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
        {_repeated("long", 400)},
        {_repeated("short", 256)},
        pieces AS (SELECT d.k, a, z, coalesce(lag(z) OVER (PARTITION BY d.k ORDER BY a), 0) AS after, hx FROM d JOIN long_spans ON long_spans.k = d.k),
        kept AS (SELECT k, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(substr(hx, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS before FROM pieces GROUP BY k),
        shared AS (SELECT k, sum(z - a) AS n_repeated, max(z - a) AS longest_repeat FROM short_spans GROUP BY k)
        SELECT doc_id, CAST(length(hx) // 2 AS bigint) AS n_bytes, CAST(coalesce(n_removed, 0) AS bigint) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(before, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256,
               CAST(coalesce(n_repeated, 0) AS bigint) AS n_repeated, CAST(coalesce(longest_repeat, 0) AS bigint) AS longest_repeat
        FROM d LEFT JOIN kept ON kept.k = d.k LEFT JOIN shared ON shared.k = d.k
    """,
    "op8_lm_scoring": r"""
        WITH d AS (
          SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents
        ),
        p AS (SELECT k, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS a, w[i] AS b FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        counted AS (
          SELECT k, count(*) OVER (PARTITION BY a, b) - count(*) OVER (PARTITION BY k, a, b) AS pairs, count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY k, a) AS contexts,
                 count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY k, b) AS words, count(*) OVER () - count(*) OVER (PARTITION BY k) AS others
          FROM p
        ),
        s AS (
          SELECT k, count(*) AS n_words, sum(ln(CASE WHEN pairs > 0 THEN pairs / contexts ELSE 0.4 * greatest(words, 0.5) / greatest(others, 1) END)) AS total, count(*) FILTER (WHERE pairs = 0) AS backed_off
          FROM counted GROUP BY k
        )
        SELECT doc_id, coalesce(n_words, 0) AS n_words, round(total, 6) AS log_score, round(total / n_words, 6) AS mean_log_score, coalesce(backed_off, 0) AS backed_off
        FROM d LEFT JOIN s ON s.k = d.k
    """,
}
