"""A training-data pipeline over ``documents``: stages that each apply one corpus operator.

All but the last return the columns of ``documents``, whatever further ones there
are. Every stage takes null or repeated doc_ids, null, empty and very long texts and
empty tables; what becomes of them is said where it isn't plain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.llm.common import Scratch
from readloom.llm.exact_dedup import deduplicate
from readloom.llm.mixing import mixed_documents
from readloom.llm.near_dedup import without_near_duplicates
from readloom.llm.packing import pack
from readloom.llm.queries import tokenizer_path
from readloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't call toxic. Texts without words score as the labels' balance does; without labels all stay."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the one with the smallest doc_id, once. Null and empty texts are equal; null ids come last."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more). Texts without words stay; those without a doc_id go if one with an id has their shingles."""
    return without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice. Texts without words go; a null source is a source."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens; a null or empty text is its end id."""
    return pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither the classifier, MinHash, the packing nor the tokenizer; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents in turn; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
