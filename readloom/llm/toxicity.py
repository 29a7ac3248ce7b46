"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Each coordinate has its own learning rate and an L1 threshold, so that most weights
stay exactly zero; the rest are a compact table of (index, weight) that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .kernels import U64, mix, release, text_slices, unique_per_row, words

#: Hashed coordinates; the weight table can't be larger than this.
BITS = 20
#: Labelled rows that the classifier is fitted on at most: those with the smallest hash of their doc_id.
TRAINING_ROWS = 16_000
#: Feature families: words, pairs of neighbours, pairs with one word between.
_SKIPS = (0, 1, 2)


@dataclass(frozen=True)
class FtrlOptions:
    """Rates of FTRL-proximal: alpha and beta set the per-coordinate rate, l1 and l2 the penalties."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 8


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of each text's distinct words, neighbour pairs and skip pairs (unsorted), and their bounds."""
    hashes, bounds = words(data, offsets)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found, owners = [hashes], [owner]
    for skip in _SKIPS[1:]:
        if len(hashes) > skip:
            same = owner[skip:] == owner[:-skip]
            pair = mix(hashes[:-skip] * U64(0x9FB21C651E98DF25) + hashes[skip:] + U64(skip))
            found.append(pair[same])
            owners.append(owner[skip:][same])
    value, row = np.concatenate(found) >> U64(64 - BITS), np.concatenate(owners)
    order = np.argsort(row, kind="stable")
    return value[order].astype(np.int64), np.searchsorted(row[order], np.arange(len(bounds)))


def train(rows: list[tuple[np.ndarray, int]], options: FtrlOptions) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero coordinates, their weights, and the bias. A row is (distinct coordinates, label)."""
    size = 1 << BITS
    z, n, bias_z, bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0

    def weight(zs, ns, l1):
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0)
        return -shrunk / ((options.beta + np.sqrt(ns)) / options.alpha + options.l2)

    for epoch in range(options.epochs):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for i in order:
            at, label = rows[i]
            w = weight(z[at], n[at], options.l1)
            bias = float(weight(np.float64(bias_z), np.float64(bias_n), 0.0))
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / options.alpha
            z[at] += g - step * w
            n[at] += g * g
            step = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / options.alpha
            bias_z += g - step * bias
            bias_n += g * g
    w = weight(z, n, options.l1)
    at = np.flatnonzero(w)
    return at, w[at], float(weight(np.float64(bias_z), np.float64(bias_n), 0.0))


def _feature_rows(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        labels = batch.column("label").to_pylist()
        for first, data, offsets in text_slices(batch.column("text")):
            value, bounds = features(data, offsets)
            value, bounds = unique_per_row(value, bounds)
            packed = value.astype("<i4")
            blobs = [packed[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(labels[first : first + len(blobs)], pa.int32()), pa.array(blobs, pa.binary())], ["label", "at"])


def _trainer(options: FtrlOptions):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["label", "at"])  # the result doesn't depend on the order of arrival
        rows = [(np.frombuffer(a, "<i4"), int(y)) for a, y in zip(pdf["at"], pdf["label"], strict=True)]
        at, w, bias = train(rows, options)
        return pd.DataFrame({"at": np.concatenate([[-1], at]), "weight": np.concatenate([[bias], w])})

    return fit


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: Column | None = None, options: FtrlOptions | None = None, rows: int = TRAINING_ROWS) -> DataFrame:
    """Weights (at, weight) with the bias at -1, fitted on labelled documents that ``held_out`` leaves.

    At most ``rows`` labelled documents train (a bounded sample by hash of doc_id,
    the same on every run). Rows without a label or doc_id are not used; of several
    labels of a document the largest counts. Without any training row the result
    is a bias of 0.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = scratch.table(chosen, "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = texts.join(F.broadcast(chosen), "doc_id").select("label", "text")
    sample = scratch.table(labelled.mapInArrow(_feature_rows, "label int, at binary"), "features")
    weights = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_trainer(options or FtrlOptions()), "at long, weight double")
    return scratch.table(weights, "weights")


def _scorer(at: np.ndarray, weight: np.ndarray, bias: float):
    """A function that makes a scorer of text columns: once a task, since it holds a table of all coordinates."""

    def make():
        release()
        table = np.zeros(1 << BITS)
        table[at] = weight

        def scores(column: pa.Array) -> np.ndarray:
            out = np.empty(len(column))
            for first, data, offsets in text_slices(column):
                value, bounds = features(data, offsets)
                value, bounds = unique_per_row(value, bounds)
                sums = np.concatenate([[0.0], np.cumsum(table[value])])
                z = sums[bounds[1:]] - sums[bounds[:-1]] + bias
                out[first : first + len(z)] = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
            return out

        return scores

    return make


def collected(weights: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and bias on the driver: no more rows than hashed coordinates, whatever the input."""
    rows = weights.collect()
    bias = next((r["weight"] for r in rows if r["at"] == -1), 0.0)
    kept = [r for r in rows if r["at"] >= 0]
    return np.array([r["at"] for r in kept], np.int64), np.array([r["weight"] for r in kept], float), bias


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, of whole texts). Null and empty texts get the bias alone."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    make = _scorer(*collected(weights))

    def scored(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = make()
        for batch in arrow:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text")))], ["doc_id", "score"])
            release()

    return texts.mapInArrow(scored, "doc_id long, score double")


def fifth(doc_id: Column) -> Column:
    """Whether a document is in the held-out fifth: crc32 of its doc_id as text leaves no rest by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxic_scores(docs: DataFrame, labels: DataFrame, options: FtrlOptions | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; fitted on labels outside the held-out fifth only.

    Repeated rows are scored each; a null doc_id is scored, its crc32 that of the
    empty string. Labels of documents that aren't there are ignored; empty tables
    give no rows, or with no labels a score of 0.5.
    """
    weights = fit(docs, labels, held_out=fifth(F.col("doc_id")), options=options)
    scored = score(docs, weights)
    return scored.select("doc_id", fifth(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below the threshold.

    Scores ride along with the rows, so nothing is joined and no name can clash.
    Null and empty texts score the bias alone; null doc_ids and repeated rows are
    scored as they are. Without labels every score is 0.5, and nothing tells a toxic
    text; all documents stay then. An empty table gives no rows.
    """
    at, weight, bias = collected(fit(docs, labels, held_out=fifth(F.col("doc_id"))))
    if not len(at) and not bias:
        return docs
    make = _scorer(at, weight, bias)
    small_batches(docs.sparkSession)

    def keep(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = make()
        for batch in arrow:
            yield batch.filter(pa.array(scores(batch.column("text").cast(pa.string())) < threshold))
            release()  # what a batch took isn't to add up with what later stages take

    return docs.mapInArrow(keep, docs.schema)
