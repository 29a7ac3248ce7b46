"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on ``projections`` random lines and each line's values are
sorted. Around a query's value on each line a window opens and widens step by step
(virtual rehashing: the same sorted arrays serve every radius). A vector that falls
into enough of the windows is verified by its exact cosine. Widening stops once the
k-th best verified vector lies within the radius that the windows stand for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch


@dataclass(frozen=True)
class AnnOptions:
    """A vector at the radius collides with probability 0.746 a line (half width 1.14 of the radius); 0.66 of the lines are asked for."""

    projections: int = 96
    half_width: float = 1.14
    threshold: float = 0.66
    radii: tuple[float, ...] = (0.1, 0.5, 0.9, 1.03, 1.12, 1.22, 1.4, 2.0, float("inf"))
    tile_rows: int = 32_768
    tile_queries: int = 8_192
    seed: int = 5


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).astype(np.float64).reshape(-1, dim) if flat else np.empty((0, dim))


class CollisionIndex:
    """Sorted projections of one tile of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, options: AnnOptions):
        self.options, self.ids, self.vectors = options, ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        lines = np.random.default_rng(options.seed).standard_normal((vectors.shape[1], options.projections))
        self.lines = lines
        values = ((vectors / self.norms[:, None]) @ lines).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, axis=1)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the nearest found, best first, ties to smaller ids; the query's own id takes no part."""
        o, n = self.options, len(self.ids)
        norm = np.sqrt((query * query).sum())
        at = (query / norm) @ self.lines
        need = int(np.ceil(o.threshold * o.projections))
        counts, done = np.zeros(n, np.uint8 if o.projections < 256 else np.int32), self.ids == query_id
        low = high = None
        found, scores = np.empty(0, np.int64), np.empty(0)
        for radius in o.radii:
            lows = np.array([np.searchsorted(s, v) for s, v in zip(self.sorted, at - o.half_width * radius, strict=True)])
            highs = np.array([np.searchsorted(s, v, "right") for s, v in zip(self.sorted, at + o.half_width * radius, strict=True)])
            for j in range(o.projections):
                if low is None:
                    counts[self.order[j, lows[j] : highs[j]]] += 1
                else:
                    counts[self.order[j, lows[j] : low[j]]] += 1
                    counts[self.order[j, high[j] : highs[j]]] += 1
            low, high = lows, highs
            fresh = np.flatnonzero((counts >= need) & ~done)
            done[fresh] = True
            found = np.concatenate([found, fresh])
            scores = np.concatenate([scores, (self.vectors[fresh] * query).sum(axis=1) / (self.norms[fresh] * norm)])
            if len(found) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                if np.sqrt(max(2 - 2 * kth, 0)) <= radius:
                    break
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found[best]], scores[best]


def _tile(options: AnnOptions, k: int):
    def search(data: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if data.num_rows and queries.num_rows:
            dim = data.column("dim")[0].as_py()
            index = CollisionIndex(data.column("vec_id").to_numpy(), _matrix(data.column("v"), dim), options)
            for query_id, query in zip(queries.column("vec_id").to_pylist(), _matrix(queries.column("v"), dim), strict=True):
                ids, scores = index.search(query_id, query, k)
                rows += [(query_id, int(i), float(s)) for i, s in zip(ids, scores, strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, options: AnnOptions | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by cosine, ties to the smaller vec_id.

    Both tables have vec_id and embedding (an array of numbers). Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do rows
    without a vec_id; vectors of different lengths are never compared. Candidates
    with the query's vec_id are left out. Repeated rows are candidates each. Other
    columns are not read; an empty table gives no rows.

    Vectors and queries are dealt into tiles by hash, and every tile of vectors
    meets every tile of queries in a task of bounded size; then a query's best are
    merged from k rows a tile.
    """
    options = options or AnnOptions()
    scratch = Scratch(vectors.sparkSession, "ann")

    def usable(df: DataFrame) -> DataFrame:
        v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))

    vectors, queries = scratch.table(usable(vectors), "vectors"), scratch.table(usable(queries), "queries")
    tiles = max(-(-vectors.count() // options.tile_rows), 1)
    query_tiles = max(-(-queries.count() // options.tile_queries), 1)
    data = vectors.withColumn("tile", F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles))).withColumn("query_tile", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))
    asked = queries.withColumn("query_tile", F.pmod(F.xxhash64("vec_id"), F.lit(query_tiles)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    keys = ["dim", "tile", "query_tile"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_tile(options, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
