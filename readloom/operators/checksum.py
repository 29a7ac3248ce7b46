"""Content checksums. Records are digested in parallel; what depends on order passes one hasher's state from task to task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.sha import Sha256, library
from readloom.functions.shared import Scratch

#: Bytes of a block, a row of written bytes; blocks that pass to Python at a time; bytes of a piece, which a task hashes alone or with the next.
BLOCK, BATCH_BLOCKS, PIECE = 1 << 18, 64, 1 << 26


def record_bytes(exclude_tags: bool = False) -> Column:
    """The canonical serialisation of a record: fixed fields as text in a fixed order, then the variable parts, each length-prefixed."""
    fixed = ["ref_id", "pos", "mapq", "flags", "next_ref_id", "next_pos", "tlen"]
    numbers = F.concat_ws(",", *[F.col(c).cast("string") for c in fixed])
    parts = [numbers, F.col("read_name")]
    return F.concat_ws("|", *[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def record_digest() -> Column:
    return F.sha2(record_bytes(), 256)


def framed_digest(binary: Column) -> Column:
    """SHA-256 of a binary column behind its length as an unsigned 64-bit little-endian number."""
    size = F.octet_length(binary)
    little = [F.lpad(F.hex(F.shiftright(size, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]
    return F.sha2(F.concat(F.unhex(F.concat(*little, F.lit("00000000"))), binary), 256)


def framed(value: bytes) -> bytes:
    return len(value).to_bytes(8, "little") + value


def stream_digest(rows: DataFrame, column: str, before: bytes | None = None) -> str:
    """SHA-256 over the framed values of a column of ordered rows, after ``before`` if given.

    Tasks sort and frame in parallel, and write the bytes in pieces. Then one task after
    the other hashes a few pieces and hands the hasher's state on; only that comes to the driver.
    """
    spark, key = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    scratch = Scratch(spark, "checksum")
    table = scratch.table(rows.select(F.col(column).cast("binary").alias("value")).mapInArrow(_framed_blocks(BLOCK, PIECE), "piece long, number long, size int, block binary"), "pieces", ("piece",))
    sizes = sorted((r["piece"], r["size"]) for r in table.groupBy("piece").agg(F.sum("size").alias("size")).collect())
    start = b"" if before is None else framed(before)
    digest, state, kept = hashlib.sha256(start).hexdigest(), None, spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BLOCKS))
    try:
        for blocks in _steps(table, sizes):
            digest, state = blocks.mapInArrow(_hash_on(state, start), "digest string, state binary").first()
            if digest is None:  # executors without the library: the driver hashes, a few pieces at a time
                total = hashlib.sha256(start)
                for again in _steps(table, sizes):
                    for row in again.toLocalIterator():
                        total.update(row["block"])
                return total.hexdigest()
    finally:
        spark.conf.set(key, kept)
        scratch.drop("pieces")
    return digest


def _framed_blocks(most: int, whole: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's values, framed and joined, as numbered blocks of ``most`` bytes; pieces of about ``whole`` bytes are numbered in the order of tasks."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, size, number = TaskContext.get().partitionId() << 32, 0, 0
        for batch in arrow:
            values = batch.column(0).cast(pa.large_binary())
            if values.null_count:
                raise ValueError("a record without bytes to digest")
            if not len(values):
                continue
            lengths = pc.binary_length(values).to_numpy(zero_copy_only=False).astype("<u8")
            ahead = pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(np.arange(0, 8 * len(values) + 1, 8, dtype=np.int64)), pa.py_buffer(lengths)])
            data = pc.binary_join_element_wise(ahead, values, pa.scalar(b"", pa.large_binary())).buffers()[2][: int(lengths.sum()) + 8 * len(values)]
            for at in range(0, data.size, most):
                if size >= whole:
                    piece, size = piece + 1, 0
                block = data[at : at + most]
                yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int64()), "number": pa.array([number], pa.int64()), "size": pa.array([block.size], pa.int32()), "block": pa.array([block.to_pybytes()], pa.binary())})
                size, number = size + block.size, number + 1

    return run


def _steps(table: DataFrame, sizes: list[tuple[int, int]]) -> Iterator[DataFrame]:
    """Blocks of successive pieces, each time in one ordered partition of about ``PIECE`` bytes, twice that at most."""
    while sizes:
        n, size = 1, sizes[0][1]
        while n < len(sizes) and size < PIECE:
            size, n = size + sizes[n][1], n + 1
        yield table.where(F.col("piece").between(sizes[0][0], sizes[n - 1][0])).coalesce(1).sortWithinPartitions("piece", "number").select("block")
        sizes = sizes[n:]


def _hash_on(state: bytes | None, start: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row: the digest so far and the hasher's state; nulls where states can't be taken out."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = then = None
        if library():
            hasher = Sha256(state)
            if state is None:
                hasher.update(start)
            for batch in arrow:
                for block in batch.column(0):
                    hasher.update(block.as_buffer())
            digest, then = hasher.hexdigest(), hasher.state()
        yield pa.RecordBatch.from_pydict({"digest": pa.array([digest], pa.string()), "state": pa.array([then], pa.binary())})

    return run


def checksum_in_order(reads: DataFrame) -> str:
    """Depends on record order."""
    return stream_digest(reads.select("ordinal", record_bytes().alias("b")).orderBy("ordinal"), "b")


def checksum_canonical(reads: DataFrame) -> str:
    """Depends on the multiset of records alone: digests of records, sorted, hashed in that order."""
    return stream_digest(reads.select(record_digest().alias("d")).orderBy("d"), "d")


def checksum_multiset(reads: DataFrame) -> DataFrame:
    """A multiset checksum in one aggregation, for data too large to stream: count, xor and wrapped sum of digest parts."""
    d = record_digest()
    part = lambda at: F.conv(F.substring(d, at, 8), 16, 10).cast("long")
    return reads.agg(F.count(F.lit(1)).alias("records"), *[F.bit_xor(part(1 + 8 * i)).alias(f"xor_{i}") for i in range(8)], *[F.sum(part(1 + 8 * i)).alias(f"sum_{i}") for i in range(8)])
