"""Token-id files of independent zstandard frames with a trailing seek table.

One file is one shard: a frame per document with its ids as little-endian unsigned
32-bit integers, then a skippable frame with the documents' ids, then a skippable
frame with the seek table (compressed size, size and checksum of each frame). Any
zstandard reader can decompress a file from front to back; ``TokenFile`` reads the
table at the end and then only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .tokens import batches, encoder

# Fixed values of the public zstandard seekable format: skippable-frame magic numbers, footer magic, descriptor with the checksum bit.
SEEK_TABLE_MAGIC = 0x184D2A5E
DOC_TABLE_MAGIC = 0x184D2A51
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

_READ_BYTES = 4 << 20


class CorruptFrame(ValueError):
    """A frame whose bytes don't agree with its checksum in the seek table."""


class TokenFileWriter:
    """Write documents' ids to an open binary stream, a frame for each."""

    def __init__(self, stream, level: int = 3):
        self._stream = stream
        self._compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._entries: list[tuple[int, int, int]] = []
        self._doc_ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self._compressor.compress(ids)
        self._stream.write(frame)
        self._entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self._doc_ids.append(doc_id)

    def close(self) -> None:
        known = np.array([d is not None for d in self._doc_ids], np.uint8)
        table = np.array([d or 0 for d in self._doc_ids], "<i8").tobytes() + known.tobytes()
        packed = self._compressor.compress(table)
        self._stream.write(struct.pack("<II", DOC_TABLE_MAGIC, len(packed)) + packed)
        seek = b"".join(struct.pack("<III", *e) for e in self._entries)
        seek += struct.pack("<IBI", len(self._entries), CHECKSUM_FLAG, FOOTER_MAGIC)
        self._stream.write(struct.pack("<II", SEEK_TABLE_MAGIC, len(seek)) + seek)


class TokenFile:
    """Random access to a token file: ``doc_ids`` in file order, ``read(i)`` for the ids of the i-th document."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self._file = fs.open_input_file(path)
        size = self._file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUM_FLAG:
            raise CorruptFrame(f"{uri} has no seek table")
        seek_at = size - 9 - 12 * count - 8
        self._entries = np.frombuffer(self._at(seek_at + 8, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self._begin = np.concatenate([[0], np.cumsum(self._entries[:, 0])])
        self._decompressor = zstandard.ZstdDecompressor()
        at = int(self._begin[-1])
        table = self._decompressor.decompress(self._at(at + 8, seek_at - at - 8))
        known = np.frombuffer(table, np.uint8, count, 8 * count)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(table, "<i8", count), known, strict=True)]
        self.n_tokens = self._entries[:, 1] // 4

    def _at(self, offset: int, size: int) -> bytes:
        self._file.seek(int(offset))
        return self._file.read(int(size))

    def _frame(self, i: int, frame: bytes) -> bytes:
        ids = self._decompressor.decompress(frame)
        if len(ids) != self._entries[i, 1] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self._entries[i, 2]:
            raise CorruptFrame(f"frame {i}")
        return ids

    def read(self, i: int) -> np.ndarray:
        return np.frombuffer(self._frame(i, self._at(self._begin[i], self._entries[i, 0])), "<u4")

    def __iter__(self) -> Iterator[bytes]:
        """The ids of every document in turn, as bytes; the file is read in large pieces."""
        i, n = 0, len(self._entries)
        while i < n:
            end = max(i + 1, int(np.searchsorted(self._begin, self._begin[i] + _READ_BYTES, "right")) - 1)
            block, base = self._at(self._begin[i], self._begin[end] - self._begin[i]), self._begin[i]
            for k in range(i, end):
                yield self._frame(k, block[self._begin[k] - base : self._begin[k + 1] - base])
            i = end

    def close(self) -> None:
        self._file.close()


_MANIFEST = "shard int, path string, documents long, tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _shard_writer(tokenizer: str, folder: str, end_id: int, level: int):
    end = np.array([end_id], "<u4").tobytes()

    def write(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        shard = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        final, attempt = f"{root}/shard-{shard:06d}.tok.zst", f"{root}/.shard-{shard:06d}.{uuid.uuid4().hex}"
        documents = tokens = 0
        with fs.open_output_stream(attempt) as stream:
            writer = TokenFileWriter(stream, level)
            for batch in arrow:
                doc_ids = batch.column("doc_id").to_pylist()
                texts = batch.column("text").cast(pa.large_binary()).to_pylist()
                texts = [t or b"" for t in texts]
                for a, b in batches(texts):
                    for doc_id, ids in zip(doc_ids[a:b], encode(texts[a:b]), strict=True):
                        writer.add(doc_id, ids + end)
                        documents += 1
                        tokens += len(ids) // 4 + 1
            writer.close()
        fs.move(attempt, final)  # another attempt at this shard writes the same bytes
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([f"{folder}/shard-{shard:06d}.tok.zst"]), pa.array([documents]), pa.array([tokens])],
            ["shard", "path", "documents", "tokens"],
        )

    return write


def write_token_store(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, level: int = 3, shards: int | None = None) -> DataFrame:
    """Tokenise documents and write them in ascending doc_id order; returns the manifest (shard, path, documents, tokens).

    A shard is a range of doc_id; shards follow each other in order. Null texts
    are empty, an empty text has the end id alone; null doc_ids come first;
    repeated doc_ids follow each other, ordered by a hash of their text. Columns
    other than doc_id and text are not read. ``folder`` is a URI that the driver
    and the executors share.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = folder or scratch.path("files")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(shards or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return scratch.table(ordered.mapInArrow(_shard_writer(tokenizer, folder, end_id, level), _MANIFEST), "manifest")


def _read_shards(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            file = TokenFile(path)
            crcs = [zlib.crc32(ids) for ids in file]
            file.close()
            starts = start + np.concatenate([[0], np.cumsum(file.n_tokens)])[:-1] if crcs else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(file.doc_ids, pa.int64()), pa.array(starts.astype(np.int64)), pa.array(file.n_tokens.astype(np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_store(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read every frame back, checked: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A row per shard reaches the driver, for the shards' starts.
    """
    shards = sorted((r["shard"], r["path"], r["tokens"]) for r in manifest.collect())
    if not shards:
        return spark.createDataFrame([], _READ)
    starts = np.concatenate([[0], np.cumsum([t for _, _, t in shards])])[:-1].tolist()
    listed = spark.createDataFrame([(p, int(s)) for (_, p, _), s in zip(shards, starts, strict=True)], "path string, start long")
    return listed.repartition(len(shards)).mapInArrow(_read_shards, _READ)


def read_documents(spark: SparkSession, manifest: DataFrame, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of a few documents; decompresses only their frames."""
    wanted, found = set(doc_ids), {}
    for row in manifest.collect():
        file = TokenFile(row["path"])
        for i, d in enumerate(file.doc_ids):
            if d in wanted and d not in found:
                found[d] = file.read(i)
        file.close()
    return found

