"""FASTQ and FASTA text, plain or compressed, as relations; FASTQ output."""

from __future__ import annotations

import gzip
import io
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom import schema as S
from readloom.errors import ReadloomError
from readloom.sources.files import atomic_write, file_size, open_input

_NAMES = [c.split(" ")[0] for c in S.FASTQ.split(", ")]


def inflate_stream(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Inflated pieces of a stream of one or more gzip members."""
    engine = zlib.decompressobj(31)
    while piece := stream.read(size):
        while piece:
            yield engine.decompress(piece)
            piece = b""
            if engine.eof:
                piece, engine = engine.unused_data, zlib.decompressobj(31)


def lines(path: str) -> Iterator[bytes]:
    with open_input(path) as stream:
        compressed = path.lower().endswith(".gz")
        pieces = inflate_stream(stream) if compressed else iter(lambda: stream.read(1 << 20), b"")
        rest = b""
        for piece in pieces:
            *whole, rest = (rest + piece).split(b"\n")
            yield from whole
        if rest:
            yield rest


def records(path: str) -> Iterator[tuple]:
    """Strict four-line records: (header, name, sequence, plus line, quality)."""
    yield from _records(lines(path), path, 0)


def _records(it: Iterator[bytes], path: str, n: int) -> Iterator[tuple]:
    """Records from lines that begin with one, the n-th of the file."""
    for head in it:
        n += 1
        try:
            sequence, plus, quality = next(it), next(it), next(it)
        except StopIteration:
            raise ReadloomError("truncated_file", f"{path} ends inside record {n}") from None
        head, sequence, plus, quality = (x.rstrip(b"\r").decode() for x in (head, sequence, plus, quality))
        if not head.startswith("@") or not plus.startswith("+"):
            raise ReadloomError("parse_error", f"{path}: record {n} is not a four-line record")
        if len(sequence) != len(quality):
            raise ReadloomError("parse_error", f"{path}: record {n} has {len(sequence)} bases and {len(quality)} qualities")
        names = head[1:].split()
        if not names:
            raise ReadloomError("parse_error", f"{path}: record {n} has no name")
        yield head[1:], names[0], sequence, plus, quality


@dataclass
class FastqRange(InputPartition):
    """Records that begin in [begin, end) of a file, before which there are so many line ends; end is None for a whole file."""

    path: str
    begin: int = 0
    end: int | None = None
    newlines: int = 0

    def __init__(self, path: str, begin: int = 0, end: int | None = None, newlines: int = 0):
        super().__init__(None)
        self.path, self.begin, self.end, self.newlines = path, begin, end, newlines

    def read(self) -> Iterator[tuple[int, tuple]]:
        """(ordinal, record)."""
        if self.end is None:
            yield from enumerate(records(self.path))
            return
        with open_input(self.path) as stream:
            stream.seek(max(self.begin - 1, 0))
            reader = io.BufferedReader(io.BufferedReader(_Raw(stream)), 1 << 20)
            at, line = self.begin, self.newlines
            if self.begin:
                skipped = reader.readline()  # up to the line end before the first line that begins here
                at, line = self.begin - 1 + len(skipped), self.newlines + (skipped != b"\n")
            while line % 4:
                skipped = reader.readline()
                at, line = at + len(skipped), line + 1
                if not skipped:
                    return
            place = [at]

            def whole_lines() -> Iterator[bytes]:
                while raw := reader.readline():
                    place[0] += len(raw)
                    yield raw.removesuffix(b"\n")

            it, ordinal = whole_lines(), line // 4
            while place[0] < self.end:
                record = next(_records(it, self.path, ordinal), None)
                if record is None:
                    return
                yield ordinal, record
                ordinal += 1


class _Raw(io.RawIOBase):
    """An Arrow stream as a raw one, which the standard library can buffer."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.limit = int(options["maxrecords"]) if options.get("maxrecords") else None
        self.plan = json.loads(options["plan"]) if options.get("plan") else None

    def partitions(self) -> list[InputPartition]:
        return [FastqRange(p) for p in self.paths] if self.plan is None else [FastqRange(*r) for r in self.plan]

    def read(self, partition: FastqRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for n, r in partition.read():
            if self.limit is not None and n >= self.limit:
                break
            rows.append((partition.path, n, *r))
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _count_lines(path: str, size: int):
    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            found = []
            for i in batch.column("id").to_pylist():
                with open_input(path) as stream:
                    stream.seek(i * size)
                    left, n = size, 0
                    while left and (piece := stream.read(min(left, 1 << 22))):
                        left, n = left - len(piece), n + piece.count(b"\n")
                found.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "n"])

    return count


def read_fastq(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """A file's reads. Plain text is read in ranges of bytes: tasks count the line ends of each first, so that every range knows which records begin in it; the driver gets a number a range."""
    register(spark)
    source = spark.read.format("fastq")
    if path.lower().endswith(".gz") or (size := file_size(path)) <= range_bytes:
        return source.load(path)
    ranges = -(-size // range_bytes)
    counts = spark.range(0, ranges, 1, ranges).mapInArrow(_count_lines(path, range_bytes), "id long, n long").collect()
    plan, before = [], 0
    for r in sorted(counts, key=lambda r: r["id"]):
        plan.append([path, r["id"] * range_bytes, min((r["id"] + 1) * range_bytes, size), before])
        before += r["n"]
    return source.option("plan", json.dumps(plan)).load(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


class FastqDataSource(DataSource):
    """``spark.read.format("fastq").load(path)``: a partition a file, as plain gzip can't be split; ``read_fastq`` gives ranges of plain text."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return S.FASTQ

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqDataSource)


def write_fastq(text: DataFrame, path: str, force: bool = False) -> None:
    """Write (ordinal, record) in order, gzip by the path's extension; partitions stream through the driver one at a time."""
    ordered = text.orderBy("ordinal").select("record")
    pack = (lambda b: gzip.compress(b, 6, mtime=0)) if path.endswith(".gz") else (lambda b: b)

    def parts() -> Iterator[bytes]:
        held, size = [], 0
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            held.append(row[0])
            size += len(row[0])
            if size >= 4 << 20:
                yield pack("".join(held).encode())
                held, size = [], 0
        if held:
            yield pack("".join(held).encode())

    atomic_write(path, parts(), force)


def count_fasta(spark: SparkSession, path: str) -> int:
    """Sequences of a FASTA file; data before the first header is an error."""
    from readloom.sources.sam import text_lines

    rows = text_lines(spark, path).where(F.trim("value") != "")
    one = rows.agg(F.count_if(F.col("value").startswith(">")).alias("n"), F.min("line").alias("first"), F.min(F.when(F.col("value").startswith(">"), F.col("line"))).alias("header")).first()
    if one["first"] is not None and one["header"] != one["first"]:
        raise ReadloomError("parse_error", "sequence data before the first header")
    return one["n"]


# Sidecar magic, one per cent in basis points, and the whole.
GZI_MAGIC, GZI_STEP, GZI_WHOLE = b"FQGZI\0\0\1", 100, 10_000


def build_gzi(path: str) -> tuple[dict, list[tuple[int, int, int]]]:
    """Totals and checkpoints (compressed offset, uncompressed offset, records) about every per cent of the compressed bytes, on record boundaries."""
    size = file_size(path)
    points: list[tuple[int, int, int]] = [(0, 0, 0)]
    done = newlines = boundary = 0
    threshold = GZI_STEP
    with open_input(path) as stream:
        for piece in inflate_stream(stream, 1 << 16):
            at = -1
            while (at := piece.find(b"\n", at + 1)) >= 0:
                newlines += 1
                if newlines % 4 == 0:
                    boundary = done + at + 1
            done += len(piece)
            read = stream.tell()
            crossed = False
            while threshold < GZI_WHOLE and read * GZI_WHOLE >= size * threshold:
                crossed, threshold = True, threshold + GZI_STEP
            if crossed:
                points.append((read, boundary, newlines // 4))
    total = -(-newlines // 4)
    points.append((size, done, total))
    return {"interval_bp": GZI_STEP, "compressed_size": size, "uncompressed_size": done, "total_records": total}, points


def write_gzi(path: str, summary: dict, points: list[tuple[int, int, int]], force: bool = False) -> None:
    head = GZI_MAGIC + struct.pack("<IQQQQ", summary["interval_bp"], summary["compressed_size"], summary["uncompressed_size"], summary["total_records"], len(points))
    atomic_write(path, [head, *[struct.pack("<QQQ", *p) for p in points]], force)


def read_gzi(path: str) -> tuple[dict, list[tuple[int, int, int]]]:
    with open_input(path) as stream:
        data = stream.read()
    if data[:8] != GZI_MAGIC or len(data) < 44:
        raise ReadloomError("invalid_index", f"{path} is not a FASTQ sidecar index")
    step, compressed, uncompressed, total, n = struct.unpack_from("<IQQQQ", data, 8)
    points = [struct.unpack_from("<QQQ", data, 44 + 24 * i) for i in range(n)]
    return {"interval_bp": step, "compressed_size": compressed, "uncompressed_size": uncompressed, "total_records": total}, points


def count_fastq(spark: SparkSession, path: str, sidecar: str | None = None, compat: bool = False) -> int:
    """Records of a FASTQ file, counted in tasks; from the sidecar index where it speaks of a file of this size (of any size with ``compat``)."""
    import os

    sidecar = sidecar or f"{path}.gzi"
    if os.path.exists(sidecar):
        summary, _ = read_gzi(sidecar)
        if compat or summary["compressed_size"] == file_size(path):
            return summary["total_records"]
    return read_fastq(spark, path).count()
