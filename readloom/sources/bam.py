"""BAM as a Spark data source, and its writer.

Records straddle compressed blocks, so ranges of blocks can't be read alone without
knowing where their first record begins. One pass over a file finds that for
ranges of about ``range_bytes``: a plan row is (first block, offset in it, next
range's start, first ordinal, records). ``read_bam`` makes the plan by tasks and once for
all actions on its result; the plain data source by one pass on the driver for each action.
Tasks then read their ranges independently, and ordinals are global.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom import schema as S
from readloom.errors import ReadloomError
from readloom.operators.checksum import framed, framed_digest, stream_digest
from readloom.sources import bgzf
from readloom.sources.files import file_size, open_input
from readloom.sources.header import Header, parse_binary

_FIXED = struct.Struct("<iiBBHHHiiii")
_NAMES = [c.split(" ")[0] for c in S.READS.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_ARROW = pa.schema([(c.split(" ")[0], _TYPES[c.split(" ")[1]]) for c in S.READS.split(", ")])
BATCH_RECORDS = 10_000


@dataclass
class BamRange(InputPartition):
    path: str
    block: int
    skip: int
    ordinal: int
    records: int

    def __init__(self, path: str, block: int, skip: int, ordinal: int, records: int):
        super().__init__(None)
        self.path, self.block, self.skip, self.ordinal, self.records = path, block, skip, ordinal, records


def read_header(path: str) -> Header:
    with open_input(path) as stream:
        return _header(stream)[0]


def _header(stream) -> tuple[Header, int, int]:
    """The header, and the block and offset at which records begin."""
    data, starts = b"", []
    for at, size in bgzf.members(stream):
        stream.seek(at)
        starts.append((len(data), at))
        data += bgzf.inflate(stream.read(size))
        try:
            header, end = parse_binary(data)
        except IndexError:
            continue
        begin, block = next((b, a) for b, a in reversed(starts) if b <= end)
        return header, block, end - begin
    raise ReadloomError("truncated_file", "the file ends inside its header")


def plan_ranges(path: str, range_bytes: int = 32 << 20) -> list[BamRange]:
    """Ranges of records by one sequential pass; a file that ends inside a record is an error."""
    ranges, damage = scan_plan(path, range_bytes)
    if damage is not None:
        raise _damaged(path, damage)
    return ranges


Damage = tuple[str, int, str]


def scan_plan(path: str, range_bytes: int = 32 << 20) -> tuple[list[BamRange], Damage | None]:
    """Ranges of the records before the first whose extent is damaged, and (code, 1-based record, detail) of that one, by one sequential pass."""
    with open_input(path) as stream:
        _, block, skip = _header(stream)
        return _stitched(path, (block, skip), lambda start: _walk(stream, start, start[0] + range_bytes))


def _stitched(path: str, first: tuple[int, int], walk) -> tuple[list[BamRange], Damage | None]:
    """Ranges one after the other, each from where the one before ended."""
    out: list[BamRange] = []
    ordinal, start = 0, first
    while start is not None:
        count, following, damage = walk(start)
        if count:
            out.append(BamRange(path, *start, ordinal, count))
        ordinal += count
        if damage is not None:
            return out or [BamRange(path, *first, 0, 0)], (damage[0], ordinal + 1, damage[2])
        start = following
    return out or [BamRange(path, *first, 0, 0)], None


def _walk(stream, start: tuple[int, int], end: int) -> tuple[int, tuple[int, int] | None, Damage | None]:
    """Pass over the records from a place (block, offset in it) that begin in blocks before ``end``: their number, where the next one begins, and what is wrong with it."""
    block, skip = start
    count, head, need = 0, b"", 0  # bytes of a size field that a block's end cut, or payload still to pass over
    try:
        for at, size in bgzf.members(stream, block):
            stream.seek(at)
            data = bgzf.inflate(stream.read(size))
            pos = skip if at == block else 0
            while pos < len(data):
                if need:
                    step = min(need, len(data) - pos)
                    pos, need = pos + step, need - step
                    continue
                if not head and at >= end:
                    return count, (at, pos), None
                take = min(4 - len(head), len(data) - pos)
                head, pos = head + data[pos : pos + take], pos + take
                if len(head) == 4:
                    need, head = struct.unpack("<i", head)[0], b""
                    if need < 32:
                        return count, None, ("invalid_record", 0, f"a block size of {need}")
                    count += 1
    except ReadloomError as e:
        if e.code != "truncated_file":
            raise
        # the member that is cut holds the rest of the record begun, or the next one
        return count - (need > 0), None, ("truncated_record", 0, e.message)
    if head or need:
        return count - (need > 0), None, ("truncated_record", 0, "the file ends inside it")
    return count, None, None


def plan_bam(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> tuple[list[BamRange], Damage | None]:
    """What ``scan_plan`` finds, by tasks.

    Each takes a range of the file's bytes, finds the first block in it, guesses where
    the first record begins, and passes over the records from there. The driver, which gets
    a row a range, goes from range to range: where a guess isn't the place at which the
    range before ended, that range is passed over again from the right place.
    """
    size = file_size(path)
    if size <= range_bytes:
        return scan_plan(path, range_bytes)
    with open_input(path) as stream:
        head, block, skip = _header(stream)
    references, names = len(head.references), "id long, block long, skip long, records long, next_block long, next_skip long, code string, detail string"

    def passed(i: int, start: tuple[int, int] | None) -> tuple:
        with open_input(path) as stream:
            end = min((i + 1) * range_bytes, size)
            start = start or _guess(stream, i * range_bytes, end, references)
            if start is None:
                return (i, *[None] * 7)
            count, following, damage = _walk(stream, start, end)
            return (i, *start, count, *(following or (None, None)), *((damage[0], damage[2]) if damage else (None, None)))

    def job(start: tuple[int, int] | None):
        def walk(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arrow:
                rows = [passed(i, start) for i in batch.column("id").to_pylist()]
                kinds = [*[pa.int64()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [n.split(" ")[0] for n in names.split(", ")])

        return walk

    ranges = -(-size // range_bytes)
    found = {r["id"]: r for r in spark.range(0, ranges, 1, ranges).mapInArrow(job(None), names).collect()}

    def walk(start: tuple[int, int]) -> tuple[int, tuple[int, int] | None, Damage | None]:
        i = start[0] // range_bytes
        r = found[i]
        if (r["block"], r["skip"]) != start:
            r = spark.range(i, i + 1, 1, 1).mapInArrow(job(start), names).first()
        following = None if r["next_block"] is None else (r["next_block"], r["next_skip"])
        return r["records"], following, (r["code"], 0, r["detail"]) if r["code"] else None

    return _stitched(path, (block, skip), walk)


def _guess(stream, begin: int, end: int, references: int) -> tuple[int, int] | None:
    """Where the first record that begins in a block of [begin, end) may begin: there, and after it, fields are as in records."""
    stream.seek(begin)
    window = stream.read(2 * bgzf.MOST_MEMBER)
    at = -1
    while (at := window.find(b"\x1f\x8b\x08\x04", at + 1)) >= 0:
        n = bgzf.member_size(window[at : at + 64])
        if n and (window[at + n : at + n + 4] == b"\x1f\x8b\x08\x04" or begin + at + n == stream.size()):
            break
    if at < 0 or begin + at >= end:
        return None
    places, data = [], b""
    try:
        for block, n in bgzf.members(stream, begin + at):
            stream.seek(block)
            places.append((len(data), block))
            data += bgzf.inflate(stream.read(n))
            if len(data) > 8 * bgzf.MOST_MEMBER:
                break
    except ReadloomError:
        pass  # what there is serves for a guess
    for offset in _plausible(data, references):
        start, block = next(p for p in reversed(places) if p[0] <= offset)
        return (block, offset - start) if block < end else None
    return None


def _plausible(data: bytes, references: int, more: int = 4) -> Iterator[int]:
    """Offsets at which a record may begin, each followed by ``more`` others as far as the data goes."""
    if len(data) < 36:
        return
    raw = np.frombuffer(data, np.uint8)
    quads = sum(raw[i : len(raw) - 3 + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4)).view(np.int32)
    field = lambda k: quads[k : len(quads) - 32 + k]
    fits = (field(0) >= 32) & (field(0) < 1 << 26) & (field(4) >= -1) & (field(4) < max(references, 1)) & (field(8) >= -1) & (field(20) >= 0) & (field(24) >= -1) & (field(24) < max(references, 1)) & (field(28) >= -1)

    def record(at: int) -> int | None:
        """Where the record that begins here would end."""
        if at + 36 > len(data) or not fits[at]:
            return None
        size = struct.unpack_from("<i", data, at)[0]
        l_name, n_cigar, l_seq = data[at + 12], *struct.unpack_from("<H", data, at + 16), *struct.unpack_from("<i", data, at + 20)
        name = data[at + 36 : at + 36 + l_name]
        if l_name < 1 or 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq > size or (len(name) == l_name and (name[-1] or 0 in name[:-1])):
            return None
        return at + 4 + size

    for offset in np.flatnonzero(fits).tolist():
        at, good = offset, True
        for _ in range(more + 1):
            if at + 36 > len(data):
                break
            ends = record(at)
            if ends is None:
                good = False
                break
            at = ends
        if good:
            yield offset


def read_bam(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """A file's reads, planned by tasks; a record whose extent is damaged is an error."""
    ranges, damage = plan_bam(spark, path, range_bytes)
    if damage is not None:
        raise _damaged(path, damage)
    return planned(spark, path, ranges)


def planned(spark: SparkSession, path: str, ranges: list[BamRange], mark: bool = False) -> DataFrame:
    register(spark)
    plan = json.dumps([[r.path, r.block, r.skip, r.ordinal, r.records] for r in ranges])
    return spark.read.format("bam").option("plan", plan).option("ondamage", "mark" if mark else "fail").load(path)


def _damaged(path: str, damage: Damage) -> ReadloomError:
    code, record, detail = damage
    return ReadloomError("truncated_file" if code == "truncated_record" else code, f"{path}, record {record}: {detail}")


def _inflated(stream, block: int, skip: int) -> Iterator[bytes]:
    for at, size in bgzf.members(stream, block):
        stream.seek(at)
        data = bgzf.inflate(stream.read(size))
        yield data[skip:] if at == block else data


def read_range(r: BamRange, mark: bool = False) -> Iterator[tuple]:
    """Rows of a range, in the order of the reads schema; with ``mark``, a record that its fields don't fit into has no read name and no fields."""
    with open_input(r.path) as stream:
        blocks, data, at, done = _inflated(stream, r.block, r.skip), b"", 0, 0
        while done < r.records:
            while len(data) - at < 4 or len(data) - at - 4 < struct.unpack_from("<i", data, at)[0]:
                data, at = data[at:] + next(blocks), 0
            size = struct.unpack_from("<i", data, at)[0]
            try:
                row = decode_record(data[at + 4 : at + 4 + size], r.path, r.ordinal + done)
            except (ReadloomError, UnicodeDecodeError):
                if not mark:
                    raise
                row = (r.path, r.ordinal + done, size, *[None] * (len(_NAMES) - 3))
            yield row
            at += 4 + size
            done += 1


def decode_record(raw: bytes, source: str, ordinal: int) -> tuple:
    ref_id, pos, l_name, mapq, bin_, n_cigar, flags, l_seq, next_ref, next_pos, tlen = _FIXED.unpack_from(raw)
    at = 32
    name = raw[at : at + l_name - 1]
    at += l_name
    cigar = raw[at : at + 4 * n_cigar]
    at += 4 * n_cigar
    bases = raw[at : at + (l_seq + 1) // 2]
    at += (l_seq + 1) // 2
    qual = raw[at : at + l_seq]
    at += l_seq
    if at > len(raw) or l_name < 1 or l_seq < 0:
        raise ReadloomError("invalid_record", f"record {ordinal + 1} is shorter than its fields")
    return (source, ordinal, len(raw), ref_id, pos, bin_, mapq, flags, n_cigar, l_seq, next_ref, next_pos, tlen, name.decode(), cigar, bases, qual, raw[at:])


def encode_record(row: dict) -> bytes:
    name = row["read_name"].encode() + b"\0"
    cigar, bases, qual, aux = (bytes(row[c] or b"") for c in ("cigar", "seq_packed", "qual", "aux_bytes"))
    body = _FIXED.pack(row["ref_id"], row["pos"], len(name), row["mapq"], row["bin"], len(cigar) // 4, row["flags"], row["l_seq"], row["next_ref_id"], row["next_pos"], row["tlen"])
    body += name + cigar + bases + qual + aux
    return struct.pack("<i", len(body)) + body


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ReadloomError("invalid_argument", "a path is needed")
        self.paths = options["path"].split(",")
        self.limit = int(options["maxrecords"]) if options.get("maxrecords") else None
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.mark = options.get("ondamage", "fail") == "mark"
        self.plan = [BamRange(*r) for r in json.loads(options["plan"])] if options.get("plan") else None

    def partitions(self) -> list[BamRange]:
        out = []
        for path in self.paths:
            planned = self.plan
            if planned is None:
                planned = scan_plan(path, self.range_bytes)[0] if self.mark else plan_ranges(path, self.range_bytes)
            for r in planned:
                if self.limit is None or r.ordinal < self.limit:
                    out.append(r if self.limit is None else BamRange(r.path, r.block, r.skip, r.ordinal, min(r.records, self.limit - r.ordinal)))
        return out

    def read(self, partition: BamRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in read_range(partition, self.mark):
            rows.append(row)
            if len(rows) == BATCH_RECORDS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class BamDataSource(DataSource):
    """``spark.read.format("bam").load(path)``; options maxRecords (of each file), rangeBytes, and onDamage: ``fail``, or ``mark`` to read what comes before a damaged extent and leave records that can't be decoded without fields."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return S.READS

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamDataSource)


def _part_writer(folder: str):
    def write(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        # attempts of a task write files of their own; the driver joins those of the attempts whose rows it got
        name, held, count = f"part-{part:06d}-{task.taskAttemptId()}", b"", 0
        with fs.open_output_stream(f"{root}/{name}") as stream:
            for batch in arrow:
                for row in batch.to_pylist():
                    held += encode_record(row)
                    count += 1
                    if len(held) >= bgzf.PAYLOAD * 16:
                        whole = len(held) // bgzf.PAYLOAD * bgzf.PAYLOAD
                        stream.write(bgzf.deflate(held[:whole]))
                        held = held[whole:]
            stream.write(bgzf.deflate(held))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([count], pa.int64())], ["part", "name", "records"])

    return write


def write_bam(reads: DataFrame, header: Header, path: str, scratch_folder: str, force: bool = False) -> int:
    """Write reads, in their present partition order, as one BAM: a run of blocks per task, joined by the driver.

    Blocks of different tasks may be put one after the other as they are. Returns
    the number of records. ``scratch_folder`` is a URI that the driver and the
    executors share.
    """
    from readloom.sources.files import atomic_write

    if os.path.exists(path) and not force:
        raise ReadloomError("output_exists", f"{path} exists", hint="use force to replace it")
    done = sorted(tuple(r) for r in reads.mapInArrow(_part_writer(scratch_folder), "part int, name string, records long").collect())
    fs, root = pafs.FileSystem.from_uri(scratch_folder)

    def parts() -> Iterator[bytes]:
        yield bgzf.deflate(header.binary())
        for _, name, _ in done:
            with fs.open_input_stream(f"{root}/{name}") as stream:
                while piece := stream.read(8 << 20):
                    yield piece
        yield bgzf.EOF_MARKER

    atomic_write(path, parts(), force)
    fs.delete_dir(root)
    return sum(n for _, _, n in done)


def decoded(reads: DataFrame) -> DataFrame:
    """Reads with sequence, quality, tags and read group in text form."""

    def decode(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from readloom.functions.kernels import aux_value, decode_bases, decode_quality, walk_aux

        for batch in arrow:
            sequence, quality, tags, group = [], [], [], []
            for bases, n, qual, aux in zip(*[batch.column(c).to_pylist() for c in ("seq_packed", "l_seq", "qual", "aux_bytes")], strict=True):
                sequence.append(decode_bases(bases, n))
                quality.append(decode_quality(qual))
                fields = walk_aux(aux)
                tags.append([t for t, _, _ in fields])
                group.append(next((aux_value(k, p) for t, k, p in fields if t == "RG" and k == "Z"), None))
            columns = [*batch.columns, pa.array(sequence, pa.string()), pa.array(quality, pa.string()), pa.array(tags, pa.list_(pa.string())), pa.array(group, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence", "quality", "tags", "rg"])

    return reads.select(*_NAMES).mapInArrow(decode, S.READS + ", sequence string, quality string, tags array<string>, rg string")


def without_tags(raw: bytes, tags: set[str]) -> bytes:
    """Aux bytes without some tags; all other bytes stay as they are."""
    from readloom.functions.kernels import walk_aux

    return b"".join(t.encode() + k.encode() + p for t, k, p in walk_aux(raw) if t not in tags)


#: The format of the fixed fields that checksums cover: flags, reference, position, mapping quality, CIGAR operations, bases, mate's reference and position, template length.
_DIGESTED = struct.Struct("<HiiBIIiii")
_DIGESTED_NAMES = ("flags", "ref_id", "pos", "mapq", "n_cigar", "l_seq", "next_ref_id", "next_pos", "tlen")


def digested(row: dict) -> bytes:
    """The bytes of a record that checksums cover: no block size and bin; fields of any length behind their length."""
    variable = [framed(bytes(row[c] or b"")) for c in ("cigar", "seq_packed", "qual", "aux_bytes")]
    return framed(row["read_name"].encode()) + _DIGESTED.pack(*[row[c] for c in _DIGESTED_NAMES]) + b"".join(variable)


def serialised(reads: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(ordinal, record): the bytes that checksums cover, without the aux fields of some tags."""
    gone = set(exclude)

    def make(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            out = []
            for row in batch.to_pylist():
                if gone:
                    row["aux_bytes"] = without_tags(row["aux_bytes"], gone)
                out.append(digested(row))
            yield pa.RecordBatch.from_arrays([batch.column("ordinal"), pa.array(out, pa.binary())], ["ordinal", "record"])

    return reads.mapInArrow(make, "ordinal long, record binary")


def encoded(reads: DataFrame) -> DataFrame:
    """(ordinal, record): records as a file holds them, block size and all."""

    def make(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            yield pa.RecordBatch.from_arrays([batch.column("ordinal"), pa.array([encode_record(row) for row in batch.to_pylist()], pa.binary())], ["ordinal", "record"])

    return reads.select(*_NAMES).mapInArrow(make, "ordinal long, record binary")


def checksum(reads: DataFrame, canonical: bool, exclude: tuple[str, ...] = (), before: bytes | None = None) -> str:
    """SHA-256 of whole records: in order, after ``before`` if given, or of their sorted digests."""
    rows = serialised(reads, exclude)
    if canonical:
        return stream_digest(rows.select(F.unhex(framed_digest(F.col("record"))).alias("d")).orderBy("d"), "d")
    return stream_digest(rows.orderBy("ordinal").select("record"), "record", before)


def numbers(cigar: bytes) -> list[tuple[int, str]]:
    """(length, operation) pairs of packed CIGAR bytes."""
    return [(int(v) >> 4, "MIDNSHP=XB"[int(v) & 15]) for v in np.frombuffer(cigar, "<u4")]
