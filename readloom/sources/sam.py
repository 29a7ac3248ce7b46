"""SAM text as reads: split and typed by Spark, places joined to the header's references."""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import schema as S
from readloom.errors import ReadloomError
from readloom.functions.kernels import encode_bases, encode_quality
from readloom.sources.files import open_input
from readloom.sources.header import Header

_OPS = "MIDNSHP=XB"
_INTEGERS = (("c", "<b", -128, 127), ("C", "<B", 0, 255), ("s", "<h", -32768, 32767), ("S", "<H", 0, 65535), ("i", "<i", -(2**31), 2**31 - 1), ("I", "<I", 0, 2**32 - 1))


def read_header(path: str) -> Header:
    lines = []
    with open_input(path) as stream:
        text = b""
        while piece := stream.read(1 << 20):
            text += piece
            *whole, text = text.split(b"\n")
            body = next((i for i, line in enumerate(whole) if not line.startswith(b"@")), None)
            lines += whole if body is None else whole[:body]
            if body is not None:
                break
        else:
            if text.startswith(b"@"):
                lines.append(text)
    return Header.parse_text(b"\n".join(lines).decode())


def encode_cigar(text: str) -> bytes:
    if text == "*":
        return b""
    parts = re.findall(r"(\d+)([MIDNSHP=XB])", text)
    if "".join(n + o for n, o in parts) != text:
        raise ReadloomError("parse_error", f"bad CIGAR {text!r}")
    return b"".join(struct.pack("<I", int(n) << 4 | _OPS.index(o)) for n, o in parts)


def encode_aux(field: str) -> bytes:
    tag, kind, value = field.split(":", 2)
    head = tag.encode()
    if kind == "A":
        return head + b"A" + value.encode()
    if kind == "i":
        number = int(value)
        code, fmt = next((c, f) for c, f, low, high in _INTEGERS if low <= number <= high)
        return head + code.encode() + struct.pack(fmt, number)
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind in ("Z", "H"):
        return head + kind.encode() + value.encode() + b"\0"
    if kind == "B":
        sub, *items = value.split(",")
        fmt = {"f": "<f"} | {c: f for c, f, _, _ in _INTEGERS}
        return head + b"B" + sub.encode() + struct.pack("<I", len(items)) + b"".join(struct.pack(fmt[sub], float(i) if sub == "f" else int(i)) for i in items)
    raise ReadloomError("parse_error", f"unknown aux type in {field!r}")


def reg2bin(begin: int, end: int) -> int:
    end -= 1
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return base + (begin >> shift)
    return 0


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a SAM file. Records with under 11 fields, unknown references or a header line after the first record are errors."""
    header = read_header(path)
    index = {name: i for i, (name, _) in enumerate(header.references)}
    n_header = len(header.lines)

    def decode(arrow):
        names = [c.split(" ")[0] for c in S.READS.split(", ")]
        for batch in arrow:
            rows = []
            for line, ordinal in zip(batch.column("value").to_pylist(), batch.column("ordinal").to_pylist(), strict=True):
                f = line.split("\t")
                if len(f) < 11:
                    raise ReadloomError("parse_error", f"record {ordinal + 1} has {len(f)} fields")
                if f[2] != "*" and f[2] not in index or f[6] not in ("*", "=") and f[6] not in index:
                    raise ReadloomError("parse_error", f"record {ordinal + 1} names an unknown reference")
                ref = index.get(f[2], -1)
                mate = ref if f[6] == "=" else index.get(f[6], -1)
                pos, cigar = int(f[3]) - 1, encode_cigar(f[5])
                span = sum(int(n) for n, o in re.findall(r"(\d+)([MDN=X])", f[5]))
                sequence = "" if f[9] == "*" else f[9]
                if f[10] != "*" and len(f[10]) != len(sequence):
                    raise ReadloomError("parse_error", f"record {ordinal + 1}: quality and sequence differ in length")
                bin_ = reg2bin(pos, pos + max(span, 1)) if pos >= 0 else S.UNMAPPED_BIN
                bases, qual, aux = encode_bases(sequence), encode_quality(f[10], len(sequence)), b"".join(map(encode_aux, f[11:]))
                size = 32 + len(f[0].encode()) + 1 + len(cigar) + len(bases) + len(qual) + len(aux)
                rows.append((path, ordinal, size, ref, pos, bin_, int(f[4]), int(f[1]), len(cigar) // 4, len(sequence), mate, int(f[7]) - 1, int(f[8]), f[0], cigar, bases, qual, aux))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
            types = [kinds[c.split(" ")[1]] for c in S.READS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    lines = text_lines(spark, path).where(F.col("value") != "")
    body = lines.where(F.col("line") >= n_header).select("value", (F.col("line") - n_header).alias("ordinal"))
    if not body.where(F.col("value").rlike(r"^@[A-Z]{2}\t")).isEmpty():
        raise ReadloomError("invalid_header", "a header line after the first record")
    return body.mapInArrow(decode, S.READS)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): the lines of a text file with their numbers from 0, split by Spark; numbers come from counts per partition."""
    text = spark.read.text(path).select("value", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    counts = text.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("__first"))
    from pyspark.sql.window import Window

    ahead = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__p", "__first", ahead.alias("__start"))  # a row per input partition
    return text.join(F.broadcast(starts), "__p").select("value", (F.col("__start") + F.col("__i") - F.col("__first")).alias("line"))
