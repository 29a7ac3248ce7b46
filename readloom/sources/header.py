"""Alignment headers: text and binary forms, and the relations made from them."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from readloom import schema as S
from readloom.errors import ReadloomError
from readloom.operators.checksum import framed

# Limits on what a header may claim.
MOST_TEXT, MOST_REFERENCES, MOST_NAME = 16 << 20, 1_000_000, 1 << 20

_RG = {"ID": "id", "SM": "sample", "LB": "library", "PL": "platform", "PU": "platform_unit", "CN": "center", "DS": "description", "DT": "date"}
_PG = {"ID": "id", "PN": "name", "VN": "version", "CL": "command_line", "PP": "previous_program_id", "DS": "description"}


@dataclass
class Header:
    """Header lines in order as (type, [(tag, value)]) or ("CO", text), and the binary reference dictionary."""

    lines: list[tuple[str, list[tuple[str, str]] | str]] = field(default_factory=list)
    references: list[tuple[str, int]] = field(default_factory=list)

    @staticmethod
    def parse_text(text: str) -> Header:
        header = Header()
        for number, line in enumerate(text.split("\n"), 1):
            line = line.rstrip("\r\0")
            if not line:
                continue
            if not line.startswith("@") or len(line) < 3:
                raise ReadloomError("invalid_header", f"header line {number} has no record type")
            kind = line[1:3]
            if kind == "CO":
                header.lines.append((kind, line[4:]))
                continue
            fields = []
            for part in line.split("\t")[1:]:
                tag, colon, value = part.partition(":")
                if not colon or len(tag) != 2:
                    raise ReadloomError("invalid_header", f"header line {number}: bad field {part!r}")
                fields.append((tag, value))
            header.lines.append((kind, fields))
        header.references = [(f["SN"], int(f["LN"])) for f in header.records("SQ") if "SN" in f and f.get("LN", "").isdigit()]
        return header

    def records(self, kind: str) -> list[dict[str, str]]:
        return [dict(f) for k, f in self.lines if k == kind and k != "CO"]

    def text(self) -> str:
        out = []
        for kind, fields in self.lines:
            out.append(f"@{kind}\t{fields}" if kind == "CO" else "\t".join([f"@{kind}", *[f"{t}:{v}" for t, v in fields]]))
        return "".join(line + "\n" for line in out)

    def binary(self) -> bytes:
        text = self.text().encode()
        parts = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(self.references))]
        for name, length in self.references:
            raw = name.encode() + b"\0"
            parts += [struct.pack("<i", len(raw)), raw, struct.pack("<I", length)]
        return b"".join(parts)

    def digested(self) -> bytes:
        """The bytes that a header's checksum covers: text and references, names and text behind their length."""
        text = self.text().encode()
        parts = [framed(text), struct.pack("<I", len(self.references))]
        for name, length in self.references:
            parts += [framed(name.encode()), struct.pack("<I", length)]
        return b"".join(parts)

    def with_order(self, order: str, sub_order: str | None = None) -> Header:
        """The header after sorting: SO set, GO gone, SS set or gone; an @HD line is put first where there is none."""
        drop = {"SO", "GO", "SS"}
        new = [("SO", order), *([("SS", sub_order)] if sub_order else [])]
        lines = [(k, [*[f for f in fields if f[0] not in drop], *new] if k == "HD" else fields) for k, fields in self.lines]
        if not any(k == "HD" for k, _ in lines):
            lines.insert(0, ("HD", new))
        return Header(lines, list(self.references))

    def unmapped(self) -> Header:
        """The header of unmapped records: no references, unsorted; GO stays."""
        lines = [(k, f) for k, f in self.lines if k != "SQ"]
        lines = [(k, [*[x for x in f if x[0] not in ("SO", "SS")], ("SO", "unsorted")] if k == "HD" else f) for k, f in lines]
        return Header(lines, [])

    # reheader operations, applied in this order by ``reheader``

    def replace(self, other: Header) -> Header:
        names = [n for n, _ in other.references]
        if other.references != self.references or len(set(names)) != len(names):
            raise ReadloomError("header_mismatch", "the new header's references differ in order, name or length")
        return Header(list(other.lines), list(self.references))

    def upsert(self, kind: str, values: dict[str, str], add: bool = False) -> Header:
        if "ID" not in values:
            raise ReadloomError("invalid_argument", f"@{kind} needs an ID")
        lines, found = [], False
        for k, f in self.lines:
            if k == kind and dict(f).get("ID") == values["ID"]:
                if add:
                    raise ReadloomError("invalid_argument", f"@{kind} {values['ID']} exists")
                found = True
                f = [*[(t, values.get(t, v)) for t, v in f], *[(t, v) for t, v in values.items() if t not in dict(f)]]
            lines.append((k, f))
        if not found:
            lines.append((kind, list(values.items())))
        return Header(lines, list(self.references))

    def remove_rg(self, rg_id: str) -> Header:
        lines = [(k, f) for k, f in self.lines if not (k == "RG" and dict(f).get("ID") == rg_id)]
        if len(lines) == len(self.lines):
            raise ReadloomError("missing_read_group", rg_id)
        return Header(lines, list(self.references))

    def comment(self, text: str) -> Header:
        return Header([*self.lines, ("CO", text)], list(self.references))

    # relations

    def refs(self, spark: SparkSession) -> DataFrame:
        text = {f.get("SN"): f for f in self.records("SQ")}
        rows = []
        for i, (name, length) in enumerate(self.references):
            f = text.get(name, {})
            said = int(f["LN"]) if f.get("LN", "").isdigit() else None
            rows.append((i, name, length, f.get("M5"), f.get("UR"), f.get("AS"), f.get("SP"), f.get("TP"), said if said != length else None))
        return spark.createDataFrame(rows, S.REFS)

    def read_groups(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *[f.get(t) for t in _RG], {t: v for t, v in f.items() if t not in _RG}) for i, f in enumerate(self.records("RG"))]
        return spark.createDataFrame(rows, S.READ_GROUPS)

    def programs(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *[f.get(t) for t in _PG], {t: v for t, v in f.items() if t not in _PG}) for i, f in enumerate(self.records("PG"))]
        return spark.createDataFrame(rows, S.PROGRAMS)

    def comments(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, t) for i, t in enumerate(f for k, f in self.lines if k == "CO")], "pos int, text string")


def reheader(header: Header, replacement: Header | None = None, add_rg=(), set_rg=(), remove_rg=(), sample: str | None = None, platform: str | None = None, target_rg: str | None = None, set_pg=(), comments=()) -> Header:
    """Header changes in a fixed order: replace, add, set and remove read groups, sample and platform on the target, programs, comments."""
    if replacement is not None:
        header = header.replace(replacement)
    for values in add_rg:
        header = header.upsert("RG", values, add=True)
    for values in set_rg:
        header = header.upsert("RG", values)
    for rg_id in remove_rg:
        header = header.remove_rg(rg_id)
    if sample or platform:
        groups = [f["ID"] for f in header.records("RG") if "ID" in f]
        target = target_rg or (groups[0] if len(groups) == 1 else None)
        if target is None or target not in groups:
            raise ReadloomError("missing_read_group", "no single read group to set sample or platform on")
        header = header.upsert("RG", {"ID": target, **({"SM": sample} if sample else {}), **({"PL": platform} if platform else {})})
    for values in set_pg:
        header = header.upsert("PG", values)
    for text in comments:
        header = header.comment(text)
    return header


def parse_binary(data: bytes) -> tuple[Header, int]:
    """A header from the start of an inflated stream, and where records begin; IndexError if the data ends too soon."""

    def number(at: int) -> int:
        if at + 4 > len(data):
            raise IndexError
        return struct.unpack_from("<i", data, at)[0]

    if len(data) < 4:
        raise IndexError
    if data[:4] != b"BAM\1":
        raise ReadloomError("invalid_bam", "no alignment magic")
    size = number(4)
    if not 0 <= size <= MOST_TEXT:
        raise ReadloomError("invalid_header", "header text is too long")
    if len(data) < 8 + size:
        raise IndexError
    header = Header.parse_text(data[8 : 8 + size].decode())
    at = 8 + size
    count = number(at)
    if not 0 <= count <= MOST_REFERENCES:
        raise ReadloomError("invalid_header", "too many references")
    at += 4
    references = []
    for _ in range(count):
        n = number(at)
        if not 1 <= n <= MOST_NAME:
            raise ReadloomError("invalid_header", "bad reference name")
        if at + 8 + n > len(data):
            raise IndexError
        references.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<I", data, at + 4 + n)[0]))
        at += 8 + n
    header.references = references
    return header, at
