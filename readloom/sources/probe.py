"""Format identification from a prefix and, failing that, the extension."""

from __future__ import annotations

from dataclasses import dataclass

from readloom.errors import ReadloomError
from readloom.sources import bgzf
from readloom.sources.files import open_input


@dataclass(frozen=True)
class Probe:
    format: str
    container: str
    confidence: str


# What an extension alone suggests.
EXTENSIONS = (
    (("bam",), "BAM", "bgzf"),
    (("sam",), "SAM", "plain_text"),
    (("cram",), "CRAM", "binary"),
    (("fastq.gz", "fq.gz"), "FASTQ.GZ", "gzip"),
    (("fastq", "fq"), "FASTQ", "plain_text"),
    (("fasta", "fa", "fna"), "FASTA", "plain_text"),
    (("bed",), "BED", "plain_text"),
    (("gff", "gff3"), "GFF", "plain_text"),
)


def _has(path: str, *suffixes: str) -> bool:
    lower = path.lower()
    return any(lower.endswith("." + s) for s in suffixes)


def _hint(path: str) -> Probe | None:
    return next((Probe(f, c, "medium") for s, f, c in EXTENSIONS if _has(path, *s)), None)


def _text_format(text: str) -> str | None:
    lines = [line for line in text.splitlines() if line.strip()]
    if not lines:
        return None
    if lines[0].startswith(">"):
        return "FASTA"
    if len(lines) >= 4 and lines[0].startswith("@") and lines[2].startswith("+"):
        return "FASTQ"
    if lines[0][:3] in ("@HD", "@SQ", "@RG", "@PG", "@CO") or lines[0].count("\t") >= 10:
        return "SAM"
    data = [line for line in lines if not line.strip().startswith("#")]
    if any(line.startswith("##gff-version") for line in lines) or (data and data[0].count("\t") == 8):
        return "GFF"
    rows = [line for line in data if not line.strip().startswith("track")]
    fields = rows[0].split("\t") if rows else []
    if len(fields) >= 3 and fields[1].isdigit() and fields[2].isdigit():
        return "BED"
    return None


def probe(path: str, compat: bool = False) -> Probe:
    """What a file is. Blocked-gzip FASTQ is known by its extension; ``compat`` leaves it unknown."""
    with open_input(path) as stream:
        prefix = stream.read(8192)
        if not prefix:
            return _hint(path) or Probe("UNKNOWN", "unknown", "low")
        if (size := bgzf.member_size(prefix)) is not None:
            stream.seek(0)
            try:
                magic = bgzf.inflate(stream.read(size))[:4] == b"BAM\1"
            except ReadloomError:
                magic = False
            if magic:
                return Probe("BAM", "bgzf", "high")
            if _has(path, "bam"):
                return Probe("BAM", "bgzf", "medium")
            if not compat and _has(path, "fastq.gz", "fq.gz"):
                return Probe("FASTQ.GZ", "bgzf", "high")
            return Probe("UNKNOWN", "bgzf", "low")
    if prefix[:2] == b"\x1f\x8b":
        if _has(path, "bam"):
            return Probe("BAM", "gzip", "low")
        if _has(path, "fastq.gz", "fq.gz"):
            return Probe("FASTQ.GZ", "gzip", "high")
        hint = _hint(path)
        return Probe(hint.format, "gzip", "low") if hint else Probe("UNKNOWN", "gzip", "low")
    if prefix[:4] == b"CRAM":
        return Probe("CRAM", "binary", "high")
    if b"\0" not in prefix and (found := _text_format(prefix.decode("utf-8", "replace"))):
        return Probe(found, "plain_text", "high" if found in ("FASTA", "FASTQ", "SAM") else "medium")
    hint = _hint(path)
    return Probe(hint.format, hint.container, "low") if hint else Probe("UNKNOWN", "plain_text" if b"\0" not in prefix else "binary", "low")


def verify(path: str) -> Probe:
    """A shallow check that a file is a blocked-gzip BAM."""
    found = probe(path)
    if found.format == "UNKNOWN":
        raise ReadloomError("unknown_format", path)
    if found.format != "BAM":
        raise ReadloomError("not_bam", f"{path} is {found.format}")
    if found.container != "bgzf" or found.confidence != "high":
        raise ReadloomError("invalid_bam", f"{path} has no alignment magic in its first block")
    return found


def check_eof(path: str) -> None:
    with open_input(path) as stream:
        if not bgzf.has_eof_marker(stream):
            raise ReadloomError("truncated_file", f"{path} doesn't end in the end marker")
