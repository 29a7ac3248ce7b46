"""Base-modification tags (MM, ML, MN) between aux bytes and FASTQ header words such as ``ML:B:C,42,7``."""

from __future__ import annotations

import struct

from readloom.errors import ReadloomError
from readloom.functions.kernels import aux_value, walk_aux

TAGS = ("MM", "ML", "MN")


def header_words(aux: bytes) -> list[str]:
    """The words for a read's modification tags, in aux order."""
    words = []
    for tag, kind, payload in walk_aux(aux):
        if tag in TAGS:
            value = aux_value(kind, payload)
            text = ",".join([payload[:1].decode(), *map(str, value)]) if kind == "B" else str(value)
            words.append(f"{tag}:{kind}:{text}")
    return words


def _encode(word: str, length: int) -> bytes:
    tag, _, rest = word.partition(":")
    kind, colon, value = rest.partition(":")
    bad = ReadloomError("invalid_fastq", f"header word {word!r}")
    if not colon:
        raise bad
    try:
        if (tag, kind) == ("MM", "Z"):
            return b"MMZ" + value.encode() + b"\0"
        if (tag, kind) == ("ML", "B") and value.startswith("C,"):
            numbers = bytes(int(v) for v in value[2:].split(",") if v)
            return b"MLBC" + struct.pack("<i", len(numbers)) + numbers
        if tag == "MN" and kind in ("i", "I") and int(value) == length:
            return b"MNi" + struct.pack("<i", length)
    except ValueError:
        raise bad from None
    raise bad


def aux_of_header(header: str, length: int) -> bytes:
    """Aux bytes for the modification words of a raw header; a malformed word, or an MN that isn't the sequence's length, is an error."""
    return b"".join(_encode(w, length) for w in header.split()[1:] if w[:3] in ("MM:", "ML:", "MN:"))
