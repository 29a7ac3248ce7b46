"""Index files next to alignments: what they say, and whether they fit."""

from __future__ import annotations

import gzip
import os
import struct

from readloom.errors import ReadloomError
from readloom.sources.files import read_all

# Magics, and the pseudo-bin that holds counts.
BAI_MAGIC, CSI_MAGIC, METADATA_BIN = b"BAI\1", b"CSI\1", 37450


def parse_bai(path: str, references: int) -> tuple[list[tuple[int, int] | None], int | None]:
    """(mapped, unmapped) of each reference where the index has them, and the number of unplaced records if given."""
    data = read_all(path)
    if data[:4] == CSI_MAGIC:
        raise ReadloomError("unsupported_index", "CSI")
    if data[:4] != BAI_MAGIC:
        raise ReadloomError("invalid_index", "not a BAI index")
    try:
        at, (n,) = 8, struct.unpack_from("<i", data, 4)
        if n != references:
            raise ReadloomError("invalid_index", f"the index has {n} references, the header {references}")
        out: list[tuple[int, int] | None] = []
        for _ in range(n):
            (bins,), at, found = struct.unpack_from("<i", data, at), at + 4, None
            for _ in range(bins):
                number, chunks = struct.unpack_from("<Ii", data, at)
                if number == METADATA_BIN:
                    if chunks != 2:
                        raise ReadloomError("invalid_index", "the counts' bin has not two chunks")
                    found = struct.unpack_from("<QQ", data, at + 24)
                at += 8 + 16 * chunks
            (intervals,) = struct.unpack_from("<i", data, at)
            at += 4 + 8 * intervals
            out.append(found)
        if at > len(data):
            raise struct.error
        return out, struct.unpack_from("<Q", data, at)[0] if at + 8 <= len(data) else None
    except struct.error:
        raise ReadloomError("invalid_index", "the index ends too soon") from None


def parse_csi_header(path: str) -> dict[str, int]:
    data = read_all(path)
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    if data[:4] != CSI_MAGIC or len(data) < 16:
        raise ReadloomError("invalid_index", "not a CSI index")
    shift, depth, aux = struct.unpack_from("<iii", data, 4)
    return {"min_shift": shift, "depth": depth, "aux_length": aux}


def check_index(bam: str, references: int, require: bool = False, prefer_csi: bool = False) -> dict[str, str | None]:
    """State of the index next to a BAM: plausible, stale, absent, mismatched_or_invalid, detected_but_not_supported."""
    stems = [bam, bam[:-4] if bam.endswith(".bam") else bam]
    kinds = ("csi", "bai") if prefer_csi else ("bai", "csi")
    found = next((p for k in kinds for s in stems if os.path.exists(p := f"{s}.{k}")), None)
    if found is None:
        if require:
            raise ReadloomError("missing_index", f"{bam} has no index")
        return {"state": "absent", "path": None}
    if found.endswith(".csi"):
        parse_csi_header(found)
        return {"state": "detected_but_not_supported", "path": found}
    try:
        parse_bai(found, references)
    except ReadloomError:
        return {"state": "mismatched_or_invalid", "path": found}
    stale = os.path.getmtime(found) < os.path.getmtime(bam)
    return {"state": "stale" if stale else "plausible", "path": found}
