"""Blocked gzip: members that say their own size, so that any of them can be read alone."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from readloom.errors import ReadloomError

# Fixed values of the public format: the empty member that ends a file, and the most bytes a member may have.
EOF_MARKER = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST_MEMBER = 65536
PAYLOAD = MOST_MEMBER - 512


def member_size(header: bytes) -> int | None:
    """Size of the member that begins here, from its BC subfield; None if this isn't one."""
    if len(header) < 18 or header[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", header, 10)[0]
    at, end = 12, 12 + extra
    while at + 4 <= min(end, len(header)):
        tag, size = header[at : at + 2], struct.unpack_from("<H", header, at + 2)[0]
        if tag == b"BC" and size == 2 and at + 6 <= len(header):
            return struct.unpack_from("<H", header, at + 4)[0] + 1
        at += 4 + size
    return None


def members(stream, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """(offset, size) of each member between two offsets; only headers are read."""
    size = stream.size() if end is None else end
    at = begin
    while at < size:
        stream.seek(at)
        n = member_size(stream.read(64))
        if n is None or at + n > stream.size():
            raise ReadloomError("truncated_file", f"no whole member at offset {at}")
        yield at, n
        at += n


def inflate(member: bytes) -> bytes:
    try:
        return zlib.decompress(member, 31)
    except zlib.error as e:
        raise ReadloomError("invalid_bam", "a compressed block can't be read", str(e)) from e


def deflate(payload: bytes, level: int = 6) -> bytes:
    """Members for a payload of any size; one that wouldn't fit is made of less."""
    out, at = [], 0
    while at < len(payload):
        take = min(PAYLOAD, len(payload) - at)
        while True:
            part = payload[at : at + take]
            z = zlib.compressobj(level, zlib.DEFLATED, -15)
            body = z.compress(part) + z.flush()
            size = len(body) + 26
            if size <= MOST_MEMBER:
                break
            take -= 1024
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", size - 1)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
        at += take
    return b"".join(out)


def has_eof_marker(stream) -> bool:
    size = stream.size()
    if size < len(EOF_MARKER):
        return False
    stream.seek(size - len(EOF_MARKER))
    return stream.read(len(EOF_MARKER)) == EOF_MARKER
