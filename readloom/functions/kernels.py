"""Arrow kernels for what SQL functions can't express: wrapping 64-bit hashes, packed bases, aux bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the public algorithms: FNV-1a 64 offset and prime, SplitMix64 increment and multipliers, base codes.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BASES = "=ACMGRSVTWYHKDBN"
MASK = (1 << 64) - 1

_DECODE = np.frombuffer(BASES.encode(), np.uint8)
_ENCODE = np.full(256, 15, np.uint8)
for _i, _c in enumerate(BASES):
    _ENCODE[[ord(_c), ord(_c.lower())]] = _i


def fnv1a64(data: bytes) -> int:
    value = FNV_OFFSET
    for b in data:
        value = (value ^ b) * FNV_PRIME & MASK
    return value


def fnv1a64_many(values: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings, a byte position at a time over all that are long enough."""
    lengths = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-lengths, kind="stable")
    out = np.full(len(values), FNV_OFFSET, np.uint64)
    data = np.frombuffer(b"".join(values), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    longest = int(lengths.max(initial=0))
    live = len(values)
    sorted_lengths = lengths[order]
    for i in range(longest):
        while live and sorted_lengths[live - 1] <= i:
            live -= 1
        at = order[:live]
        out[at] = (out[at] ^ data[starts[at] + i].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return out


def splitmix64(seed: int, n: np.ndarray) -> np.ndarray:
    """The n-th outputs (from 0) of the SplitMix64 stream of a seed, each on its own."""
    x = np.uint64(seed & MASK) + (n.astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def keep_threshold(fraction: float) -> int:
    """A draw is kept if it is no greater than this: floor of fraction times the largest 64-bit value as a double."""
    return min(int(fraction * float(MASK)), MASK)


def decode_bases(packed: bytes, length: int) -> str:
    codes = np.frombuffer(packed, np.uint8)
    both = np.empty(2 * len(codes), np.uint8)
    both[0::2], both[1::2] = codes >> 4, codes & 15
    return _DECODE[both[:length]].tobytes().decode() if length else "*"


def encode_bases(sequence: str) -> bytes:
    codes = _ENCODE[np.frombuffer(sequence.encode(), np.uint8)]
    if len(codes) % 2:
        codes = np.append(codes, 0)
    return ((codes[0::2] << 4) | codes[1::2]).astype(np.uint8).tobytes()


def decode_quality(raw: bytes) -> str:
    """Text form of quality bytes; all-0xff is ``*``; a mixture of missing and present values is an error."""
    if all(b == 0xFF for b in raw):
        return "*"
    if any(b > 93 for b in raw):
        raise ValueError("quality out of range")
    return bytes(b + 33 for b in raw).decode()


def encode_quality(text: str | None, length: int) -> bytes:
    return b"\xff" * length if text in (None, "*") else bytes(b - 33 for b in text.encode())


_SCALARS = {b"A": ("<c", 1), b"c": ("<b", 1), b"C": ("<B", 1), b"s": ("<h", 2), b"S": ("<H", 2), b"i": ("<i", 4), b"I": ("<I", 4), b"f": ("<f", 4)}


def walk_aux(raw: bytes) -> list[tuple[str, str, bytes]]:
    """(tag, type, payload bytes) of each aux field in order; a field that runs over the end is an error."""
    return list(aux_fields(raw))


def aux_tags(raw: bytes) -> tuple[list[str], str | None]:
    """The tags of the aux fields up to the first that can't be read, and what is wrong with that one."""
    tags: list[str] = []
    try:
        for tag, _, _ in aux_fields(raw):
            tags.append(tag)
    except ValueError as e:
        return tags, str(e)
    return tags, None


def aux_fields(raw: bytes) -> Iterator[tuple[str, str, bytes]]:
    """The fields that ``walk_aux`` lists, one by one."""
    at = 0
    while at < len(raw):
        if at + 3 > len(raw):
            raise ValueError("truncated aux field")
        tag, kind, at = raw[at : at + 2].decode("ascii"), raw[at + 2 : at + 3], at + 3
        if kind in _SCALARS:
            size = _SCALARS[kind][1]
        elif kind in (b"Z", b"H"):
            end = raw.find(b"\0", at)
            size = end - at + 1 if end >= 0 else len(raw) + 1
        elif kind == b"B":
            sub, count = raw[at : at + 1], raw[at + 1 : at + 5]
            if sub not in _SCALARS or sub == b"A" or len(count) < 4:
                raise ValueError("bad aux array")
            size = 5 + _SCALARS[sub][1] * struct.unpack("<I", count)[0]
        else:
            raise ValueError(f"unknown aux type {kind!r}")
        if at + size > len(raw):
            raise ValueError("truncated aux field")
        yield tag, kind.decode(), raw[at : at + size]
        at += size


def aux_value(kind: str, payload: bytes):
    """Python value of an aux payload."""
    if kind in ("Z", "H"):
        return payload[:-1].decode()
    if kind == "B":
        code, size = _SCALARS[payload[:1]]
        return [struct.unpack(code, payload[i : i + size])[0] for i in range(5, len(payload), size)]
    value = struct.unpack(_SCALARS[kind.encode()][0], payload)[0]
    return value.decode() if kind == "A" else value


@F.pandas_udf(T.LongType())
def fnv1a64_udf(identity: pd.Series) -> pd.Series:
    """FNV-1a 64 of binary identities; as a long with the bits of the unsigned value."""
    return pd.Series(fnv1a64_many([bytes(v) for v in identity]).view(np.int64))


def splitmix64_udf(seed: int):
    @F.pandas_udf(T.LongType())
    def draw(n: pd.Series) -> pd.Series:
        return pd.Series(splitmix64(seed, n.to_numpy()).view(np.int64))

    return draw
