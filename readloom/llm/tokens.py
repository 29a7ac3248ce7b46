"""Whole-text tokenisation that gives the tokenizers library's ids, by way of a cache of white-space-free chunks."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

#: Entries of a worker's cache before it starts anew; some 200 bytes each.
CACHE_ENTRIES = 700_000
#: Longer chunks are encoded each time rather than remembered.
CACHED_BYTES = 64
#: UTF-8 lead bytes from here on are of U+0300 and above.
_HIGH = 0xCC
#: Batches are split about so many bytes of text at a time, as numbers for each chunk and id are held meanwhile.
SPLIT_BYTES = 2 << 20

_SPACE, _DIGIT, _MARK, _LETTER, _NOT_ASCII = range(5)
_KINDS = bytes(
    _NOT_ASCII if c > 127 else _SPACE if chr(c) in " \t\n\v\f\r" else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK
    for c in range(256)
)

_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file; made once, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class ChunkEncoder:
    """Encode texts as little-endian unsigned 32-bit ids.

    Valid for tokenizers that lower-case, drop white space, keep letters and marks
    in separate runs and never join text across ASCII white space: then the ids of
    a text are those of its white-space-free chunks in turn. Each distinct chunk
    goes through the library once. In texts without special tokens or characters
    from U+0300 on (no combining marks), ASCII letters are lower-cased and chunks
    cut between a letter and a mark beforehand, which changes no id and makes for
    fewer distinct chunks.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        self._tokenizer = Tokenizer.from_file(path)
        # the same model and pre-tokenizer; lower-casing is the one step of normalisation that plain letters need
        self._letters = Tokenizer(self._tokenizer.model)
        self._letters.normalizer = normalizers.Lowercase()
        self._letters.pre_tokenizer = self._tokenizer.pre_tokenizer
        self._chunks: dict[bytes, bytes] = {}
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def forget(self) -> None:
        """Empty the cache, as workers stay when their task is over."""
        self._chunks = {}

    def encode(self, texts: list[bytes], most: int | None = None) -> list[bytes]:
        """The ids of each text; ``most`` bounds the cache instead of ``CACHE_ENTRIES``."""
        return [ids for a, b in batches(texts) for ids in self._encode(texts[a:b], most or CACHE_ENTRIES)]

    def _encode(self, texts: list[bytes], most: int) -> list[bytes]:
        distinct, which, begins = split(texts)
        chunks = self._chunks
        missing = [c for c in distinct if c not in chunks]
        if missing:
            if len(chunks) + len(missing) > most:
                chunks = self._chunks = {}
                missing = distinct
            plain = [c for c in missing if c.isalpha() or _plain(c)]
            chunks.update(zip(plain, self._words(plain), strict=True))
            others = [c for c in missing if c not in chunks]
            chunks.update(zip(others, self._library(others), strict=True))
        found = [chunks[c] for c in distinct]
        for c in missing:
            if len(c) > CACHED_BYTES:
                del chunks[c]
        # the ids of all texts in turn
        taken = pa.array(found, pa.large_binary()).take(which)
        _, offsets, ids = taken.buffers()
        cuts = np.frombuffer(offsets, np.int64, len(taken) + 1)[begins].tolist()
        ids = memoryview(ids or b"")
        return [bytes(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _words(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks that are one run of plain letters each: many are encoded as one text, then cut where a token ends a word."""
        out: list[bytes] = []
        groups = [chunks[i : i + 256] for i in range(0, len(chunks), 256)]
        found = self._letters.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, found, strict=True):
            ids = np.array(encoding.ids, "<u4")
            cuts = np.flatnonzero(self._ends[ids]) + 1
            if len(cuts) != len(group):
                out += self._library(group)
                continue
            flat, begin = ids.tobytes(), 0
            for cut in (cuts * 4).tolist():
                out.append(flat[begin:cut])
                begin = cut
        return out

    def _library(self, chunks: list[bytes]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]


def _plain(chunk: bytes) -> bool:
    """Letters below U+0130 only: neither normalisation nor lower-casing brings in anything but letters."""
    text = chunk.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "İ"


def split(texts: list[bytes]) -> tuple[list[bytes], pa.Array, np.ndarray]:
    """The distinct chunks of texts, which of them each chunk of the texts in turn is, and the places there of each text's first chunk and of the end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    joined = b"\n".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    unusual = np.maximum.reduceat(data, starts) >= _HIGH if len(texts) else np.zeros(0, bool)
    if b"<|" in joined:
        unusual |= np.fromiter((b"<|" in t for t in texts), bool, len(texts))
    joined = b"\n".join([*(t if u else t.lower() for t, u in zip(texts, unusual.tolist(), strict=True)), b""])
    data, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS), np.uint8)
    kept = kind != _SPACE
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    # where a mark follows an ASCII letter or one of U+00C0 to U+00FF, all of which are letters but for two signs
    cut = np.flatnonzero((kind[1:] == _MARK) & (kind[:-1] >= _LETTER)) + 1
    last, lead = data[cut - 1], data[cut - 2]
    cut = cut[(last < 0x80) | ((cut > 1) & (lead == 0xC3) & (last < 0xC0) & (last != 0x97) & (last != 0xB7))]
    if unusual.any():
        cut = cut[~unusual[np.searchsorted(ends, cut, "right")]]
    first[cut] = True
    at = np.flatnonzero(first)
    letters = data[kept]
    offsets = np.append(np.flatnonzero(first[kept]), len(letters))
    chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    found = chunks.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices, np.searchsorted(at, np.append(starts, len(data)))


def batches(texts: list[bytes], size: int = SPLIT_BYTES) -> list[tuple[int, int]]:
    """Runs of texts of about so many bytes."""
    out, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            out.append((begin, i + 1))
            begin, held = i + 1, 0
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out
