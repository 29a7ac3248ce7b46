"""Token store, packing: exact round trips against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.llm import packing, queries, token_store
from readloom.llm.tokens import encoder

ODD = [
    "it's <|endoftext|>foo,  a\x1cb É.",
    "İI'LL ß, W̊ x y z Σς,",
    "don't's 12,345.. a,b, , ?!  wide　space",
    "",
    None,
    " \t\n",
    "word " * 5000,
    "x" * 70000,
    "a, b, a, b.",
    "tab\tand\x0bvt\x0cff\r\nnl",
]
SCHEMA = "doc_id long, text string, start string, length string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def expected_ids(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def odd_docs(spark):
    rows = [(i * 3 - 5, t, "s", "l") for i, t in enumerate(ODD)] + [(100, "again", "s", "l"), (100, "again", "s", "l"), (None, "no id", None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_chunk_encoder_agrees_with_library(library):
    texts = [t or "" for t in ODD]
    for text, ids in zip(texts, encoder(queries.tokenizer_path()).encode([t.encode() for t in texts]), strict=True):
        assert ids == expected_ids(library, text, 0)[:-1].tobytes()


def test_chunks_are_cut_between_letters_and_marks(library):
    chunks = encoder(queries.tokenizer_path())
    chunks.forget()
    texts = ["Word### word.*** \u00e9t\u00e9, \u00e9t\u00e9!! it's a_b c3 2\u00d7, <b\u00f7#", "one\u3000WORD### <|", "word " * 500_000, ""]
    got = chunks.encode([t.encode() for t in texts])
    assert set(chunks._chunks) == {
        t.encode() for t in ("word ### .*** \u00e9t\u00e9 , !! it 's a _b c3 2\u00d7, <b\u00f7# one\u3000WORD### <|").split(" ")
    }
    want = [expected_ids(library, t, 0)[:-1] for t in texts[:2]] + [np.repeat(expected_ids(library, "word", 0)[:-1], 500_000), np.empty(0, "<u4")]
    assert got == [w.tobytes() for w in want]


def test_chunk_encoder_agrees_with_library_on_random_texts(library):
    rng = np.random.default_rng(7)
    plain = ["a", "Z", "s", "ll", "'", "'s", ",", "###", "_", "<", "|", "1", " ", "\n", "\x1c", "\x85", "\xa0", "\xe9", "\xc9", "\xdf", "\xd7", "\xf7", "\xaa", "\xb2", "\u0130", "\u0149", "\u0101"]
    odd = [*plain, "\u0301", "\u4e16", "\u201c", "\u212a", "<|endoftext|>"]
    texts = ["".join(rng.choice(odd if i % 3 == 0 else plain, rng.integers(0, 40))) for i in range(600)]
    for text, ids in zip(texts, encoder(queries.tokenizer_path()).encode([t.encode() for t in texts]), strict=True):
        assert ids == expected_ids(library, text, 0)[:-1].tobytes(), text


def test_packing_leaves_no_cache_in_its_worker(library, monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 4)
    held, chunks = [], encoder(queries.tokenizer_path())
    texts = [f"one{i} two{i} three{i}" for i in range(20)]
    source = (held.append(len(chunks._chunks)) or pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts))
    cut = packing._cutter(queries.tokenizer_path(), 2048, 0)
    chunks.forget()
    got = [tuple(r.values()) for b in cut(source) for r in b.to_pylist()]
    ids = [expected_ids(library, t, 0) for t in texts]
    assert [(r[1], r[4], r[5]) for r in got] == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
    assert 0 < max(held) <= 4 and not chunks._chunks
    stopped = cut(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["cut short"]})]))
    next(stopped)
    stopped.close()
    assert not chunks._chunks


def test_token_store_round_trip(spark, library):
    rows, docs = odd_docs(spark)
    manifest = token_store.write_token_store(docs, queries.tokenizer_path(), end_id=2)
    got = token_store.read_token_store(spark, manifest).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [expected_ids(library, r[1], 2) for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])[:-1]
    want = [(r[0], int(s), len(i), zlib.crc32(i.tobytes())) for r, s, i in zip(rows, starts, ids, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    few = token_store.read_documents(spark, manifest, [1, -5])
    assert set(few) == {1, -5}
    assert few[-5].tolist() == expected_ids(library, ODD[0], 2).tolist()


def test_token_file_detects_a_changed_byte(tmp_path):
    path = str(tmp_path / "one.tok.zst")
    with open(path, "wb") as stream:
        writer = token_store.TokenFileWriter(stream)
        writer.add(1, np.arange(50, dtype="<u4").tobytes())
        writer.add(None, np.array([2], "<u4").tobytes())
        writer.close()
    file = token_store.TokenFile(path)
    assert file.doc_ids == [1, None] and file.read(0).tolist() == list(range(50)) and file.read(1).tolist() == [2]
    import zstandard

    whole = open(path, "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read().startswith(np.arange(50, dtype="<u4").tobytes())
    spoiled = bytearray(whole)
    spoiled[-12] ^= 1  # the checksum of the last frame
    open(path, "wb").write(spoiled)
    with pytest.raises(token_store.CorruptFrame):
        token_store.TokenFile(path).read(1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_store.read_token_store(spark, token_store.write_token_store(none, queries.tokenizer_path())).count() == 0
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_covers_every_token_once(spark, library, capacity):
    rows, docs = odd_docs(spark)
    got = packing.pack(docs, queries.tokenizer_path(), capacity).collect()
    want = []
    for r in rows:
        ids = expected_ids(library, r[1], 0)
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((r[0], piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(g)[:5] for g in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for g in got:
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_plan_is_near_the_bound():
    lengths = np.minimum(np.random.default_rng(3).lognormal(6.2, 1.0, 20000).astype(int) + 1, 2048)
    plan = packing.plan_packing(np.bincount(lengths, minlength=2049), 2048)
    assert sum(t for _, t in plan) <= 1.005 * -(-lengths.sum() // 2048) + 1
    assert sum(len(p) * t for p, t in plan) == 20000


def test_class_patterns_and_least_squares():
    assert set(packing.class_patterns(4, 3)) == {(4,), (3, 1), (2, 2), (2, 1, 1)}
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = packing.nonnegative_least_squares(a, np.array([3.0, 5.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [3, 5])


def test_store_query_starts_are_gapless(spark):
    got = queries.op6_token_store(spark, "/root/testdata/sf0.001").orderBy("start")
    bad = got.withColumn("next", F.expr("lead(start) over (order by start)")).where("next <> start + n_tokens")
    assert bad.count() == 0
