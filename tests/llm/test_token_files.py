"""Token id files: the library's own ids, the exact way back, frames read alone, damage noticed."""

from __future__ import annotations

import io
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagweave.llm import chunk_encoder, kernels, token_files
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
zstandard = pytest.importorskip("zstandard")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"
ODD = [(80, "a<|endoftext|>b don't've 'll"), (81, "x\x85y\xa0z\x1cq  \n\n w"), (82, "é" * 9 + "　" + "中文" * 40), (83, "\x00 \x7f _a1.b'"), (84, "x" * 70_000)]
DOCS = [(i, t if t is None else t[:40_000]) for i, t in brute.corpus()] + ODD


def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


PIECES = st.sampled_from(["a", "B", "é", "Σ", "ſ", "1", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", " ", "'", "'s", "'ll", ".", "—", "«", "_", "<|endoftext|>", "<|", "́", "中", "\U0001F600", "\x00", "ab" * 40])


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_give_the_ids_of_whole_texts(path):
    whole, encoder = tokenizer(path), chunk_encoder.ChunkEncoder(path, 7)
    assert encoder.cuts is not None

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(PIECES, max_size=25).map("".join), max_size=5))
    def same(texts):
        ids, bounds = encoder.encode(*kernels.text_bytes(pa.array(texts, pa.string())))
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [whole.encode(t, add_special_tokens=False).ids + [7] for t in texts]

    same()


def test_memory_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr(chunk_encoder, "KNOWN", 300)
    encoder, whole = chunk_encoder.ChunkEncoder(BYTES, 0), tokenizer(BYTES)
    rng = random.Random(3)
    for k in range(12):
        texts = ["often seen " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(40)) + "\xa0".join(["wide"] * 300) for _ in range(5)]
        ids, _ = encoder.encode(*kernels.text_bytes(pa.array(texts)))
        assert ids.tolist() == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids + [0]]
        known = encoder.known
        assert len(known) <= 300 and max(np.diff(np.array(known.ends, np.int64))) <= chunk_encoder.LONG_BYTES and len(known.starts) == len(known) + 1
    assert b" seen" in known.text


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(chunk_encoder, "_hashes", lambda data, bounds: (bounds[1:] - bounds[:-1]).astype(np.uint64) % np.uint64(3))
    encoder, whole = chunk_encoder.ChunkEncoder(BYTES, 0), tokenizer(BYTES)
    for text in ("one two six ten a bc", "six two one zoo b cd", "a bc six"):
        ids, _ = encoder.encode(*kernels.text_bytes(pa.array([text])))
        assert ids.tolist() == whole.encode(text).ids + [0]


def test_unknown_pre_tokenizers_are_not_cut():
    assert chunk_encoder.cuts_of({"normalizer": None, "pre_tokenizer": {"type": "Whitespace"}}) is None
    assert chunk_encoder.cuts_of({"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}) is None


def expected(docs, path=BYTES, end=2):
    """(doc_id, n_tokens, crc) in the order of the files, rows of one id in any order."""
    t = tokenizer(path)
    out = []
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("how", [{}, {"frame_ids": 100, "file_bytes": 20_000}])
def test_read_back(spark, tmp_path, how):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in DOCS], "doc_id long, text string, tie string, n_tokens int").repartition(4)
    files = token_files.write_tokens(docs, BYTES, str(tmp_path / "t"), **how)
    got = token_files.read_documents(files, with_ids=True).orderBy("start").collect()
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == expected(DOCS)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    # Any zstandard reader sees the ids of a file as one stream.
    stream = b""
    for r in files.orderBy("part").collect():
        raw = Path(r.file).read_bytes()
        assert len(raw) == r.n_bytes
        stream += zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert np.frombuffer(stream, "<u2").tolist() == [i for r in got for i in r.ids]


def test_one_id_holds_a_third_of_all_rows(spark, tmp_path):
    docs = [(i, f"text {i}") for i in range(200)] + [(7, "same text " * 30)] * 100
    files = token_files.write_tokens(spark.createDataFrame(docs, SCHEMA).repartition(3), BYTES, str(tmp_path / "t"), file_bytes=1500)
    assert files.count() >= 4 and max(r.n_docs for r in files.collect()) < 100
    got = token_files.read_documents(files).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id != 7] == [r for r in expected(docs) if r[0] != 7]
    assert [r.doc_id for r in got] == sorted(i for i, _ in docs)


def test_only_requested_frames_are_read(spark, tmp_path):
    docs = [(i, brute.prose(random.Random(i), 60)) for i in range(50)]
    files = token_files.write_tokens(spark.createDataFrame(docs, SCHEMA), BYTES, str(tmp_path / "t"), file_bytes=1 << 30)
    place = [r.file for r in files.collect()]
    f = token_files.TokenFile.open(place[0])
    at = f.index.column("doc_id").to_pylist().index(docs[0][0])
    raw = bytearray(Path(place[0]).read_bytes())
    last = int(f.at[f.first_frame[at + 1]])
    raw[last + 20] ^= 0xFF
    Path(place[0]).write_bytes(raw)
    t = tokenizer(BYTES)
    got = token_files.fetch(files, spark.createDataFrame([(0,), (0,), (999,), (None,)], "doc_id long")).collect()
    assert [(r.doc_id, r.ids) for r in got] == [(0, t.encode(docs[0][1], add_special_tokens=False).ids + [2])]
    with pytest.raises(Exception, match="checksum|corrupt|match|decompress"):
        list(token_files.TokenFile.open(place[0]).frames(0, len(f.sizes)))
    raw[-1] ^= 0xFF
    Path(place[0]).write_bytes(raw)
    with pytest.raises(ValueError, match="seek table"):
        token_files.TokenFile.open(place[0])


def test_four_byte_ids_and_string_keys(spark, tmp_path):
    docs = spark.createDataFrame([("b", "one"), ("a", None), (None, "two")], "k string, body string")
    files = token_files.write_tokens(docs, BYTES, str(tmp_path / "t"), end_id=1 << 17, doc_id="k", text="body")
    got = token_files.read_documents(files, with_ids=True).orderBy("start").collect()
    t = tokenizer(BYTES)
    assert [(r.doc_id, r.ids) for r in got] == [(k, t.encode(x, add_special_tokens=False).ids + [1 << 17]) for k, x in ((None, "two"), ("a", ""), ("b", "one"))]


def test_no_documents(spark, tmp_path):
    files = token_files.write_tokens(spark.createDataFrame([], SCHEMA), BYTES, str(tmp_path / "t"))
    assert files.count() == 0 == token_files.read_documents(files).count()
    assert token_files.fetch(files, spark.createDataFrame([(1,)], "doc_id long")).count() == 0
    one = token_files.write_tokens(spark.createDataFrame([(5, None)], SCHEMA).withColumn("frames", F.lit("clash")), BYTES, str(tmp_path / "u"))
    assert [tuple(r) for r in token_files.read_documents(one).collect()] == [(5, 0, 1, zlib.crc32(np.array([2], "<u4").tobytes()))]
