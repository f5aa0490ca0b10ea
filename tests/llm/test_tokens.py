"""Chunked encoding, byte BPE, Elias-Fano files and packing against the libraries."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import subprocess
import sys
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillstone.llm import byte_bpe, packing, token_files
from rillstone.llm.chunks import ChunkCoder, library_coder, split_blanks
from rillstone.session import local_files

TEXT = st.text(st.one_of(st.sampled_from(" \n\t'sS.,!1aé中 ́\x1c\0🙂"), st.characters(codec="utf-8")), max_size=60)
ODD = [None, "", " ", "\n\n x", "a" * 700, "it's  fine\t\n ok ", "ΟΔΥΣΣΕΥΣ ς", "<|endoftext|> x", "é́ ́", "1234 5.6", "x" * 300 + " " + "ab" * 200]


def library(name):
    return Tokenizer.from_file(P.path(name))


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "blanks"), ("word_bpe_49k.json", "words")])
def test_chunks_equal_whole_texts(name, kind):
    coder, lib = library_coder(P.path(name), kind), library(name)

    def same(texts):
        ids, sizes = coder.encode(texts)
        want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]

    same(ODD)
    same(["a<|endoftext|>", "x <|endoftext|>y z", "<|startoftext|><|endoftext|>", "\x01 \x01a \x01", "a\u0301 \u0308"])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(TEXT, max_size=4))
    def many(texts):
        same(texts)

    many()


def test_special_strings_may_be_text():
    lib = library("byte_bpe_50k.json")
    assert library_coder(P.path("byte_bpe_50k.json"), "blanks").encode(["a <|endoftext|>"])[0].tolist()[-1] == 50256
    lib.encode_special_tokens = True
    ids, _ = library_coder(P.path("byte_bpe_50k.json"), "blanks", special_as_text=True).encode(["a <|endoftext|> b"])
    assert ids.tolist() == lib.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_small_cache_forgets_without_changing_ids():
    lib = library("byte_bpe_50k.json")

    def encode(chunks):
        ids = [e.ids for e in lib.encode_batch(list(chunks), add_special_tokens=False)]
        return np.concatenate([np.array(x, np.uint32) for x in ids]), np.array([len(x) for x in ids])

    coder = ChunkCoder(encode, split_blanks, cap=5)
    for text in ["a b c d e f g h", "a b longer-than-eight c q r s", "z y x w v u t", "z y x w v u t a b c"] * 3:
        ids, _ = coder.encode([text])
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
        assert len(coder.codes) <= 5 and coder.codes.n <= 5


def test_byte_bpe_equals_library_and_round_trips():
    bpe = byte_bpe.loaded(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ODD:
        ids, _ = bpe.encode([text])
        assert ids.tolist() == lib.encode_ordinary(text or "")
        assert bpe.decode(ids) == (text or "").encode()

    @settings(max_examples=200, deadline=None)
    @given(TEXT)
    def many(text):
        ids, _ = bpe.encode([text])
        assert ids.tolist() == lib.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()

    many()
    piece = ("abcdefg" * 20).encode()
    assert bpe._strips(piece).tolist() == bpe._matrix([piece], 256)[0].tolist() == bpe.encode_pieces([piece])[0].tolist()


def test_long_pieces_follow_the_same_rule():
    bpe = byte_bpe.loaded(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(7)
    words = ["the", "ing", "ation", "a", "q", "é", "中", "zz"]
    for n in (255, 256, 257, 511, 512, 513, 1000, 5000):
        for text in ("a" * n, "ab" * (n // 2), "".join(words[i] for i in rng.integers(0, len(words), n))):
            assert bpe.encode([text])[0].tolist() == lib.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(sizes):
    ends = np.cumsum(np.array(sizes, np.int64))
    ef = token_files.EliasFano.build(ends, int(ends[-1]) if sizes else 0)
    assert ef.all().tolist() == ends.tolist()
    for i in {0, len(sizes) // 2, len(sizes) - 1} & set(range(len(sizes))):
        assert ef.get(i) == ends[i]


DOCS = "doc_id long, text string, x int, part int, ids string"


def rows(texts):
    return [(i, t, 1, 2, "x") for i, t in enumerate(texts)]


def test_token_files(spark, tmp_path):
    lib = library("byte_bpe_50k.json")
    texts = [*ODD, "the cat sat"]
    docs = spark.createDataFrame([*rows(texts), (3, texts[3], 1, 2, "x"), (None, "null id", 1, 2, "x")], DOCS)
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, P.path("byte_bpe_50k.json"), segment_ids=100)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    at = 0
    want = sorted([*enumerate(texts), (3, texts[3]), (-1, "null id")], key=lambda x: x[0])
    for r, (i, t) in zip(got, want, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (None if i < 0 else i, at, len(ids), ids)
        assert r.ids_crc32 == crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    empty = str(tmp_path / "empty")
    token_files.write_token_files(docs.limit(0), empty, P.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, empty, True).count() == 0


def test_byte_bpe_table(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame(rows([*ODD, ODD[4]]), DOCS)
    back = byte_bpe.decode_table(byte_bpe.encode_table(docs, path, P.PATTERN), path, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate([*ODD, ODD[4]])}
    d = {r.doc_id: r for r in byte_bpe.digest_table(docs, path, P.PATTERN).collect()}
    assert d[0].ids_sha256 == hashlib.sha256(b"").hexdigest() and d[0].n_tokens == 0
    assert byte_bpe.digest_table(docs.limit(0), path, P.PATTERN).count() == 0


def test_packing(spark):
    lib = library("word_bpe_49k.json")
    texts = [*ODD, "word " * 9000, "", "", *["some text " * (7 * i + 1) for i in range(80)]]
    docs = spark.createDataFrame([*rows(texts), (4, texts[4], 1, 2, "x"), (None, "null id", 1, 2, "x")], DOCS)
    got = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t in [*enumerate(texts), (None, "null id")]:
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 2] * (2 if i == 4 else 1)
        ids = [x for r in sorted(by[i], key=lambda r: r.start) for x in np.frombuffer(r.ids, f"<u{r.width}").tolist()]
        assert ids == want
    total = 0
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
    assert len(seq) <= total / 4096 * 1.02 + 2
    assert packing.packed_digests(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0
    assert packing.packed_digests(docs, P.path("word_bpe_49k.json")).count() == len(got)


def test_patterns_use_up_demand():
    rng = np.random.default_rng(1)
    weight = packing.piece_classes(512, 8)
    for n in (0, 1, 5, 3000):
        demand = np.bincount(rng.integers(0, len(weight), n), minlength=len(weight))
        made, count = packing.patterns(demand, weight, 64)
        assert (count @ made == demand).all() and (made @ weight <= 64).all()


def test_reader_finds_boundaries_by_select(monkeypatch):
    """The reader takes each boundary through the select structure, not a full decode."""
    monkeypatch.setattr(token_files.EliasFano, "all", None)
    rng = np.random.default_rng(6)
    sizes = rng.integers(0, 40, 700)
    ids = rng.integers(0, 1 << 16, sizes.sum())
    segment = pa.RecordBatch.from_pylist([token_files._segment(1, 7, 2, list(range(700)), ids, sizes)], token_files._ARROW)
    got = next(token_files._decode({1: 100}, False)([segment])).to_pydict()
    starts = np.cumsum(sizes) - sizes
    assert got["start"] == (starts + 107).tolist() and got["n_tokens"] == sizes.tolist()
    assert got["ids"] == [ids[a : a + n].tolist() for a, n in zip(starts.tolist(), sizes.tolist())]


def test_token_files_start_no_process(tmp_path):
    """The JVM's memory counts twice while it starts one, so none is started for a file."""
    (tmp_path / "chmod").write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/started\nexec /bin/chmod "$@"\n')
    (tmp_path / "chmod").chmod(0o755)
    code = f"""
from pyspark.sql import SparkSession
import public_tokenizers as P
from rillstone.llm import token_files
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(i, f"text {{i}}") for i in range(20)], "doc_id long, text string")
token_files.write_token_files(docs, "{tmp_path}/files", P.path("byte_bpe_50k.json"), parts=3)
print("rows", token_files.read_token_files(spark, "{tmp_path}/files", True).count())
"""
    env = os.environ | {"PATH": f"{tmp_path}:{os.environ['PATH']}", "PYTHONPATH": os.pathsep.join(sys.path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "rows 20" in done.stdout, done.stderr[-2000:]
    started = (tmp_path / "started").read_text() if (tmp_path / "started").exists() else ""
    assert f"{tmp_path}/files" not in started
    made = sorted((tmp_path / "files").glob("part-*"))
    assert made and all(x.stat().st_mode & 0o777 == 0o644 and (x.parent / f".{x.name}.crc").exists() for x in made)


def test_local_files_set_permissions(spark, tmp_path):
    options = local_files(spark)
    conf = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    for k, v in options.items():
        conf.set(k, v)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/a b")
    fs = path.getFileSystem(conf)
    assert fs.getClass().getName() == "rillstone.LocalFiles"
    fs.create(path).close()
    for mode in ("640", "755", "1777"):
        fs.setPermission(path, spark._jvm.org.apache.hadoop.fs.permission.FsPermission(mode))
        assert (tmp_path / "a b").stat().st_mode & 0o7777 == int(mode, 8)
