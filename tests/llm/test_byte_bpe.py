"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from palisade.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


def library(path):
    with open(path, "rb") as file:
        ranks = byte_bpe.read_ranks(file.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def model(path):
    with open(path, "rb") as file:
        return byte_bpe.ReplayEncoder(file.read(), public_tokenizers.PATTERN)


def ids_of(packed):
    return [np.frombuffer(i, "<u4").tolist() for i in packed]


PARTS = [
    "a", "b", "aa", " ", "\n", "the", "'s", "'ll", "1", "éè", "日本", "😀", " ", "\x00", "-", "=====", "\t", "ing",
    "<|endoftext|>", "ᅠ", "İ", "ß", "   ", " ", "﻿", "é",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_equal_to_library(name):
    path = public_tokenizers.path(name)
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(60))) for _ in range(4000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x3000), r.randrange(0x10000, 0x11000)])) for _ in range(40)) for _ in range(4000)]
    texts += ["", "a" * 5000, "ab" * 3000, " " * 4000, "".join(r.choice("abcdeing") for _ in range(20_000))]
    ours, theirs = model(path), library(path)
    got = ids_of(ours.encode(texts))
    assert got == [theirs.encode_ordinary(t) for t in texts]
    assert [ours.decode(np.array(i, dtype=np.int64)) for i in got] == [t.encode() for t in texts]


def test_lower_ranks_that_come_up_late():
    """``bcd`` has a lower rank than its part ``cd``: in a word it is applied before other ``cd``."""
    tokens = [bytes([b]) for b in range(256)] + [b"bcd", b"cd", b"dcd", b"ab"]
    data = b"\n".join(byte_bpe.base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    ours = byte_bpe.ReplayEncoder(data, public_tokenizers.PATTERN)
    ranks = {t: i for i, t in enumerate(tokens)}
    theirs = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    words = ["bcdcdcd", "abcdcd", *("".join(r.choice("abcd") for _ in range(r.randrange(1, 14))) for _ in range(3000))]
    assert ids_of(ours.replay([w.encode() for w in words])) == [theirs.encode_ordinary(w) for w in words]


def test_small_cache_and_cut_texts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_SIZE", 50)
    monkeypatch.setattr(byte_bpe, "SEGMENT_CHARS", 200)
    path = byte_bpe.default_ranks()
    r = random.Random(3)
    texts = [" ".join("".join(r.choice(PARTS) for _ in range(4)) for _ in range(r.randrange(400))) for _ in range(40)]
    texts += ["one two  three 's x\n\n y " * 100, "x" * 1000, " " * 900]
    assert ids_of(model(path).encode(texts)) == [library(path).encode_ordinary(t) for t in texts]


def expected(text):
    ids = library(byte_bpe.default_ranks()).encode_ordinary(text or "")
    return (
        len(ids),
        hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def test_query_equals_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_byte_bpe(spark, SF).collect()}
    assert got == {i: expected(t) for i, t in docs.items()}


def test_nulls_empty_long_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "no id", 7), (3, "again", 8), (3, "again", 8), (4, "long text " * 150_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("bytes", F.lit(b"x"))
    found = byte_bpe.decode_documents(byte_bpe.encode_documents(docs))
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, hashlib.sha256(bytes(r.bytes)).hexdigest()) for r in found.collect())
    assert got == sorted((i or 0, *expected(t)) for i, t, _ in rows)
    empty = byte_bpe.decode_documents(byte_bpe.encode_documents(docs.where("false")))
    assert empty.collect() == []


def test_decoding_foreign_ids(spark):
    rows = spark.createDataFrame([(1, [72, None, -1, 10**6, 71]), (2, None)], "doc_id long, ids array<int>")
    names = model(byte_bpe.default_ranks()).names
    got = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode_documents(rows).collect()}
    assert got == {1: names[72] + names[71], 2: b""}


def test_many_words_are_replayed_in_parts(monkeypatch):
    with open(byte_bpe.default_ranks(), "rb") as file:
        model = byte_bpe.ReplayEncoder(file.read(), byte_bpe.default_pattern())
    words = [f"{i * 7919}word{i % 97}ing".encode() for i in range(2 * byte_bpe.REPLAY_WORDS + 1)]
    alone = [model.replayed([w])[0] for w in words]
    sizes, replayed = [], model.replayed
    monkeypatch.setattr(model, "replayed", lambda part: sizes.append(len(part)) or replayed(part))
    assert model.replay([]) == [] and model.replay(words) == alone
    assert sizes == [byte_bpe.REPLAY_WORDS, byte_bpe.REPLAY_WORDS, 1]
