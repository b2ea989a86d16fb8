"""BPE encoding and decoding with forced boundaries.

A merge makes a token of the vocabulary, so two neighbouring bytes that stand side by side in no
token are never merged: between them is a certain cut. The merges on either side of a certain cut
do not depend on each other; the fragments are encoded alone and their ids joined.

White space is in no token at all, so texts are first cut there; a run between white space is then
normalised, divided into words by the tokenizer's own rules, and each word is cut wherever its byte
pair is in no token. Only the last fragment of a word carries the word-end mark. Runs and
fragments repeat, so each worker keeps the ids of those it has seen, in caches of bounded size.

Null text counts as empty (no ids, empty decoded text); equal rows give equal rows; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from palisade.llm.batches import byte_texts, slices
from palisade.llm.caches import held
from palisade.llm.vocabulary import Words, default_path, shared

CACHE_SIZE = 100_000
LONGEST_KEPT = 64
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class FragmentEncoder(dict):
    """Ids (little-endian unsigned 32-bit) of a run of bytes without ASCII white space."""

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        self.words = Words(text)
        self.ending = BPE(model["vocab"], merges, end_of_word_suffix=suffix or None)
        self.inner = BPE(model["vocab"], merges)
        self.pairs = {
            body[i : i + 2]
            for body in (token.removesuffix(suffix) for token in model["vocab"])
            for i in range(len(body) - 1)
        }
        self.fragments: dict[tuple[str, bool], bytes] = {}
        self.known_words: dict[str, bytes] = {}

    def fragments_of(self, word: str) -> list[str]:
        """``word`` in the tokenizer's byte alphabet, cut at every pair that is in no token."""
        pairs, at, out = self.pairs, 0, []
        for i in range(len(word) - 1):
            if word[i : i + 2] not in pairs:
                out.append(word[at : i + 1])
                at = i + 1
        out.append(word[at:])
        return out

    def fragment(self, piece: str, last: bool) -> bytes:
        known = self.fragments.get((piece, last))
        if known is None:
            model = self.ending if last else self.inner
            known = packed([t.id for t in model.tokenize(piece)])
            keep(self.fragments, (piece, last), known, len(piece))
        return known

    def word(self, word: str) -> bytes:
        ids = self.known_words.get(word)
        if ids is None:
            *inner, last = self.fragments_of(word)
            ids = b"".join([*(self.fragment(p, False) for p in inner), self.fragment(last, True)])
            keep(self.known_words, word, ids, len(word))
        return ids

    def __missing__(self, run: bytes) -> bytes:
        out = []
        for part in self.words.parts(run.decode("utf-8")):
            if part in self.words.special:
                out.append(packed([self.words.special[part]]))
            else:
                out += map(self.word, self.words.of(part))
        ids = b"".join(out)
        keep(self, run, ids, len(run))
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def keep(cache: dict, key, value, size: int) -> None:
    """Remember short keys only, and start again when the cache is full."""
    if size <= LONGEST_KEPT:
        if len(cache) >= CACHE_SIZE:
            cache.clear()
        cache[key] = value


def encoder(text: str) -> FragmentEncoder:
    return held("bpe", text, lambda: FragmentEncoder(text))


def token_strings(text: str) -> list[str | None]:
    """Token strings by id, added tokens too; None where an id is free."""
    spec = json.loads(text)
    if spec.get("decoder") is not None:
        raise ValueError("only vocabularies without a decoder of their own are known here")
    table = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [table.get(i) for i in range(max(table) + 1)]


def encoding(vocabulary: Broadcast) -> Batches:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = encoder(vocabulary.value)
        for batch in slices(batches, 1 << 20):
            ids = [runs.encode(t) for t in byte_texts(batch.column(1))]
            sizes = np.array([len(i) // 4 for i in ids], dtype=np.int64)
            flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "ids"],
            )

    return encode


def decoding(vocabulary: Broadcast) -> Batches:
    """The last column, ``ids``, becomes ``text``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held("bpe", "names" + vocabulary.value, lambda: token_strings(vocabulary.value))
        size = len(names)
        for batch in slices(batches, 1 << 20):
            *others, last = batch.columns
            texts = []
            for ids in last:
                known = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                known = known[(known >= 0) & (known < size)].tolist()
                texts.append(" ".join(filter(None, map(names.__getitem__, known))))
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return decode


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256) of every row of ``docs`` (doc_id, text)."""
    vocabulary = shared(docs.sparkSession, path or default_path())
    found = numbered(docs).mapInArrow(encoding(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, ids array<int>")
    return found.select("doc_id", "n_tokens", "ids", "ids_sha256")


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``text`` decoded from ``ids`` instead of them.

    Without a decoder in its file the tokenizer joins token strings with spaces, word-end marks
    and special tokens kept; ids that are in no vocabulary are passed over.
    """
    vocabulary = shared(encoded.sparkSession, path or default_path())
    frame = encoded.select(*(c for c in encoded.columns if c != "ids"), "ids")
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != "ids")
    return frame.mapInArrow(decoding(vocabulary), f"{schema}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``decode_documents`` of ``encode_documents`` in one pass: (doc_id, n_tokens, ids_sha256, text).

    Two passes in one stage take two workers for each task; workers live on and take turns, so all
    of them come to hold both tables, and what later stages need beside.
    """
    vocabulary = shared(docs.sparkSession, path or default_path())
    encode, decode = encoding(vocabulary), decoding(vocabulary)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decode(encode(batches))

    return numbered(docs).mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, text string")
