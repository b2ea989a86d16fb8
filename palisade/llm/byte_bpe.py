"""Byte-level BPE by corpus-level merge replay.

A rank file gives each token's bytes a rank, which is its id as well. The distinct pre-tokens of a
block of texts are laid out as one array of byte tokens with a gap after each. An inverted index
holds, for each pair of neighbouring tokens that some token spells, the places where the pair
stands. Ranks are then applied in order, each at all its places in all words at once; a merge looks
at its two neighbours only and enters their new pairs in the index. A place whose pair has changed
meanwhile is passed over.

Files of ranks may spell a token of a low rank from parts of higher rank. When a merge brings up
such a pair, the other places of that word wait until the lower rank has been applied, so every
word sees its merges in the order of the library: lowest rank first, leftmost first among equals.

Words that a worker has met keep their ids in a cache of bounded size, so a block replays its new
words only, a thousand at a time. No pre-token is shuffled. A word of any length takes time in proportion to its length
(times a logarithm); long texts are cut between two words where no match can reach across.

Null text counts as empty: no ids, empty bytes. Equal rows give equal rows, other columns are left
out, an empty table gives an empty result, and a null ``doc_id`` stays null.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.batches import slices
from palisade.llm.caches import held
from palisade.llm.vocabulary import MAX_FILE_BYTES

CACHE_SIZE = 300_000
LONGEST_KEPT = 64
BLOCK_BYTES = 4 << 20
#: Words of one replay: few enough that its lists stay in the processor's caches.
REPLAY_WORDS = 1000
SEGMENT_CHARS = 1 << 20
GAP, GONE = -1, -2
#: Between a letter and a blank before a letter every splitting pattern known here ends a match.
SAFE_CUT = regex.compile("(?<=[A-Za-z])(?= [A-Za-z])")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(data: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class ReplayEncoder:
    """Ids of pre-tokens; ``known`` holds them packed as little-endian unsigned 32-bit integers."""

    def __init__(self, data: bytes, pattern: str):
        ranks = read_ranks(data)
        self.find = regex.compile(pattern).findall
        self.width = max(ranks.values()) + 2
        self.names: list[bytes] = [b""] * (self.width - 1)
        for token, rank in ranks.items():
            self.names[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: Rank of the token that a pair of tokens spells.
        self.pairs = {
            ranks[token[:i]] * self.width + ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.byte_pairs = np.full((256, 256), self.width, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank
        self.decimals = [str(i).encode() for i in range(self.width - 1)]
        self.known: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word, ``REPLAY_WORDS`` words at a time."""
        parts = (words[at : at + REPLAY_WORDS] for at in range(0, len(words), REPLAY_WORDS))
        return [ids for part in parts for ids in self.replayed(part)]

    def replayed(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word: all merges of all words, rank by rank."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        gaps = np.cumsum(sizes + 1) - 1
        token = self.byte_ids[flat]
        token[gaps] = GAP
        word = np.repeat(np.arange(len(words)), sizes + 1)
        first = np.full(len(flat), self.width, dtype=np.int64)
        first[:-1] = self.byte_pairs[flat[:-1], flat[1:]]
        first[gaps] = self.width
        first[gaps[sizes > 0] - 1] = self.width
        tokens = self._merged(token.tolist(), word.tolist(), first)
        left = np.array(tokens, dtype=np.int64)
        alive = left >= 0
        packed = left[alive].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merged(self, token: list[int], word: list[int], first: np.ndarray) -> list[int]:
        width, rank_of = self.width, self.pairs.get
        #: Rank of the pair that starts at each place; the width where there is none.
        now = first.tolist()
        left, right = list(range(-1, len(token) - 1)), list(range(1, len(token) + 1))
        places = np.flatnonzero(first < width)
        places = places[np.argsort(first[places], kind="stable")]
        ranks, starts = np.unique(first[places], return_index=True)
        heap = ranks.tolist()
        index = {r: p.tolist() for r, p in zip(heap, np.split(places, starts[1:]))}
        while heap:
            rank = heappop(heap)
            at = index.pop(rank)
            at.sort()
            waiting, held = -1, []
            for here in at:
                if now[here] != rank:
                    continue
                if waiting >= 0 and word[here] == waiting:
                    held.append(here)
                    continue
                there = right[here]
                token[here], token[there] = rank, GONE
                now[there] = width
                after = right[here] = right[there]
                left[after] = here
                behind, before = token[after], left[here]
                new = rank_of(rank * width + behind, width) if behind >= 0 else width
                now[here] = new
                if new < width:
                    if new in index:
                        index[new].append(here)
                    else:
                        index[new] = [here]
                        heappush(heap, new)
                    if new < rank:
                        waiting = word[here]
                if before >= 0 and token[before] >= 0:
                    new = now[before] = rank_of(token[before] * width + rank, width)
                    if new < width:
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            heappush(heap, new)
                        if new < rank:
                            waiting = word[here]
            if held:
                if rank in index:
                    index[rank] += held
                else:
                    index[rank] = held
                    heappush(heap, rank)
        return token

    def block(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the new words of all of them are replayed together."""
        pieces = [self.find(t) for t in texts]
        known = self.known
        new = set().union(*pieces).difference(known)
        if len(known) + len(new) > CACHE_SIZE:
            known.clear()
            new = set().union(*pieces)
        words = list(new)
        known.update(zip(words, self.replay([w.encode("utf-8") for w in words])))
        ids = [b"".join(map(known.__getitem__, p)) for p in pieces]
        for w in words:
            if len(w) > LONGEST_KEPT:
                del known[w]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts if max(map(len, texts), default=0) > SEGMENT_CHARS else ():
            out.append(b"".join(self.block([part])[0] for part in segments(text)))
        return out or self.block(texts)

    def decimal(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.decimals.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.names.__getitem__, ids.tolist()))


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text in pieces that are encoded alone, each cut where no match reaches across."""
    at = 0
    while len(text) - at > limit and (cut := SAFE_CUT.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encoder(data: bytes, pattern: str) -> ReplayEncoder:
    return held("byte_bpe", (data, pattern), lambda: ReplayEncoder(data, pattern))


def shared_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank file, whose size does not grow with the data and is checked."""
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256) of every row of ``docs`` (doc_id, text).

    ``ids_sha256`` is the digest of the decimal ids joined by one blank. ``pattern`` divides texts
    into the pre-tokens that are encoded separately.
    """
    vocabulary = shared_ranks(docs.sparkSession, path or default_ranks())
    splitter = pattern or default_pattern()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary.value, splitter)
        for batch in slices(batches, BLOCK_BYTES):
            ids = [np.frombuffer(i, "<u4") for i in model.encode([t or "" for t in batch.column(1).to_pylist()])]
            sizes = np.array([len(i) for i in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                        pa.array(np.concatenate(ids).astype(np.int32)),
                    ),
                    pa.array([hashlib.sha256(model.decimal(i)).hexdigest() for i in ids]),
                ],
                ["doc_id", "n_tokens", "ids", "ids_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with the ``bytes`` that its ``ids`` spell instead of them.

    Null ids count as none. Ids outside the vocabulary, and null ones in a list, spell nothing.
    """
    vocabulary = shared_ranks(encoded.sparkSession, path or default_ranks())
    splitter = pattern or default_pattern()
    others = [c for c in encoded.columns if c != "ids"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary.value, splitter)
        for batch in slices(batches, BLOCK_BYTES):
            spelt = []
            for ids in batch.column(len(others)):
                found = ids.values.drop_null().to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                spelt.append(model.decode(found[(found >= 0) & (found < len(model.names))]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(others))), pa.array(spelt, pa.binary())],
                [*others, "bytes"],
            )

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != "ids")
    return encoded.select(*others, "ids").mapInArrow(decode, f"{schema}, bytes binary")
