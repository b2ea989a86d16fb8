"""Token counts by a two-tier lookup on the map side.

No token of the vocabulary holds white space, so a text's count is the sum over its runs between
white space (the pre-tokens). Tier one is a broadcast table of the corpus's frequent pre-tokens
with their lengths, at most ``table_size`` entries. Tier two is a cache in each worker, filled by
the tokenizer's own model and emptied when it is full. No pre-token is shuffled: the table comes from
per-task summaries of at most ``per_task`` rows, over all documents.

The table only saves work. Every count is the library's own, whatever the table holds.

Null text counts as empty (0 tokens); rows with equal ``doc_id`` each give a row; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from palisade.llm.batches import byte_texts, slices
from palisade.llm.caches import held
from palisade.llm.vocabulary import Words, default_path, shared

TABLE_SIZE = 32_768
PER_TASK = 4_096
CACHE_SIZE = 250_000
LONGEST_KEPT = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


class Lengths(dict):
    """Token counts of runs, kept by each worker over the broadcast table."""

    def __init__(self, text: str, limit: int = CACHE_SIZE):
        super().__init__()
        model = json.loads(text)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = Words(text)
        self.model = BPE(model["vocab"], merges, end_of_word_suffix=model.get("end_of_word_suffix"))
        self.table: dict[bytes, int] = {}
        self.known: dict[str, int] = {}
        self.limit = limit

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = len(self.model.tokenize(word))
            if len(self.known) >= self.limit:
                self.known.clear()
            if len(word) <= LONGEST_KEPT:
                self.known[word] = n
        return n

    def __missing__(self, run: bytes) -> int:
        n = self.table.get(run)
        if n is None:
            n = 0
            for part in self.words.parts(run.decode("utf-8")):
                n += 1 if part in self.words.special else sum(map(self.word, self.words.of(part)))
        if len(self) >= self.limit:
            self.clear()
        if len(run) <= LONGEST_KEPT:  # long odd runs would only fill the memory
            self[run] = n
        return n


def lengths(text: str) -> Lengths:
    return held("token_counts", text, lambda: Lengths(text))


def frequent_pretokens(docs: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(piece binary, n long): frequent pre-tokens of all documents.

    Each task keeps a counter that is cut to its larger half when full, and gives its most
    frequent entries; only these summaries meet.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in byte_texts(batch.column(0)):
                counts.update(text.split())
            if len(counts) > CACHE_SIZE:
                counts = Counter(dict(counts.most_common(CACHE_SIZE // 2)))
        top = [(p, n) for p, n in counts.most_common(per_task) if len(p) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())],
            ["piece", "n"],
        )

    found = docs.select("text").mapInArrow(summary, "piece binary, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


def token_counts(
    docs: DataFrame, path: str | None = None, table_size: int = TABLE_SIZE,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    vocabulary = shared(spark, path or default_path())
    top = frequent_pretokens(docs).orderBy(F.desc("n"), "piece").limit(table_size)
    known = lengths(vocabulary.value)
    table = spark.sparkContext.broadcast({bytes(r.piece): known[bytes(r.piece)] for r in top.collect()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = lengths(vocabulary.value)
        cache.table = table.value
        for batch in slices(batches):
            texts = byte_texts(batch.column(1))
            n_tokens = [sum(map(cache.__getitem__, t.split())) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, SCHEMA)
