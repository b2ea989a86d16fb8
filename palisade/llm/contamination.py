"""Benchmark decontamination: short test items inside long documents.

Search: the shingle set of a document of up to 2^p shingles is reduced to its one-permutation
MinHash signature of ``SPREAD`` * 2^p bins (documents are partitioned by this size class, and an
item has one signature for each class). A document is a candidate for an item when any bin agrees.
A shingle of a document of n shingles stays in its signature with a chance of at least
exp(-n / bins) >= exp(-1 / SPREAD) = 0.88, however long the document is; an item of eleven shingles
of which three quarters occur is missed with a chance below 10^-7. Items of ``FEW`` shingles or
fewer need no luck: all their shingles are looked up in the whole set of the document. Verification:
the exact share of the item's shingles that the document has.

Items are read in blocks of at most ``block_shingles`` shingles (or one item); each block is
broadcast, so its size is bounded, and held against all documents in one scan. Texts are never
shuffled.

Null or empty texts match nothing. Items or documents with fewer than five words have one shingle,
the whole sequence, so a short item matches only a text that is nothing else. Items with equal
texts are all reported. Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.batches import byte_texts, slices
from palisade.llm.store import private, saved, text_key
from palisade.llm.words import shingle_sets

PERCENT = 75
SPREAD_BITS = 3
#: Items with so few shingles are found by each of them.
FEW = 12
BLOCK_SHINGLES = 1_000_000
SCHEMA = "doc_id long, row long, item_id long, n_item_shingles long, n_shared long"


def size_class(n: int) -> int:
    return max(n - 1, 0).bit_length()


def signature(shingles: np.ndarray, klass: int) -> np.ndarray:
    """Least hash of each bin; the top bits of a hash are its bin, and the hashes are in order."""
    bits = min(klass + SPREAD_BITS, 63)
    bins = shingles >> np.uint64(64 - bits)
    return shingles[np.concatenate([[True], bins[1:] != bins[:-1]])] if len(shingles) else shingles


class Items:
    """Shingle sets of a block of items, and an index of their signatures for each size class."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        few = [i for i, s in enumerate(sets) if len(s) <= FEW]
        owners = np.repeat(np.array(few, dtype=np.int64), [len(sets[i]) for i in few])
        values = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in few)])
        order = np.argsort(values, kind="stable")
        self.short = values[order], owners[order]

    def signatures(self, klass: int) -> tuple[np.ndarray, np.ndarray]:
        if klass not in self.index:
            parts = [signature(s, klass) for s in self.sets]
            values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            owners = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.argsort(values, kind="stable")
            self.index[klass] = values[order], owners[order]
        return self.index[klass]

    def candidates(self, shingles: np.ndarray) -> np.ndarray:
        klass = size_class(len(shingles))
        values, owners = self.signatures(klass)
        own = signature(shingles, klass)
        first = np.searchsorted(values, own, side="left")
        last = np.searchsorted(values, own, side="right")
        found = [owners[first[i] : last[i]] for i in np.flatnonzero(last > first)]
        values, owners = self.short
        if len(values):
            at = np.minimum(np.searchsorted(shingles, values), len(shingles) - 1)
            found.append(owners[shingles[at] == values])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def found(self, shingles: np.ndarray) -> list[tuple[int | None, int, int]]:
        """(item id, its shingles, how many of them occur) of items that occur in full measure."""
        out = []
        for i in self.candidates(shingles):
            item = self.sets[i]
            at = np.minimum(np.searchsorted(shingles, item), len(shingles) - 1)
            common = int((shingles[at] == item).sum())
            if 100 * common >= PERCENT * len(item):
                out.append((self.ids[i], len(item), common))
        return out


def item_sets(items: DataFrame) -> DataFrame:
    """(item_id, n, shingles) of the items with any word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(byte_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["item_id", "n", "shingles"],
            )

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return saved(rows.mapInArrow(cut, "item_id long, n long, shingles binary").where("n > 0"))


def in_blocks(sets: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The items with a block number, no block of more than one item above ``limit`` shingles."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-2 * total // limit)) if total > limit else 1
    while True:
        block = F.pmod(F.xxhash64("item_id", "shingles"), F.lit(n_blocks)).cast("int")
        dealt = sets.withColumn("block", block)
        over = dealt.groupBy("block").agg(F.sum("n").alias("n"), F.countDistinct("shingles").alias("k"))
        if not over.where((F.col("n") > limit) & (F.col("k") > 1)).take(1):
            return dealt, n_blocks
        n_blocks *= 2


def contaminated(docs: DataFrame, items: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): every occurrence of an item in a document."""
    return contaminated_rows(docs, items, block_shingles).drop("row")


def contaminated_rows(docs: DataFrame, items: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``contaminated`` with ``row``, the ``text_key`` of the document."""
    spark = docs.sparkSession
    dealt, n_blocks = in_blocks(item_sets(items), block_shingles)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("row"), "text")

    def scan(block: int) -> DataFrame:
        own = dealt.where(F.col("block") == block).select("item_id", "shingles").collect()
        shared = spark.sparkContext.broadcast(
            Items([r.item_id for r in own], [np.frombuffer(bytes(r.shingles), np.uint64) for r in own])
        )

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block_items = shared.value
            for batch in slices(batches):
                out = []
                sets = shingle_sets(byte_texts(batch.column(2)))
                for doc, row, shingles in zip(*(c.to_pylist() for c in batch.columns[:2]), sets):
                    if len(shingles):
                        out += [(doc, row, *f) for f in block_items.found(shingles)]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["doc_id", "row", "item_id", "n_item_shingles", "n_shared"],
                )

        return rows.mapInArrow(search, SCHEMA)

    return reduce(DataFrame.unionByName, [scan(b) for b in range(n_blocks)])


def without_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents in which no item was ``found`` (by ``contaminated_rows``); id and text tell rows apart."""
    hit, hit_row = private("hit", "row")
    hits = found.select(F.col("doc_id").alias(hit), F.col("row").alias(hit_row)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(hit)) & text_key().eqNullSafe(F.col(hit_row))
    return docs.join(hits, same, "left_anti")
