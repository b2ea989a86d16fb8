"""Hard negatives by anchor-clustered shared lists: exact, with certified termination.

Anchors (the query set) come in blocks of bounded size. A block is clustered by direction, and sent
to the tasks. A task takes its rows in chunks. For each cluster it bounds, for every row, the
product that any member could reach: with c the cluster's centre and r the largest angle between c
and a member, a row at angle t from c has a product of at most |row| |member| cos(max(0, t - r)).
The rows are sorted by this bound once, and all members share the list. Each member walks it from
the top and stops where the bound can no longer reach the least score that would still enter its
answer; the rows behind are certified, not looked at.

One walk finds each anchor's best rows of its own label (positives). The next walk fills, for each
pair of anchor and positive, a list of rows of other labels whose score lies in a window under the
positive's score. Lists of tasks are merged by Spark, at most k rows a task and list.

Components x become floor(scale * x), x as double, and a score is their integer inner product, held
exactly: in doubles where they are exact, else in 64-bit or longer integers (a score outside 64
bits counts as the nearest one inside). Higher scores come first, ties by smaller id. Vectors of
unlike length meet as if the shorter one went on with zeros.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Repeated
rows count as often as they stand, but never with an anchor of their own id; equal anchors count
once. Other columns are left out; empty tables, or tables without anchors, give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.store import saved

#: Bytes of the anchors of one block, as doubles: what is collected and broadcast at once.
BLOCK_BYTES = 16 << 20
CHUNK_ROWS = 1 << 15
FIRST_STEP, LAST_STEP = 256, 4096
EXACT = float(1 << 53)
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Allowance for rounding in the bounds; scores are whole numbers.
SLACK = 1e-6
PAIR_DDL = "list long, anchor_id long, positive_id long, positive_score long, score long, row_id long"


@dataclass
class Anchors:
    """A block: ids, labels and whole-numbered vectors, and its clusters by direction."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def __post_init__(self):
        self.norms = np.linalg.norm(self.vectors, axis=1)
        units = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        n = len(self.ids)
        count = max(1, round(n**0.5))
        centres = units[np.linspace(0, n - 1, count).astype(np.int64)]
        for _ in range(5):  # spherical k-means, from anchors spread over the block
            nearest = np.argmax(units @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, units)
            sizes = np.linalg.norm(sums, axis=1)
            centres = np.where((sizes > 0)[:, None], sums / np.maximum(sizes, 1e-300)[:, None], centres)
        nearest = np.argmax(units @ centres.T, axis=1)
        self.members = [m for c in range(count) if len(m := np.flatnonzero(nearest == c))]
        self.centres = centres[[nearest[m[0]] for m in self.members]]
        cosines = [
            min(float((units[m] @ c).min()), 1.0) if self.norms[m].all() else -1.0
            for m, c in zip(self.members, self.centres)
        ]
        self.cosines = np.maximum(np.array(cosines) - SLACK, -1.0)


class Lists:
    """For each list the ``k`` best (score, id) seen, by score and then by smaller id.

    ``owner``: the anchor of each list; only scores from ``low`` to ``high`` enter.
    """

    def __init__(self, owner: np.ndarray, n_anchors: int, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores = np.full((len(owner), k), LEAST, dtype=np.int64)
        self.ids = np.full((len(owner), k), MOST, dtype=np.int64)
        self.size = np.zeros(len(owner), dtype=np.int64)
        of = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=n_anchors)
        starts = np.cumsum(counts) - counts
        #: Lists of each anchor, one column for each of them; -1 where there are fewer.
        self.of = np.full((n_anchors, max(counts.max(initial=0), 1)), -1, dtype=np.int64)
        for j in range(self.of.shape[1]):
            has = counts > j
            self.of[has, j] = of[starts[has] + j]

    def least(self, lists: np.ndarray) -> np.ndarray:
        """Least score that would still enter each list."""
        full = self.size[lists] == self.k
        return np.maximum(self.low[lists], np.where(full, self.scores[lists, -1], LEAST))

    def reach(self, anchors: np.ndarray) -> np.ndarray:
        """Least score that would enter any list of each anchor; infinite for one without lists."""
        of = self.of[anchors]
        return np.where(of >= 0, self.least(np.maximum(of, 0)).astype(np.float64), np.inf).min(axis=1)

    def add(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Offer each anchor's row of ``scores``, where ``fits``, to all its lists."""
        for j in range(self.of.shape[1]):
            lists = self.of[anchors, j]
            here = np.flatnonzero(lists >= 0)
            if not len(here):
                continue
            lists = lists[here]
            wanted = fits[here] & (scores[here] >= self.least(lists)[:, None]) & (scores[here] <= self.high[lists][:, None])
            at, row = np.nonzero(wanted)
            if len(at):
                self._merge(lists[at], scores[here[at], row], ids[row])

    def _merge(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(lists)
        held, nth = np.nonzero(np.arange(self.k) < self.size[touched][:, None])
        lists = np.concatenate([lists, touched[held]])
        scores = np.concatenate([scores, self.scores[touched[held], nth]])
        ids = np.concatenate([ids, self.ids[touched[held], nth]])
        order = np.lexsort((ids, ~scores, lists))  # ~ turns the order of integers round
        lists, scores, ids = lists[order], scores[order], ids[order]
        starts = np.searchsorted(lists, touched)
        rank = np.arange(len(lists)) - np.repeat(starts, np.diff(np.append(starts, len(lists))))
        kept = rank < self.k
        self.scores[lists[kept], rank[kept]] = scores[kept]
        self.ids[lists[kept], rank[kept]] = ids[kept]
        self.size[touched] = np.minimum(np.diff(np.append(starts, len(lists))), self.k)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows, as 64-bit integers."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(a.shape[1], 1)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < float(1 << 62):
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64)


def walk(block: Anchors, lists: Lists, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, same: bool) -> None:
    """Take one chunk of rows into the lists; ``same``: rows of the anchor's own label, else of others."""
    norms = np.linalg.norm(rows, axis=1)
    cosines = np.clip((rows / np.maximum(norms, 1e-300)[:, None]) @ block.centres.T, -1.0, 1.0)
    for c, members in enumerate(block.members):
        inner = block.cosines[c]
        t = cosines[:, c]
        apart = t * inner + np.sqrt(1 - t * t) * np.sqrt(1 - inner * inner)
        bound = norms * (np.where(t >= inner, 1.0, apart) + SLACK)
        order = np.argsort(-bound, kind="stable")
        at, step = 0, FIRST_STEP
        while at < len(order):
            within = block.norms[members] * bound[order[at]] + 0.5 >= lists.reach(members)
            members = members[within]
            if not len(members):
                break  # certified: no row behind can enter any list
            part = order[at : at + step]
            equal = labels[part] == block.labels[members][:, None]
            fits = (equal if same else ~equal) & (ids[part] != block.ids[members][:, None])
            lists.add(members, products(block.vectors[members], rows[part]), ids[part], fits)
            at, step = at + step, min(step * 2, LAST_STEP)


def whole_numbers(column: pa.Array, scale: float, width: int | None = None) -> np.ndarray:
    """floor(scale * x) of each vector, as one matrix of ``width`` columns (of the longest, if None)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = np.floor(scale * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for i, (start, size) in enumerate(zip(offsets.tolist(), np.minimum(sizes, width).tolist())):
        out[i, :size] = values[start : start + size]
    return out


def _lists_of_tasks(rows: DataFrame, block: Anchors, pairs: dict[str, np.ndarray], k: int, scale: float, same: bool) -> DataFrame:
    """The ``k`` best rows of each list, over all tasks."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((block, pairs))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pairs = sent.value
        lists = Lists(pairs["owner"], len(block.ids), pairs["low"], pairs["high"], k)
        for table in chunks(batches):
            vectors = whole_numbers(table.column(2), scale, block.vectors.shape[1])
            ids, labels = (table.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            walk(block, lists, ids, labels, vectors, same)
        at, nth = np.nonzero(np.arange(k) < lists.size[:, None])
        for start in range(0, len(at), 100_000):
            a, n = at[start : start + 100_000], nth[start : start + 100_000]
            owner = block.ids[pairs["owner"][a]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (a, owner, pairs["id"][a], pairs["score"][a], lists.scores[a, n], lists.ids[a, n])],
                ["list", "anchor_id", "positive_id", "positive_score", "score", "row_id"],
            )

    best = Window.partitionBy("list").orderBy(F.desc("score"), "row_id")
    found = rows.mapInArrow(search, PAIR_DDL)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``CHUNK_ROWS`` rows, so that sorting a list pays."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK_ROWS:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def valid_rows(table: DataFrame, label: Column, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    )


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all anchors.

    ``rows``: (vec_id, label, vector), see ``valid_rows``. A negative's score is at least
    ``window[0]`` and at most ``window[1]`` per cent of the positive's. Each block of anchors is
    two walks over all rows; its result is written before the next block begins.
    """
    anchors = rows.where(is_anchor).dropDuplicates(["vec_id", "label", "vector"])
    stored = saved(anchors)
    total, width = stored.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = -(-total * max(width or 0, 1) * 8 // BLOCK_BYTES)
    results = []
    for number in range(blocks):
        own = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)) == number
        table = stored.where(own).orderBy("vec_id", "label").toArrow().combine_chunks()
        if table.num_rows:
            results.append(saved(_mined(rows, table, positives, negatives, window, scale)))
    if not results:
        results.append(rows.sparkSession.createDataFrame([], RESULT_DDL))
    result = results[0]
    for more in results[1:]:
        result = result.unionByName(more)
    return result


RESULT_DDL = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mined(rows: DataFrame, table: pa.Table, positives: int, negatives: int, window, scale: float) -> DataFrame:
    block = Anchors(
        table.column(0).to_numpy(),
        table.column(1).to_numpy(),
        whole_numbers(table.column(2).chunk(0), scale),
    )
    n = len(block.ids)
    none = np.zeros(n, dtype=np.int64)
    every = {"owner": np.arange(n), "low": none + LEAST, "high": none + MOST, "id": none, "score": none}
    near = _lists_of_tasks(rows, block, every, positives, scale, same=True).orderBy("list", "rank").toArrow()
    score = near.column("score").to_numpy()
    low = np.array([-(-window[0] * s // 100) for s in score.tolist()], dtype=object)
    high = np.array([window[1] * s // 100 for s in score.tolist()], dtype=object)
    pairs = {
        "owner": near.column("list").to_numpy(),
        "low": np.clip(low, LEAST, MOST).astype(np.int64),
        "high": np.clip(high, LEAST, MOST).astype(np.int64),
        "id": near.column("row_id").to_numpy(),
        "score": score,
    }
    open_ = pairs["low"] <= pairs["high"]
    if not open_.any():
        return rows.sparkSession.createDataFrame([], RESULT_DDL)
    pairs = {name: values[open_] for name, values in pairs.items()}
    found = _lists_of_tasks(rows, block, pairs, negatives, scale, same=False)
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
