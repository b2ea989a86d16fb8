"""N-gram Jaccard join: classes of documents linked by 5-word shingle sets, exactly.

Texts with the same set are one node (64-bit hash of the set); everything below is about nodes.

1. *Order.* A sketch of all shingles (``SKETCH`` hashed counters, summed over all documents) gives
   each a rarity level, the binary logarithm of its count against the mean; the common order is by
   (level, hash): rare first. The sketch only steers how much work there is.
2. *Prefixes.* Two sets with 100 * intersection >= 75 * union share a shingle among the first
   n - ceil(0.75 n) + 1 of each. Those are joined on the shingle; shingles of one node drop out.
3. *Filters.* Length: 4 min(n) >= 3 max(n). Positional: what is left behind the shared places must
   still allow ceil(3 (n_a + n_b) / 7) common shingles. Suffix: both sets are cut at the same
   shingles and the sizes of the parts bound the difference from below.
4. *Verification*, once per pair, on the whole sets.
5. *Classes.* First each node is held against two others of every shingle group: the one with the
   fewest rarer shingles before the shared one (of about its length) and its neighbour in that
   order. This joins large groups of near copies in linear work. Then all pairs of nodes that
   share a prefix shingle and are in different classes yet are held against each other. A pair
   inside one class needs no check, as its link would change nothing; no pair is dropped otherwise.

Texts are read whole and never shuffled; sets are fetched for nodes that have candidates only.
Intermediate tables are deleted once nothing reads them.
Null or empty text and text without words: no shingles, linked with nothing, its own class. Fewer
than five words: the whole sequence is the only shingle. Rows with equal ids count as rows; a null
id is null in the result where it is the only one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from palisade.llm import blocks
from palisade.llm.batches import byte_texts, slices
from palisade.llm.components import components
from palisade.llm.store import release, saved, text_key
from palisade.llm.words import shingle_sets

PERCENT = 75
SKETCH = 1 << 23
SUFFIX_PARTS = 16
#: How many shared shingles before its own a prefix row knows, to tell a pair's first one.
BEFORE = 3
Units = Callable[[list[bytes]], Iterable[np.ndarray]]
Rule = Callable[[str, str], Column]
PROFILE = "doc_id long, row long, n_shingles long, node long, part int, piece binary"


def node_of(shingles: np.ndarray) -> int:
    return xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SKETCH - 1)).astype(np.int64)


def count(counts: np.ndarray, at: np.ndarray) -> None:
    """Add one to ``counts`` for each time a place is in ``at``; a full counter stays full."""
    at = np.sort(at)
    ends = np.flatnonzero(np.concatenate([at[1:] != at[:-1], [True]])) if len(at) else at
    times = np.diff(ends, prepend=-1)
    room = np.iinfo(counts.dtype).max - counts[at[ends]]
    counts[at[ends]] += np.minimum(times, room).astype(counts.dtype)


def profiles(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, row, n_shingles, node); per task the pieces of its shingle counters."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.uint16)
        for batch in slices(batches):
            sets = shingle_sets(byte_texts(batch.column(2)))
            count(counts, slots(np.concatenate(sets)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                ["doc_id", "row", "n_shingles", "node", "part", "piece"],
            )
        found = blocks.pieces(counts, np.uint32)
        n = found.num_rows
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(n, pa.int64()) for _ in range(4)), found.column(0), found.column(1)],
            ["doc_id", "row", "n_shingles", "node", "part", "piece"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("row"), "text")
    return rows.mapInArrow(profile, PROFILE)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Level of each counter: 0 up to twice the mean, then one more with each doubling."""
    times = counts.astype(np.float32) / np.float32(max(1.0, float(counts.mean())))
    return np.log2(np.maximum(times, 1, out=times), out=times).astype(np.uint8)


def prefix_rows(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(shingle, node, n, place): prefixes in rare-first order, each node once in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        level = shared.value
        for batch in slices(batches):
            keys, nodes, sizes, places = [], [], [], []
            for s in shingle_sets(byte_texts(batch.column(0))):
                n = len(s)
                node = node_of(s) if n else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                take = n - (PERCENT * n + 99) // 100 + 1
                first = s[np.argsort(level[slots(s)], kind="stable")[:take]]  # hashes are sorted
                keys.append(first)
                nodes.append(node)
                sizes.append(n)
                places.append(np.arange(take, dtype=np.int32))
            if keys:
                times = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.repeat(np.array(nodes, dtype=np.int64), times)),
                        pa.array(np.repeat(np.array(sizes, dtype=np.int32), times)),
                        pa.array(np.concatenate(places)),
                    ],
                    ["shingle", "node", "n", "place"],
                )

    return docs.select("text").mapInArrow(prefix, "shingle long, node long, n int, place int")


def shared_prefixes(prefixes: DataFrame) -> DataFrame:
    """Prefix rows whose shingle more than one node has."""
    group = Window.partitionBy("shingle").orderBy("node")
    kept = prefixes.select("*", F.lag("node").over(group).alias("prev"), F.lead("node").over(group).alias("next"))
    # copies of a node from several tasks stand side by side: one of them stays
    kept = kept.where("(prev IS NOT NULL AND prev <> node) OR (prev IS NULL AND next IS NOT NULL)").drop("prev", "next")
    again = kept.select("*", F.lag("node").over(group).alias("prev"), F.lead("node").over(group).alias("next"))
    return again.where("prev IS NOT NULL OR next IS NOT NULL").drop("prev", "next")


def with_neighbours(shared: DataFrame) -> DataFrame:
    """``after``: how many shingles of ``shared`` a node's prefix has behind each; ``before``: the last few in front."""
    along = Window.partitionBy("node").orderBy("place")
    whole = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    last = F.collect_list("shingle").over(along.rowsBetween(-BEFORE, -1))
    return shared.select("*", (F.count("*").over(whole) - 1).cast("int").alias("after"), last.alias("before"))


def may_link(one: str, two: str) -> Column:
    """Length and positional filters for rows ``one`` and ``two`` that share a shingle.

    At the first shingle that a pair shares, no more can be common than what either set has from
    there on. A row that fails later in the order does not matter: the first one brought the pair.
    """
    n_a, n_b = F.col(f"{one}.n"), F.col(f"{two}.n")
    left = F.least(n_a - F.col(f"{one}.place"), n_b - F.col(f"{two}.place"))
    return same_length(one, two) & (7 * left >= 3 * (n_a + n_b))


def first_met(one: str, two: str) -> Column:
    """``may_link`` at the first shingle of a pair: one that both have just before shows a later one.

    The order is common to all sets, and the earlier row of both is there too, so it brings the pair.
    No more can be common than this shingle, the shared ones behind it in both prefixes, and what
    is behind the prefixes.
    """
    n_a, n_b = F.col(f"{one}.n"), F.col(f"{two}.n")
    rest = F.expr(f"({PERCENT} * greatest({one}.n, {two}.n) + 99) div 100")
    most = F.least(F.col(f"{one}.after"), F.col(f"{two}.after")) + rest
    met = ~F.arrays_overlap(f"{one}.before", f"{two}.before")
    return may_link(one, two) & (7 * most >= 3 * (n_a + n_b)) & met


def same_length(one: str, two: str) -> Column:
    n_a, n_b = F.col(f"{one}.n"), F.col(f"{two}.n")
    return 4 * F.least(n_a, n_b) >= 3 * F.greatest(n_a, n_b)


def ordered_pairs(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    ).distinct()


def nearest_pairs(shared: DataFrame, first_by: tuple[str, ...] = ("place", "n"), rule: Rule = may_link) -> DataFrame:
    """Each node of a shingle group with the first and the previous one of about its length."""
    about = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)))
    group = Window.partitionBy("shingle", "about").orderBy(*first_by, "node")
    row = F.struct(*(c for c in shared.columns if c != "shingle"))
    found = shared.withColumn("about", about).select(
        row.alias("x"), F.first(row).over(group).alias("best"), F.lag(row).over(group).alias("prev")
    )
    flat = found.select("x", F.explode(F.array("best", "prev")).alias("y"))
    return ordered_pairs(flat.where("y IS NOT NULL AND x.node <> y.node").where(rule("x", "y")))


def crossing_pairs(
    shared: DataFrame,
    classes: DataFrame,
    rule: Rule = first_met,
    widened: Callable[[DataFrame], DataFrame] = with_neighbours,
) -> DataFrame:
    """Pairs that share a prefix shingle, pass the filters, and are in different classes.

    Rows of groups that lie in one class go first; ``widened`` gives the others what ``rule`` reads.
    All shingles that a pair of different classes shares are left, so counts over them still bound.
    """
    labelled = shared.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spread = labelled.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    rows = saved(widened(labelled.join(spread.select("shingle"), "shingle")))
    # the shorter set (ties: the lesser node) comes first, so that a pair meets once
    met = rows.alias("x").join(rows.alias("y"), F.col("x.shingle") == F.col("y.shingle")).where(
        (F.col("x.root") != F.col("y.root"))
        & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node"))))
        & rule("x", "y")
    )
    pairs = saved(ordered_pairs(met))
    release(rows)
    return pairs


def prefix_keys(shared: DataFrame) -> DataFrame:
    """(node, n, keys): the shared shingles of each node's prefix."""
    return saved(shared.groupBy("node").agg(F.max("n").alias("n"), F.collect_list("shingle").alias("keys")))


def plausible(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Positional filter at the prefix ends, for the whole pair.

    Common shingles are either in both prefixes, where they are counted, or behind the prefix of
    the set whose prefix ends first; so there are at most as many as those and the longer rest.
    """
    one = keys.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    two = keys.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    rest = F.expr(f"({PERCENT} * greatest(na, nb) + 99) div 100 - 1")
    met = pairs.join(one, "a").join(two, "b")
    most = F.size(F.array_intersect("ka", "kb")) + rest
    return saved(met.where(7 * most >= 3 * (F.col("na") + F.col("nb"))).select("a", "b"))


def homes(rows: DataFrame) -> DataFrame:
    """(node, row): of each node the key of one text that holds it; ``rows`` has (node, row)."""
    return rows.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"))


def sets_of(docs: DataFrame, wanted: DataFrame, units: Units) -> DataFrame:
    """(node, shingles) of the nodes ``wanted`` (node, row); the filters let some others through.

    Texts are told by their keys, so only those that hold a wanted node are cut into words.
    """
    filters = [blocks.bit_filter(wanted.select(c).distinct()) for c in ("row", "node")]
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rows, wanted_nodes = shared.value
        for batch in batches:
            hit = pa.array(blocks.passing(rows, batch.column(0).to_numpy()))
            for part in slices([batch.filter(hit)]):
                nodes, sets = [], []
                for s in units(byte_texts(part.column(1))):
                    node = node_of(s) if len(s) else None
                    if node is None or node in seen or not blocks.passing(wanted_nodes, node):
                        continue
                    seen.add(node)
                    nodes.append(node)
                    sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"]
                )

    found = docs.select(text_key().alias("row"), "text").mapInArrow(fetch, "node long, shingles binary")
    return found.dropDuplicates(["node"])  # its one shuffle serves both sides of the pairs


def suffixes_allow(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether the parts of both sets, cut at the same shingles, leave room for ``least`` common."""
    cuts = b[len(b) // SUFFIX_PARTS :: max(1, len(b) // SUFFIX_PARTS)]
    parts_a = np.diff(np.searchsorted(a, cuts), prepend=0, append=len(a))
    parts_b = np.diff(np.searchsorted(b, cuts), prepend=0, append=len(b))
    return np.minimum(parts_a, parts_b).sum() >= least


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    least = -(-3 * (len(a) + len(b)) // 7)
    if min(len(a), len(b)) < least or not suffixes_allow(a, b, least):
        return False
    common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def verified(pairs: DataFrame, docs: DataFrame, home: DataFrame, units: Units = shingle_sets) -> DataFrame:
    """The pairs (u, v) that link; ``units`` gives the sets that texts hold, ``home`` a text of each (``homes``)."""
    named = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = saved(named.join(home, "node"))
    sets = sets_of(docs, wanted, units)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [
                linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    whole = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    found = saved(whole.mapInArrow(verify, "u long, v long"))
    release(wanted)
    return found


def node_classes(docs: DataFrame, levels: np.ndarray, home: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; ``home`` has a text of each node (``homes``)."""
    shared = saved(shared_prefixes(prefix_rows(docs, levels)))
    release()
    keys = prefix_keys(shared)
    near = saved(nearest_pairs(shared))
    hopeful = plausible(near, keys)
    release()
    links = verified(hopeful, docs, home)
    first = components(links)
    met = crossing_pairs(shared, first)
    crossing = plausible(met.join(near, ["a", "b"], "left_anti"), keys)
    release(shared, keys, near, hopeful, met)
    return components(links.union(verified(crossing, docs, home)))


def similarity_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    return labelled_rows(docs).select("doc_id", "n_shingles", "component_id")


def first_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row) of the first of each class: of its least id, null last, the least ``text_key``."""
    found = saved(labelled_rows(docs))
    own = found.where("root IS NOT NULL AND doc_id <=> component_id")
    first = own.groupBy("root", "doc_id").agg(F.min("row").alias("row")).select("doc_id", "row")
    return first.union(found.where("root IS NULL").select("doc_id", "row")).distinct()


def labelled_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, root, component_id) for every row of ``docs`` (doc_id, text)."""
    found = saved(profiles(docs))
    counts = blocks.merged(found.where("part IS NOT NULL").select("part", "piece"), SKETCH, "u4", "add")
    rows = saved(found.where("part IS NULL").select("doc_id", "row", "n_shingles", "node"))
    release(found)  # the counters of all tasks, and their shuffle
    classes = node_classes(docs, rarity(counts), homes(rows))
    labelled = saved(rows.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")))
    release(rows)
    least = labelled.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    columns = ["doc_id", "row", "n_shingles", "root", "component_id"]
    joined = labelled.where("root IS NOT NULL").join(least, "root").select(columns)
    alone = labelled.where("root IS NULL").withColumn("component_id", F.col("doc_id")).select(columns)
    return joined.unionByName(alone)
