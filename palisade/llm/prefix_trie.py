"""The trie of shared conversation prefixes, from sorted sequences and range minima.

Each turn becomes 16 bytes (the digest of role and text); a conversation is the string of its
turns. Strings are sorted over the whole table by range partitions, with the id as second key, so
that a prefix shared by a third of all conversations is spread over many tasks. A task takes its
sorted rows in segments of bounded size. In a segment:

* the LCP (in turns) of neighbouring strings is put in a sparse table of range minima;
* the candidate prefixes of a row are those longer than its LCP with the row before: each prefix is
  a candidate once. Each of them searches the sparse table for the furthest row on its right that
  still shares it; its parent searches to the left in the same way. The interval is its members:
  counts, ids and sums over subtrees are differences of prefix sums. Nothing is kept on a stack.

Only prefixes of a segment's first or last row can reach into another segment. These are given out
as partial rows, added up by digest of the prefix, and the subtrees among them are summed in one
task: their number is at most twice the number of segments times the depth at which neighbouring
segments meet, not that of rows. All other nodes are complete in their segment.

The ids that end at a node are digested as one string in ascending order; where they are spread
over segments, pieces of joined ids are streamed in order, so no list of ids is ever held.

Rules: rows without an id take no part. Turns are in order of (turn, role, digest of text), null
turns first; null role or text counts as empty. A repeated row is a turn like any other. Other
columns are left out; without conversations there is no node, not even the root. One conversation
is one value: 24 bytes a turn, so some 80 million turns fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.store import saved

TURN_BYTES = 16
SEGMENT_ROWS = 100_000
SEGMENT_BYTES = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"
COMPLETE, PARTIAL, ENDS = 0, 1, 2
NO_ENDS = hashlib.sha256(b"").hexdigest()
SCHEMA = (
    "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, words long, ends string"
)
ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
        ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
        ("words", pa.int64()), ("ends", pa.string()),
    ]
)
NODE_COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns as ``array<struct<digest,words>>``, in order.

    Texts stay where they are; a turn is 16 bytes of digest and its number of words.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8")))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    grouped = (
        conversations.where(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
    )
    return grouped.select(
        "conv_id",
        F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"),
    )


def with_shared_openings(sequences: DataFrame, hub_of: Column, opening: Column, longest: int) -> DataFrame:
    """Each sequence with its first ``opening`` turns replaced by those of sequence ``hub_of``.

    ``opening`` is at most ``longest``; an absent hub, or one with fewer turns, gives what it has.
    """
    hubs = sequences.select(
        F.col("conv_id").alias("hub_id"), F.slice("turns", 1, max(longest, 1)).alias("hub_turns")
    )
    asked = sequences.select("conv_id", "turns", hub_of.cast("long").alias("hub"), opening.cast("int").alias("h"))
    joined = asked.join(hubs, F.col("hub") == F.col("hub_id"), "left")
    none = F.array().cast(dict(sequences.dtypes)["turns"])
    start = F.when(F.col("h") > 0, F.slice(F.coalesce("hub_turns", none), F.lit(1), F.greatest("h", F.lit(1))))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select(
        "conv_id",
        F.concat(
            F.coalesce(start, none), F.when(F.size("turns") > F.col("h"), rest).otherwise(none)
        ).alias("turns"),
    )


class RangeMinimum:
    """Sparse table: minima over every run of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[: len(last) - step], last[step:]))

    def minimum(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least value of each run from ``a`` to ``b``, both included."""
        out = np.empty(len(a), dtype=self.levels[0].dtype)
        level = np.log2(b - a + 1).astype(np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << int(k)) + 1])
        return out

    def furthest_right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place p from ``start`` on so that all values after ``start`` up to p are ``least`` or more."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            if len(level):
                there = np.minimum(at + 1, len(level) - 1)
                at = np.where((at + 1 < len(level)) & (level[there] >= least), at + (1 << k), at)
        return at

    def furthest_left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place p up to ``start`` so that all values after p up to ``start`` are ``least`` or more."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, first = self.levels[k], at - (1 << k) + 1
            if len(level):
                there = np.clip(first, 0, len(level) - 1)
                at = np.where((first >= 0) & (level[there] >= least), at - (1 << k), at)
        return at


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of leading turns that two strings share, by bisection."""
    low, high = 0, min(len(a), len(b)) // TURN_BYTES
    if a[: high * TURN_BYTES] == b[: high * TURN_BYTES]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * TURN_BYTES : middle * TURN_BYTES] == b[low * TURN_BYTES : middle * TURN_BYTES]:
            low = middle
        else:
            high = middle
    return low


def prefix_keys(path: bytes) -> list[bytes]:
    """Digest of every prefix of a string, the empty one first, in one walk."""
    state = hashlib.blake2b(digest_size=16)
    keys = [state.digest()]
    for at in range(0, len(path), TURN_BYTES):
        state.update(path[at : at + TURN_BYTES])
        keys.append(state.digest())
    return keys


def segment_nodes(paths: list[bytes], ids: list[list[int]], words: list[np.ndarray]) -> pa.RecordBatch:
    """Nodes of one segment: ascending distinct ``paths``, with their ascending ``ids`` and word numbers."""
    n = len(paths)
    sizes = np.array([len(p) // TURN_BYTES for p in paths], dtype=np.int64)
    lcp = np.array([0, *(shared_turns(a, b) for a, b in zip(paths, paths[1:]))], dtype=np.int64)
    table = RangeMinimum(lcp)
    least_id = RangeMinimum(np.array([i[0] for i in ids], dtype=np.int64))
    before = np.concatenate([[0], np.cumsum([len(i) for i in ids])])

    opened = sizes - lcp
    base = np.concatenate([[0], np.cumsum(opened)])
    row = np.repeat(np.arange(n), opened)
    depth = np.arange(base[-1]) - base[row] + lcp[row] + 1
    last = table.furthest_right(row, depth)
    left = table.furthest_left(row, np.maximum(depth - 1, 1))
    parent = np.where(depth > 1, base[left] + depth - 2 - lcp[left], -1)
    n_convs = before[last + 1] - before[row]
    conv = least_id.minimum(row, last)
    of_turn = np.concatenate([w[a:] for w, a in zip(words, lcp)] or [np.zeros(0, np.int64)]).astype(np.int64)

    edge = (row == 0) | (last == n - 1)
    children = np.bincount(parent[~edge & (parent >= 0)], minlength=len(row))
    leaf = np.zeros(len(row), dtype=np.int64)
    ends_here = depth == sizes[row]
    leaf[ends_here & (last == row) & ~edge] = 1
    sums = np.concatenate([[0], np.cumsum(np.where(edge, 0, (n_convs - 1) * of_turn))])
    leaves = np.concatenate([[0], np.cumsum(leaf)])
    here, behind = np.arange(len(row)), base[last + 1]

    edge_parent = np.where(parent >= 0, edge[parent], True)
    outer = prefix_keys(paths[0]), prefix_keys(paths[-1])

    def keys(wanted: np.ndarray, at: np.ndarray, start: np.ndarray) -> list[bytes | None]:
        """Keys of the prefixes of length ``at`` of the first row or, where they start later, the last."""
        out: list[bytes | None] = [None] * len(row)
        for i in np.flatnonzero(wanted).tolist():
            out[i] = outer[int(start[i] > 0)][at[i]]
        return out

    key = keys(edge, depth, row)
    parents = keys(edge | edge_parent, depth - 1, np.where(depth > 1, left, 0))
    ends = [
        ",".join(map(str, ids[r])) if end else None for r, end in zip(row.tolist(), ends_here.tolist())
    ]
    digests = [
        None if e else hashlib.sha256((t or "").encode()).hexdigest() for e, t in zip(edge.tolist(), ends)
    ]
    given = [i for i in range(len(row)) if edge[i] and ends[i] is not None]
    zeros = np.zeros(len(row), dtype=np.int64)
    nodes = pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(edge, PARTIAL, COMPLETE).astype(np.int32)),
            pa.array(key, pa.binary()),
            pa.array(parents, pa.binary()),
            pa.array(conv),
            pa.array(depth),
            pa.array(np.where(edge_parent, zeros, conv[parent]) if len(row) else zeros, mask=edge | edge_parent),
            pa.array(n_convs),
            pa.array(children),
            pa.array(leaves[behind] - leaves[here]),
            pa.array(sums[behind] - sums[here]),
            pa.array(of_turn),
            pa.array(digests, pa.string()),
        ],
        schema=ARROW,
    )
    top = {
        "kind": PARTIAL, "key": outer[0][0], "conv_id": int(least_id.levels[0].min()), "depth": 0,
        "n_convs": int(before[-1]), "n_children": int(np.count_nonzero(~edge & (depth == 1))),
        "n_leaves": int(leaves[-1]), "saved_tokens": int(sums[-1]), "words": 0,
    }
    pieces = [
        {"kind": ENDS, "key": key[i], "conv_id": ids[row[i]][0], "ends": ends[i]} for i in given
    ]
    if not paths[0]:
        pieces.append({"kind": ENDS, "key": outer[0][0], "conv_id": ids[0][0], "ends": ",".join(map(str, ids[0]))})
    return pa.concat_batches([nodes, pa.RecordBatch.from_pylist([top, *pieces], schema=ARROW)])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths: list[bytes] = []
    ids: list[list[int]] = []
    words: list[np.ndarray] = []
    rows = size = 0
    for batch in batches:
        numbers = batch.column(2)
        values, offsets = numbers.values.to_numpy(zero_copy_only=False), numbers.offsets.to_numpy()
        for k, (conv, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if paths and paths[-1] == path:
                ids[-1].append(conv)
            else:
                paths.append(path)
                ids.append([conv])
                words.append(values[offsets[k] : offsets[k + 1]].copy())
                size += 3 * len(path)
            rows += 1
            if rows >= SEGMENT_ROWS or size >= SEGMENT_BYTES:
                yield segment_nodes(paths, ids, words)
                paths, ids, words, rows, size = [], [], [], 0, 0
    if paths:
        yield segment_nodes(paths, ids, words)


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of all pieces of a key, which come in order; only the digest's state is kept."""
    current, digest, out = None, hashlib.sha256(), []

    def done() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())],
            ["key", "ends_sha256"],
        )
        out.clear()
        return batch

    for batch in batches:
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key == current:
                digest.update(b",")
            else:
                if current is not None:
                    out.append((current, digest.hexdigest()))
                current, digest = key, hashlib.sha256()
            digest.update(piece.encode())
        yield done()
    if current is not None:
        out.append((current, digest.hexdigest()))
    yield done()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that reach over segments, deepest first: each is added to its parent once it is whole."""
    rows: dict[bytes, dict] = {}
    for batch in batches:
        for node in batch.to_pylist():
            rows[node["key"]] = node
            # of the nodes here, over the subtree; what is complete in segments has been counted there
            node["leaves"], node["saved"] = 0, (node["n_convs"] - 1) * node["words"]
    for node in sorted(rows.values(), key=lambda x: -x["depth"]):
        if not node["n_children"]:
            node["leaves"] = 1
        if node["depth"]:
            above = rows[node["parent_key"]]
            node["parent_conv_id"] = above["conv_id"]
            above["n_children"] += 1
            above["leaves"] += node["leaves"]
            above["saved"] += node["saved"]
        node["n_leaves"] += node["leaves"]
        node["saved_tokens"] += node["saved"]
    whole = list(rows.values())
    for at in range(0, len(whole), 10_000):
        part = [{n: node[n] for n in WHOLE.names} for node in whole[at : at + 10_000]]
        yield pa.RecordBatch.from_pylist(part, schema=WHOLE)


WHOLE = pa.schema([ARROW.field(n) for n in ARROW.names if n not in ("kind", "words", "ends")])
WHOLE_DDL = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long"
)


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, turns array<struct<digest,words>>).

    ``conv_id``: smallest member; ``depth``; ``parent_conv_id``: the parent's smallest member (root:
    null); ``n_convs`` members; ``n_children``; ``n_leaves`` in the subtree; ``saved_tokens``: words
    that need not be stored or computed again, summed over the subtree; ``ends_sha256``.
    """
    strings = saved(
        sequences.select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("path"),
            F.transform("turns", lambda t: t["words"]).alias("words"),
        )
    )
    tasks = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = strings.repartitionByRange(tasks, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = saved(in_order.mapInArrow(_segments, SCHEMA))

    partial = (
        parts.where(F.col("kind") == PARTIAL)
        .groupBy("key")
        .agg(
            F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"), F.min("words").alias("words"),
        )
    )
    whole = saved(partial.coalesce(1).mapInArrow(_summed, WHOLE_DDL))
    ends = (
        parts.where(F.col("kind") == ENDS)
        .repartition(tasks, "key")
        .sortWithinPartitions("key", "conv_id")
        .select("key", "ends")
        .mapInArrow(_joined_ends, "key binary, ends_sha256 string")
    )
    reaching = whole.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    inside = parts.where(F.col("kind") == COMPLETE).withColumnRenamed("ends", "ends_sha256")
    under = (
        inside.where(F.col("parent_key").isNotNull())
        .drop("parent_conv_id")
        .join(whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key")
    )
    return (
        inside.where(F.col("parent_key").isNull()).select(*NODE_COLUMNS)
        .unionByName(under.select(*NODE_COLUMNS))
        .unionByName(reaching.select(*NODE_COLUMNS))
    )
