"""The trie of shared prefixes against a plain dictionary of prefixes."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import prefix_trie, queries

DDL = "conv_id long, turn long, role string, text string, path string, key int"


def brute(convs):
    """convs: {id: ((role, text), ...)}"""
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, tokens, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        tokens[path] = own + sum(tokens[c] for c in children[path])
        ends = ",".join(str(c) for c in sorted(members[path]) if convs[c] == path)
        out.append(
            (
                min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]),
                len(children[path]), leaves[path], tokens[path], hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def ordered(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple(t[2:] for t in sorted(turns)) for c, turns in convs.items()}


def nodes(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def ours(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL).repartition(3)
    return nodes(prefix_trie.prefix_nodes(prefix_trie.turn_sequences(table)))


def random_rows(seed, n, kinds, longest):
    r = random.Random(seed)
    return [
        (c, t, r.choice("ua"), " ".join(["w"] * r.randrange(kinds)))
        for c in r.sample(range(-50, 2000), n)
        for t in range(r.randrange(1, longest))
    ]


@pytest.mark.parametrize("segment", [1, 2, 7, 100_000])
def test_equal_to_brute_force(segment):
    """All sizes of segment, in one process: nodes reach over one segment, several or none."""
    r = random.Random(segment)
    for _ in range(60):
        kinds = r.randrange(1, 5)
        convs = {
            c: tuple(("u", " w" * r.randrange(kinds)) for _ in range(r.randrange(0, 6)))
            for c in r.sample(range(1000), r.randrange(1, 50))
        }
        assert plain(convs, segment) == brute(convs)


def plain(convs, segment):
    """The steps of ``prefix_nodes`` on lists."""
    import pyarrow as pa

    digest = {t: hashlib.md5(repr(t).encode()).digest() for turns in convs.values() for t in turns}
    rows = sorted(
        (b"".join(digest[t] for t in turns), c, [len(t[1].split()) for t in turns]) for c, turns in convs.items()
    )
    batches = [
        pa.RecordBatch.from_arrays(
            [
                pa.array([x[1] for x in rows[i : i + 9]], pa.int64()),
                pa.array([x[0] for x in rows[i : i + 9]], pa.binary()),
                pa.array([x[2] for x in rows[i : i + 9]], pa.list_(pa.int64())),
            ],
            ["conv_id", "path", "words"],
        )
        for i in range(0, len(rows), 9)
    ]
    limit, prefix_trie.SEGMENT_ROWS = prefix_trie.SEGMENT_ROWS, segment
    try:
        parts = [r for b in prefix_trie._segments(iter(batches)) for r in b.to_pylist()]
    finally:
        prefix_trie.SEGMENT_ROWS = limit
    merged = {}
    for row in (p for p in parts if p["kind"] == prefix_trie.PARTIAL):
        held = merged.setdefault(row["key"], {**row, "conv_id": row["conv_id"], "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0})
        held["conv_id"] = min(held["conv_id"], row["conv_id"])
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            held[name] += row[name]
    whole = [r for b in prefix_trie._summed([pa.RecordBatch.from_pylist(list(merged.values()))]) for r in b.to_pylist()]
    pieces = sorted((p["key"], p["conv_id"], p["ends"]) for p in parts if p["kind"] == prefix_trie.ENDS)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[2] for p in pieces], pa.string())], ["key", "ends"]
    )
    ends = {r["key"]: r["ends_sha256"] for b in prefix_trie._joined_ends([batch]) for r in b.to_pylist()}
    for row in whole:
        row["ends_sha256"] = ends.get(row["key"], prefix_trie.NO_ENDS)
    known = {r["key"]: r["conv_id"] for r in whole}
    inner = [p for p in parts if p["kind"] == prefix_trie.COMPLETE]
    for row in inner:
        row["ends_sha256"] = row["ends"]
        if row["parent_key"] is not None:
            row["parent_conv_id"] = known[row["parent_key"]]
    return sorted((tuple(r[c] for c in prefix_trie.NODE_COLUMNS) for r in [*whole, *inner]), key=str)


def test_on_spark(spark):
    rows = random_rows(1, 300, 3, 5)
    rows += [(3000 + i, t, "u", "the same") for i in range(200) for t in range(3)]  # copies
    rows += [(4000, t, "u", f"long {t % 3}") for t in range(3000)]  # one long conversation
    assert ours(spark, rows) == brute(ordered(rows))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, None, "u", "first"), (1, 0, None, "x"), (1, 0, "u", None), (2, None, "u", "first"), (2, 5, "", "x"),
        (3, 1, "u", "a"), (3, 1, "u", "a"), (None, 0, "u", "nobody"), (4, 2**40, "u", "x" * 100_000),
        (5, 0, "a", "1:b"), (6, 0, "a1:", "b"), (7, 0, "", ""),
    ]
    assert ours(spark, rows) == brute(ordered(rows))


def test_empty(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(None, 0, "u", "x")]) == []


def test_query_rebuilds_conversations(spark, tmp_path):
    r = random.Random(7)
    rows = [
        (c, t, r.choice("ua"), " ".join(["w"] * r.randrange(3)))
        for c in r.sample(range(200), 90)
        for t in range(r.randrange(1, 6))
    ]
    rows += [(221, 0, "u", "alone"), (222, 0, "u", "alone")]  # their first conversation is absent
    own = ordered(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, ())[:h] + turns[h:]
    assert () in rebuilt.values()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    assert nodes(queries.op12_prefix_trie(spark, str(tmp_path))) == brute(rebuilt)
