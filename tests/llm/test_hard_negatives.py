"""Hard negatives against brute force with Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import hard_negatives as hn

DDL = "vec_id long, label int, embedding array<float>, list string, rank int"


def brute(rows, k=5):
    part = []
    for vec_id, label, vector in rows:
        if None in (vec_id, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        part.append((vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for a, label, vector in set(r for r in part if r[0] % 100 == 0):
        scored = sorted(
            (-max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, vector, v)))), i, other)
            for i, other, v in part
            if i != a
        )
        for minus, positive, _ in [s for s in scored if s[2] == label][:k]:
            score = -minus
            fitting = [(-m, i) for m, i, other in scored if other != label and 80 * score <= -100 * m <= 100 * score]
            out += [(a, positive, n + 1, i, score, s) for n, (s, i) in enumerate(fitting[:k])]
    return sorted(out)


def ours(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, "x", 9) for r in rows], DDL).repartition(parts)
    found = hn.hard_negatives(hn.valid_rows(table, F.col("label")), F.col("vec_id") % 100 == 0)
    return sorted(tuple(r) for r in found.collect())


def clustered(seed, n, groups=4, dims=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    return [
        (i, int(r.integers(3)), (centres[r.integers(groups)] + 0.2 * r.normal(size=dims)).astype(np.float32).tolist())
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hn, "CHUNK_ROWS", 200)
    monkeypatch.setattr(hn, "FIRST_STEP", 8)
    rows = clustered(seed, 900)
    assert ours(spark, rows) == brute(rows)


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_BYTES", 3 * 6 * 8)
    rows = clustered(3, 1000)
    assert ours(spark, rows) == brute(rows)


def test_ties_copies_nulls_and_odd_vectors(spark):
    r = random.Random(4)
    hot = [0.5, 0.25, -0.125]
    rows = [(i, i % 2, hot) for i in range(0, 400)]  # one vector holds most rows: ties by id
    rows += [(1000 + i, r.randrange(3), [r.uniform(-1, 1) for _ in range(3)]) for i in range(150)]
    rows += [(1000, 1, [0.1, 0.2, 0.3])] * 2 + rows[5:8]  # repeated rows
    rows += [(None, 1, hot), (7000, None, hot), (7100, 1, None), (7200, 1, [1.0, None, 2.0])]
    rows += [(7300, 1, [math.nan, 0.0, 0.0]), (7400, 1, [math.inf, 0.0, 0.0]), (7500, 0, [0.0, 0.0, 0.0])]
    assert ours(spark, rows) == brute(rows)


def test_vectors_of_unlike_length(spark):
    rows = [(0, 0, [0.5, 0.5]), (1, 0, [0.5, 0.5, 9.0]), (2, 1, [0.5]), (3, 1, []), (4, 1, [0.4, 0.55])]
    padded = [(i, label, [*v, 0.0, 0.0, 0.0][:3]) for i, label, v in rows]
    assert ours(spark, rows) == brute(padded) != []


def test_scores_beyond_doubles_and_64_bits(spark):
    r = random.Random(5)
    for size in (1e5, 1e6, 1e30):
        rows = [(i * 50, i % 2, [size * r.uniform(0.9, 1) for _ in range(4)]) for i in range(40)]
        assert ours(spark, rows) == brute(rows) != []


def test_empty_and_without_anchors(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []
    assert ours(spark, [(100, 0, [1.0]), (2, 1, [1.0])]) == []  # no positive


def test_walk_stops_early():
    """With tight clusters far apart, most rows are certified and never multiplied."""
    r = np.random.default_rng(6)
    centres = np.eye(4) * 256
    rows = np.floor(np.concatenate([c + r.normal(size=(3000, 4)) for c in centres]))
    labels = np.tile([0, 1], 6000)
    at = np.arange(0, 12000, 300)
    block = hn.Anchors(at, labels[at], rows[at])
    n = len(at)
    lists = hn.Lists(np.arange(n), n, np.full(n, hn.LEAST), np.full(n, hn.MOST), 5)
    seen = []
    hn.products, whole = lambda a, b: seen.append(len(a) * len(b)) or whole(a, b), hn.products
    try:
        hn.walk(block, lists, np.arange(12000), labels, rows, same=True)
    finally:
        hn.products = whole
    assert sum(seen) < n * 12000 / 2
    for i in range(n):
        scores = sorted(
            ((-int(rows[at[i]] @ rows[j]), j) for j in range(12000) if labels[j] == labels[at[i]] and j != at[i])
        )[:5]
        assert lists.ids[i].tolist() == [j for _, j in scores]
