"""Connected components by alternating large and small stars.

Edges stay distributed: each round rewrites them, by two shuffles on a node, into fewer and
flatter stars, and is written to the shared folder. The number of rounds grows with the logarithm
of the longest path. Minima of neighbours combine before the shuffle, so a node with very many
links is no burden; joins on such a node are left to adaptive skew handling. Later rounds write as many
files as their edges call for, not one for each shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.store import release, saved

#: Edges to a task and its file; a round writes no more files than that, or than there are cores.
EDGES = 100_000


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of its closed neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): root is the least node it is joined to."""
    stars = saved(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        now = mark(stars)
        if now == seen or not now[0]:
            break
        seen, last = now, stars
        n_files = max(edges.sparkSession.sparkContext.defaultParallelism, now[0] // EDGES)
        stars = saved(small_star(large_star(last)).coalesce(n_files))
        release(last)
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
