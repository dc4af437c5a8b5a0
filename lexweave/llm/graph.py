"""Connected components by alternating large-star and small-star steps on edge tables.

Each step replaces edges by edges to smaller neighbours; the number of rounds
grows with the logarithm of the longest path.  Every round is a written table,
so lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_by_key, stored

MAX_ROUNDS = 60


def _linked(pairs: DataFrame, total: int | None) -> DataFrame:
    """Each (u, v) with ``m``, the smallest of u and its neighbours in ``pairs``, of which there are ``total`` at most."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("u", "m"))
    return join_by_key(pairs, least, "u", "_n", total=total)


def _large_star(edges: DataFrame, n: int | None = None) -> DataFrame:
    """``n``: the number of edges, if it is known; as many are returned at most."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _linked(both, None if n is None else 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int | None = None) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _linked(down, n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.union(down.groupBy("u").agg(F.min("v").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns u, v); root is the component's smallest node.

    Repeated edges and loops say nothing; a node with loops only isn't
    returned; no edges give no rows; edges with a null end are left out.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        new = now.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first()
        if new[0] == 0 or new == mark:
            break
        mark = new
        large = stored(_large_star(now, new[0]).distinct(), "large_star")
        before, now = now, stored(_small_star(large, new[0]).distinct(), "small_star")
        for done in (before, large):  # what a lost executor had is read from the table of this round
            discard(edges.sparkSession, done.stored_at)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
