"""Connected components of an undirected graph given as edges, as Spark jobs.

Large-star / small-star rounds: each node's smallest neighbour is a grouped
minimum (combined on the map side, so a node with very many edges costs one row
per task), joined back to the edges.  Every round is checkpointed into the
shared checkpoint folder, so a lost executor costs at most one round.  The
driver sees two numbers per round (edge count and checksum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component; only nodes that have an edge appear.

    ``edges`` has long columns ``a`` and ``b``; loops and repeated edges do no
    harm; no edges give no rows.  The checkpoint dir must be set.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before, now = None, _state(e)
    while now != before and now[0]:
        e = _small_star(_large_star(e)).distinct().checkpoint()
        before, now = now, _state(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # an edge (u, v) with v > u becomes (v, m(u)); e holds each edge once, its larger end first
    return e.join(low.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a")
    return moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        low.select("a", F.col("m").alias("b")))
