"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two shuffles of the edges that are left, each with a minimum that is pre-aggregated on the map side; the
number of rounds grows with the logarithm of the longest path. Each round's edges are written to the shared folder, so
that lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the long edges (u, v): root is the least node reachable. Nodes without an edge to
    another node are left out; loops and repeated edges do no harm."""
    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        new = materialize(_small_star(_large_star(now).where("u != v").distinct()).where("u != v").distinct(), "edges")
        discard(now)
        now = new
        # Stars: no node is both a leaf and a root, and each leaf has one root.
        check = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if check == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = check
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
