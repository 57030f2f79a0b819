"""Connected components by alternating large-star and small-star steps.

Each step is two joins on node ids against per-node minima, which Spark sums per
task before the shuffle; a node with very many links is split by the join. Rounds
are tables in the shared folder. Links never reach the driver: it reads one
row of counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import staged


def _with_minima(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("m"))
    return edges.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """links (u, v) of distinct comparable ids -> (node, root): the smallest node reachable.

    Nodes without links don't appear. Repeated and reversed links are harmless.
    """
    edges = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of u moves to u's minimum.
        large = _with_minima(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours move to their minimum.
        low = _with_minima(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u <> v").distinct(), "links")
        # Fixed when every edge is a star around a root: roots are no one's larger end.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(now)


def with_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (node) -> (node, root), a node without links being its own root."""
    roots = connected_components(links)
    members = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    return nodes.join(members, "node", "left").select(*nodes.columns, F.coalesce("root", "node").alias("root"))
