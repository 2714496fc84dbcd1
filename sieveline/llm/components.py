"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame) -> DataFrame:
    """Each node's neighbours (dst) get the smallest id around the node (src) as their new neighbour."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    return edges.join(least, "src").select(F.col("dst"), F.least("low", "src").alias("low"), "src")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node id that the edges reach) for every node of `edges` (src, dst, longs).

    No neighbourhood is collected: a round is two grouped minima and two joins, whose hot nodes Spark may split. The
    edge set is written after each round; the number of rounds grows with the logarithm of the longest path. Rows with
    a null end, self loops and repeated edges change nothing; no edges give no rows.
    """
    edges = written(
        edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = _star(both).where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        small = _star(large)
        edges = written(
            small.where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .unionByName(small.select("src", F.col("low").alias("dst"))).distinct(),
            "edges",
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.sum(F.col("dst").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
