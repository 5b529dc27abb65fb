"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channelspark.session import stored


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link neighbours of each node ``u`` to the smallest node around it.

    The large star links the neighbours above ``u``, the small star ``u`` and those below it.
    """
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        near = near.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if both_ways:
        out = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node with an edge.

    ``edges`` has the columns ``a`` and ``b``; loops and repeats do no harm. Each round is written
    to the shared folder, so a lost executor costs one round at most.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    sign = None
    for _ in range(max_rounds):
        now = stored(_star(_star(now, True), False), "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == sign:
            roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        sign = new
    raise RuntimeError("components did not settle")
