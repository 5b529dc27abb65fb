"""Ordered operators along axes of any length: segmented scans.

The operators of ``sequences`` put one vector into one window, which suits subcarriers and delay bins.
Here a vector is cut into blocks of positions. Windows run inside blocks, each block hands on a carry
(its ends and what it has seen), and a short window over the carries joins the blocks up. No task holds
more than one block of a vector, or one carry per block. ``order`` is a whole number; sparse positions
only make more blocks. Results are those of ``sequences``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from channelspark.operators.sequences import TWO_PI

BLOCK = 65_536


def _blocks(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block))


def _turns(step: Column) -> Column:
    """Whole turns that undo a step of pi or more; a step of exactly +pi is kept."""
    half = TWO_PI / 2
    wrapped = F.pmod(step + half, F.lit(TWO_PI)) - half
    wrapped = F.when((wrapped == -half) & (step > 0), F.lit(half)).otherwise(wrapped)
    turns = F.round((wrapped - step) / TWO_PI).cast("bigint")
    return F.when(F.abs(step) < half, F.lit(0)).otherwise(F.coalesce(turns, F.lit(0)))


def unwrap_phase(samples: DataFrame, keys: Sequence[str], phase: str, order: str = "k",
                 name: str = "unwrapped", block: int = BLOCK) -> DataFrame:
    """E1 for long vectors: whole turns are counted, so the sum is exact whatever the blocks.

    A step from or to a NULL phase adds no turn.
    """
    rows, part = _blocks(samples, order, block), [*keys, "_block"]
    inside = W.partitionBy(*part).orderBy(order)
    turned = rows.withColumn("_turns", _turns(F.col(phase) - F.lag(phase).over(inside))).withColumn(
        "_turns", F.sum("_turns").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = rows.groupBy(*part).agg(
        F.min_by(F.struct(F.col(phase).alias("p")), order).alias("_first"),
        F.max_by(F.struct(F.col(phase).alias("p")), order).alias("_last"))
    within = turned.groupBy(*part).agg(F.max_by("_turns", order).alias("_within"))
    along = W.partitionBy(*keys).orderBy("_block")
    entry = _turns(F.col("_first.p") - F.lag("_last.p").over(along))
    carry = ends.join(within, part).withColumn("_entry", entry).select(
        *part, (F.sum("_entry").over(along) + F.coalesce(F.sum("_within").over(
            along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_carry"))
    return turned.join(carry, part).withColumn(
        name, F.col(phase) + TWO_PI * (F.col("_turns") + F.col("_carry"))).select(*samples.columns, name)


def first_peak_cluster(candidates: DataFrame, keys: Sequence[str], max_gap: int,
                       extra: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """E3 for long vectors: every block offers its best before its first gap; blocks before any gap count."""
    part = [*keys, "_block"]
    inside = W.partitionBy(*part).orderBy("bin")
    gap = F.col("bin") - F.lag("bin").over(inside)
    seen = F.max((F.coalesce(gap, F.lit(0)) > max_gap).cast("int")).over(
        inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    order = F.struct(F.col("power"), (-F.col("bin")).alias("neg"))
    blocks = _blocks(candidates, "bin", block).withColumn("_seen", seen).groupBy(*part).agg(
        F.min("bin").alias("_first"), F.max("bin").alias("_last"), F.max("_seen").alias("_broke"),
        F.max_by(F.struct("bin", "power", *extra), F.when(F.col("_seen") == 0, order)).alias("p"))
    along = W.partitionBy(*keys).orderBy("_block")
    apart = F.coalesce(F.lag("_broke").over(along) == 1, F.lit(False)) | F.coalesce(
        F.col("_first") - F.lag("_last").over(along) > max_gap, F.lit(False))
    reached = blocks.withColumn("_apart", apart).withColumn("_apart", F.max("_apart").over(along)).where("NOT _apart")
    best = F.max_by("p", F.struct(F.col("p.power"), (-F.col("p.bin")).alias("neg")))
    return reached.groupBy(*keys).agg(best.alias("p")).select(*keys, "p.bin", "p.power", *[f"p.{c}" for c in extra])


def linear_interpolate(points: DataFrame, keys: Sequence[str], values: Sequence[str], count: int | Column,
                       block: int = BLOCK) -> DataFrame:
    """E5 for long vectors; a gap of any width is filled block by block, never as one array.

    ``count`` may be a column, one of ``keys`` if vectors differ in length.
    """
    part = [*keys, "_block"]
    known = _blocks(points, "k", block).groupBy(*part, "k").agg(*[F.avg(v).alias(v) for v in values])
    point = F.struct("k", *values)
    along = W.partitionBy(*keys).orderBy("_block")
    carry = known.groupBy(*part).agg(F.min_by(point, "k").alias("_head")).select(
        *part, F.lead("_head").over(along).alias("_after"), F.lag("_head").over(along).isNull().alias("_start"))
    inside = W.partitionBy(*part).orderBy("k")
    spans = known.withColumns({"_next": F.lead(point).over(inside), "_lead": F.lag("k").over(inside).isNull()}).join(
        carry, part).withColumns({"_next": F.coalesce("_next", "_after"), "_edge": F.col("_lead") & F.col("_start")})
    start = F.when(F.col("_edge"), F.lit(0)).otherwise(F.col("k"))
    stop = F.coalesce(F.col("_next.k") - 1, F.lit(count) - 1 if isinstance(count, int) else count - 1)
    spans = spans.withColumns({"_from": start.cast("bigint"), "_to": stop.cast("bigint")}).where("_from <= _to")
    piece = spans.withColumn("_piece", F.explode(F.sequence(
        F.floor(F.col("_from") / block), F.floor(F.col("_to") / block))))
    filled = piece.withColumn("pos", F.explode(F.sequence(
        F.greatest("_from", F.col("_piece") * block), F.least("_to", (F.col("_piece") + 1) * block - 1))))
    share = (F.col("pos") - F.col("k")) / (F.col("_next.k") - F.col("k"))
    between = (F.col("pos") > F.col("k")) & F.col("_next").isNotNull()
    return filled.select(*keys, F.col("pos").alias("k"), *[
        F.when(between, F.col(v) + (F.col(f"_next.{v}") - F.col(v)) * share).otherwise(F.col(v)).alias(v)
        for v in values])
