"""Radio maps: user x station tables, rasters and inverse-distance interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.operators.quantiles import exact_quantiles
from channelspark.operators.skew import salted_join


def measured(rss: DataFrame) -> Column:
    """Value where the link is valid and the reading finite."""
    return F.when(F.col("valid") & C.is_finite(F.col("rssi_dbm")), F.col("rssi_dbm"))


def radio_map(rss: DataFrame, station: Column, stations: Sequence[int]) -> DataFrame:
    """One row per user, one column per station slot; invalid links are NULL.

    A station that is not in ``stations`` is an error, not a lost column.
    """
    stray = F.raise_error(F.concat(F.lit("station not listed: "), F.coalesce(station.cast("string"), F.lit("NULL"))))
    slot = F.when(station.isin(list(stations)), station).otherwise(stray.cast("bigint"))
    rows = rss.select("ue", slot.alias("slot"), measured(rss).alias("v"))
    return rows.groupBy("ue").pivot("slot", list(stations)).agg(F.first("v", ignorenulls=True))


def value_summary(rss: DataFrame) -> DataFrame:
    v = measured(rss)
    return rss.agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"),
                   F.avg(v).alias("mean"))


def radio_map_filled(rss: DataFrame) -> DataFrame:
    """Invalid links drawn at the lowest valid value of the whole map."""
    lowest = rss.select(F.min(measured(rss))).scalar()
    return rss.select("ue", "bs", F.coalesce(measured(rss), lowest).alias("rssi_dbm"), "valid")


def ue_bs_table(rss: DataFrame, points: DataFrame) -> DataFrame:
    """Long user x station table with both positions.

    Users join on their own unique index; stations, where one may own most rows, join salted.
    """
    def side(role: str, key: str) -> DataFrame:
        return points.where(F.col("role") == role).select(
            F.col("idx").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in "xyz"]
        )

    with_user = rss.join(side("ue", "ue"), "ue")
    return salted_join(with_user, side("bs", "bs"), ["bs"], "ue")


def any_valid(rss: DataFrame, chosen: Column | None = None) -> DataFrame:
    """Whether a user is valid and finite on any (chosen) station."""
    hit = F.col("valid") & C.is_finite(F.col("rssi_dbm"))
    if chosen is not None:
        hit = hit & chosen
    return rss.groupBy("ue").agg(F.bool_or(hit).alias("any_valid"))


def grid_spacing(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median positive gap between distinct coordinates per key and axis; 1.0 without a gap.

    Coordinates are rounded to 1e-6, so one metre holds at most a million distinct values: gaps
    are taken inside one-metre blocks and, from block ends, across blocks.
    """
    axes = points.select(*keys, "x", "y").unpivot(list(keys), ["x", "y"], "axis", "c")
    keyed = [*keys, "axis"]
    distinct = (
        axes.where(C.is_finite(F.col("c"))).select(*keyed, F.bround("c", 6).alias("c")).distinct()
        .withColumn("block", F.floor("c"))
    )
    inside = W.partitionBy(*keyed, "block").orderBy("c")
    inner = distinct.select(*keyed, (F.col("c") - F.lag("c").over(inside)).alias("gap"))
    ends = distinct.groupBy(*keyed, "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    across = W.partitionBy(*keyed).orderBy("block")
    outer = ends.select(*keyed, (F.col("lo") - F.lag("hi").over(across)).alias("gap"))
    gaps = inner.unionByName(outer).where(F.col("gap") > 1e-6)
    medians = exact_quantiles(gaps, keyed, "gap", {"spacing": 0.5}).drop("n")
    return (
        distinct.select(*keyed).distinct().join(medians, keyed, "left")
        .withColumn("spacing", F.coalesce("spacing", F.lit(1.0)))
    )


def rasterize_mean(
    points: DataFrame, keys: Sequence[str], value: str,
    exclude: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Mean of clip(value, 0, 1) per grid cell over the extent of all positions.

    Empty cells are NULL; with ``exclude`` they are 0 and the cells inside the rectangle NULL.
    """
    finite = points.where(C.is_finite(F.col("x")) & C.is_finite(F.col("y")))
    spacing = grid_spacing(finite, keys).groupBy(*keys).agg(
        F.max(F.when(F.col("axis") == "x", F.col("spacing"))).alias("dx"),
        F.max(F.when(F.col("axis") == "y", F.col("spacing"))).alias("dy"),
    )
    frame = finite.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
        F.max("y").alias("y1"),
    ).join(spacing, list(keys))

    def cells(lo: str, hi: str, step: str) -> Column:
        return F.rint((F.col(hi) - F.col(lo)) / F.col(step)).cast("bigint")

    grid = frame.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), cells("x0", "x1", "dx"))).alias("ix")
    ).repartition(*keys, "ix").select(  # the columns of one large scene go to many tasks
        *keys, "ix", (F.col("x0") + F.col("ix") * F.col("dx")).alias("cx"), "y0", "dy",
        F.explode(F.sequence(F.lit(0).cast("bigint"), cells("y0", "y1", "dy"))).alias("iy"),
    ).select(*keys, "ix", "iy", "cx", (F.col("y0") + F.col("iy") * F.col("dy")).alias("cy"))
    clipped = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0))
    means = (
        salted_join(finite.where(C.is_finite(F.col(value))), frame, list(keys), "idx")
        .select(
            *keys, F.rint((F.col("x") - F.col("x0")) / F.col("dx")).cast("bigint").alias("ix"),
            F.rint((F.col("y") - F.col("y0")) / F.col("dy")).cast("bigint").alias("iy"),
            clipped.alias("v"),
        ).groupBy(*keys, "ix", "iy").agg(F.avg("v").alias("mean"))
    )
    joined = grid.join(means, [*keys, "ix", "iy"], "left")
    if exclude is not None:
        xmin, xmax, ymin, ymax = exclude
        hole = F.col("cx").between(xmin, xmax) & F.col("cy").between(ymin, ymax)
        joined = joined.withColumn(
            "mean", F.when(~hole, F.coalesce("mean", F.lit(0.0)))
        )
    return joined


def floorplan_extent(meta: DataFrame) -> DataFrame:
    """xmin, xmax, ymin, ymax from the origin plus the extent, or pixels times resolution."""
    width = F.coalesce("extent_x", F.col("width_px") * F.col("resolution"))
    height = F.coalesce("extent_y", F.col("height_px") * F.col("resolution"))
    return meta.withColumns({
        "xmin": F.col("origin_x"), "xmax": F.col("origin_x") + width,
        "ymin": F.col("origin_y"), "ymax": F.col("origin_y") + height,
    })
