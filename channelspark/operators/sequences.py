"""Ordered operators along one axis of a link: subcarriers or delay bins.

Every operator takes ``keys`` that identify one vector. The vector length is a tensor axis, so a
window over ``keys`` is bounded. Callers who start from array rows should repartition those compact
rows by link first: the windows and groupings below then need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from channelspark.session import stored

TWO_PI = 6.283185307179586
# Denominators below this are flat, powers are floored at the smallest double.
FLAT_CURVATURE = 1e-12
TINY = 2.2250738585072014e-308
#: Values nearer to zero than this share the middle buckets.
TINY_STEP = 1e-12


def unwrap_phase(samples: DataFrame, keys: Sequence[str], phase: str, order: str = "k",
                 name: str = "unwrapped") -> DataFrame:
    """Remove 2*pi jumps; a step of exactly +pi is kept as it is."""
    along = W.partitionBy(*keys).orderBy(order)
    step = F.col(phase) - F.lag(phase).over(along)
    half = TWO_PI / 2
    wrapped = F.pmod(step + half, F.lit(TWO_PI)) - half
    wrapped = F.when((wrapped == -half) & (step > 0), F.lit(half)).otherwise(wrapped)
    jump = F.when(F.abs(step) < half, F.lit(0.0)).otherwise(wrapped - step)
    upto = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        samples.withColumn("_jump", F.coalesce(jump, F.lit(0.0)))
        .withColumn(name, F.col(phase) + F.sum("_jump").over(upto))
        .drop("_jump")
    )


def with_neighbours(profile: DataFrame, keys: Sequence[str], value: str = "power",
                    order: str = "bin") -> DataFrame:
    """Adds ``left`` and ``right`` neighbour values (NULL at the ends)."""
    along = W.partitionBy(*keys).orderBy(order)
    return profile.withColumns({"left": F.lag(value).over(along), "right": F.lead(value).over(along)})


def is_local_peak(value: Column, left: Column, right: Column) -> Column:
    """At least as high as both neighbours; a missing neighbour never stands in the way."""
    return F.coalesce(value >= left, F.lit(True)) & F.coalesce(value >= right, F.lit(True))


def local_peaks(profile: DataFrame, keys: Sequence[str], value: str = "power",
                order: str = "bin") -> DataFrame:
    near = with_neighbours(profile, keys, value, order)
    return near.where(is_local_peak(F.col(value), F.col("left"), F.col("right")))


def first_peak_cluster(candidates: DataFrame, keys: Sequence[str], max_gap: int,
                       extra: Sequence[str] = ()) -> DataFrame:
    """Highest bin of the first run of candidates whose gaps stay within ``max_gap``.

    The lowest bin wins a tie. ``extra`` columns of the picked row are kept.
    """
    along = W.partitionBy(*keys).orderBy("bin")
    gap = F.col("bin") - F.lag("bin").over(along)
    broken = F.max((F.coalesce(gap, F.lit(0)) > max_gap).cast("int")).over(
        along.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    pick = F.max_by(F.struct("bin", "power", *extra),
                    F.struct(F.col("power"), (-F.col("bin")).alias("neg")))
    return (
        candidates.withColumn("_broken", broken).where("_broken = 0")
        .groupBy(*keys).agg(pick.alias("p"))
        .select(*keys, "p.bin", "p.power", *[f"p.{c}" for c in extra])
    )


def parabolic_offset(power: Column, left: Column, right: Column) -> Column:
    """Sub-bin peak offset on log power, within one bin; 0 at the ends and on flat tops."""
    lo, mid, hi = (F.log(F.greatest(c, F.lit(TINY))) for c in (left, power, right))
    curvature = lo - 2 * mid + hi
    offset = 0.5 * (lo - hi) / curvature
    usable = left.isNotNull() & right.isNotNull() & (F.abs(curvature) >= FLAT_CURVATURE)
    return F.when(usable, F.least(F.greatest(offset, F.lit(-1.0)), F.lit(1.0))).otherwise(
        F.lit(0.0))


def linear_interpolate(points: DataFrame, keys: Sequence[str], values: Sequence[str],
                       count: int) -> DataFrame:
    """Fill positions 0..count-1 piecewise linearly, holding the edge values.

    Duplicate positions are averaged first. Each known point generates the positions up to the
    next one, so no grid is joined.
    """
    placed = points.repartition(*keys)  # one shuffle serves the averaging and the window
    known = placed.groupBy(*keys, "k").agg(*[F.avg(v).alias(v) for v in values])
    along = W.partitionBy(*keys).orderBy("k")
    spans = known.select(
        *keys, "k", *values, F.lead("k").over(along).alias("_next"),
        F.lag("k").over(along).alias("_previous"),
        *[F.lead(v).over(along).alias(f"_next_{v}") for v in values],
    )
    start = F.when(F.col("_previous").isNull(), F.lit(0)).otherwise(F.col("k"))
    stop = F.coalesce(F.col("_next") - 1, F.lit(count - 1))
    filled = spans.withColumn("pos", F.explode(F.sequence(start.cast("int"), stop.cast("int"))))
    share = (F.col("pos") - F.col("k")) / (F.col("_next") - F.col("k"))
    inside = (F.col("pos") > F.col("k")) & F.col("_next").isNotNull()
    return filled.select(
        *keys, F.col("pos").alias("k"),
        *[F.when(inside, F.col(v) + (F.col(f"_next_{v}") - F.col(v)) * share)
          .otherwise(F.col(v)).alias(v) for v in values],
    )


def weighted_medians(rows: DataFrame, keys: Sequence[str], values: dict[str, str], weight: str
                     ) -> DataFrame:
    """First sorted value whose cumulative weight reaches half of the total, for several columns of one link.

    ``values`` maps value columns to output names. All columns are handled in one pass: their
    windows share the partitioning and only re-sort. A group is one link's samples, a tensor of bounded size; for
    groups of any size there is ``weighted_median``.
    """
    whole = W.partitionBy(*keys)
    reached = {
        v: F.sum(F.when(F.col(v).isNotNull(), F.col(weight))).over(
            whole.orderBy(v).rowsBetween(W.unboundedPreceding, W.currentRow))
        >= 0.5 * F.sum(F.when(F.col(v).isNotNull(), F.col(weight))).over(whole)
        for v in values
    }
    ranked = rows.select(
        *keys, *[F.when(ok, F.col(v)).alias(v) for v, ok in reached.items()]
    )
    return ranked.groupBy(*keys).agg(*[F.min(v).alias(name) for v, name in values.items()])


#: Buckets per factor of e on each side of zero, and equal parts into which the hit bucket is split.
WEIGHT_BUCKETS, WEIGHT_SPLIT = 64, 4096


def weighted_median(rows: DataFrame, keys: Sequence[str], value: str, weight: str,
                    name: str = "median") -> DataFrame:
    """First sorted value whose cumulative weight reaches half of the total, for groups of any size.

    Weights are added up per bucket of values in every task; only buckets, not rows, are put in order. The bucket in which
    the running weight passes one half is split evenly and searched again, and so is the part that is hit; of that part's rows
    equal values are merged before they are put in order. Rows without a value or weight do not count; a group
    without such rows gets NULL. Keys are not NULL.
    """
    by = list(keys)
    narrow = stored(rows.select(*by, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w")), "weighted-values")
    groups = narrow.select(*by).distinct()
    known = narrow.where("_v IS NOT NULL AND _w IS NOT NULL")
    size = F.log1p(F.abs("_v") / TINY_STEP) * WEIGHT_BUCKETS
    bucketed = known.withColumn("_b", F.floor(F.signum("_v") * size))
    total = known.groupBy(*by).agg((F.sum("_w") / 2).alias("_half"))
    first = _passing(
        bucketed.groupBy(*by, "_b").agg(F.sum("_w").alias("_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .join(total, by).withColumn("_before", F.lit(0.0)), by, "_b")
    width = F.col("_hi") - F.col("_lo")
    part = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * WEIGHT_SPLIT), F.lit(WEIGHT_SPLIT - 1))).otherwise(F.lit(0))
    inside = bucketed.join(first.select(*by, "_b", "_lo", "_hi", "_before", "_half"), [*by, "_b"]).withColumn("_part", part.cast("int"))
    second = _passing(
        inside.groupBy(*by, "_part").agg(F.sum("_w").alias("_w"), F.first("_before").alias("_before"), F.first("_half").alias("_half")), by, "_part")
    last = inside.drop("_before", "_half").join(second.select(*by, "_part", "_before", "_half"), [*by, "_part"])
    found = _passing(
        last.groupBy(*by, "_v").agg(F.sum("_w").alias("_w"), F.first("_before").alias("_before"), F.first("_half").alias("_half")), by, "_v")
    return groups.join(found.select(*by, F.col("_v").alias(name)), by, "left")


def _passing(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Per group the first part at which ``_before`` and the weights so far reach ``_half``; ``_before`` then counts up to it.

    Sums are rounded, so if no part of a bucket that should pass does, its last one is taken.
    """
    whole = W.partitionBy(*by)
    upto = whole.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = parts.withColumn("_upto", F.col("_before") + F.sum("_w").over(upto))
    hit = F.coalesce(F.min(F.when(F.col("_upto") >= F.col("_half"), F.col(order))).over(whole), F.max(order).over(whole))
    return run.withColumn("_hit", hit).where(F.col(order) == F.col("_hit")).withColumn("_before", F.col("_upto") - F.col("_w")).drop("_upto", "_hit", "_w")


def line_fit_sums(x: Column, y: Column, w: Column) -> dict[str, Column]:
    """Weighted sums that determine a line fit; usable in groupBy and as window aggregates."""
    return {"sw": F.sum(w), "sx": F.sum(w * x), "sy": F.sum(w * y), "sxx": F.sum(w * x * x),
            "sxy": F.sum(w * x * y)}


def line_from_sums(s: dict[str, Column]) -> tuple[Column, Column]:
    """(slope, intercept); zero variance gives slope 0, zero weight gives NULLs."""
    x_mean = F.try_divide(s["sx"], s["sw"])
    spread = s["sxx"] - s["sx"] * x_mean
    slope = F.when(spread > 0, (s["sxy"] - x_mean * s["sy"]) / spread).when(
        s["sw"] > 0, F.lit(0.0))
    return slope, F.try_divide(s["sy"] - slope * s["sx"], s["sw"])


def weighted_line_fit(rows: DataFrame, keys: Sequence[str], x: str, y: str, weight: str
                      ) -> DataFrame:
    """Slope and intercept per group from one combined aggregate; centre x beforehand."""
    sums = line_fit_sums(F.col(x), F.col(y), F.col(weight))
    grouped = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    slope, intercept = line_from_sums({n: F.col(n) for n in sums})
    return grouped.where("sw > 0").select(
        *keys, slope.alias("slope"), intercept.alias("intercept")
    )
