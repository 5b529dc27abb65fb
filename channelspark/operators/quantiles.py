"""Exact quantiles of groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here groups are
narrowed down in two counting passes: a monotone coarse bucket, then a linear split of the few
buckets that hold the wanted ranks. Only small count tables and the values of one fine bucket are
ever ranked together, and equal values are merged before that. Every size takes this way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from channelspark.session import stored

COARSE_PER_E_FOLD = 64
COARSE_UNIT = 1e-12
FINE_SPLIT = 4096


def _coarse(value: Column) -> Column:
    """Monotone bucket: logarithmic away from zero, about 40 * 64 buckets per sign."""
    size = F.log1p(F.abs(value) / COARSE_UNIT) * COARSE_PER_E_FOLD
    return F.floor(F.signum(value) * size)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
) -> DataFrame:
    """Linear-interpolation quantiles per group, plus ``n``, the number of non-NULL values.

    ``probabilities`` maps output column names to probabilities. Groups without values are absent;
    NULL is a key like any other. The input is evaluated once, when the query is built.
    """
    found = _quantiles(*_bucketed(df, keys, value, {}), probabilities)
    return found.select(*[F.col("_key")[k].alias(k) for k in keys], "n", *probabilities)


def quantile_summary(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], counts: dict[str, Column] | None = None,
) -> DataFrame:
    """Quantiles and plain statistics of every group from one evaluation of the input.

    Columns: keys, ``rows``, ``n`` (non-NULL values), ``sum``, ``min``, ``max``, the quantiles, and for each of ``counts`` the number of
    rows for which it holds. All but the quantiles are added up from the bucket table. Groups without values are kept; without keys there is always one row.
    """
    counts = counts or {}
    values, buckets = _bucketed(df, keys, value, counts)
    totals = [
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.sum("_sum").alias("sum"),
        F.min("_lo").alias("min"), F.max("_hi").alias("max"), *[F.coalesce(F.sum(f"_count_{name}"), F.lit(0)).alias(name) for name in counts],
    ]
    found = _quantiles(values, buckets, probabilities)
    if not keys:
        row = found.agg(F.struct(*[F.max(name).alias(name) for name in probabilities])).scalar()
        return buckets.agg(*totals).select("*", *[row[name].alias(name) for name in probabilities])
    stats, tails = buckets.groupBy("_key").agg(*totals).alias("l"), found.drop("n").alias("r")
    joined = stats.join(tails, F.col("l._key").eqNullSafe(F.col("r._key")), "left")
    return joined.select(*[F.col("l._key")[k].alias(k) for k in keys], *[f"l.{c}" for c in stats.columns if c != "_key"], *[f"r.{p}" for p in probabilities])


def _bucketed(df: DataFrame, keys: Sequence[str], value: str, counts: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The values with their groups (``_key, _v``), written once, and the table of coarse buckets."""
    key = F.struct(*keys) if keys else F.struct(F.lit(1).alias("all"))
    flags = [F.coalesce(c, F.lit(False)).alias(f"_count_{name}") for name, c in counts.items()]
    written = stored(df.select(key.alias("_key"), F.col(value).cast("double").alias("_v"), *flags), "quantile-input")
    buckets = written.withColumn("_b", _coarse(F.col("_v"))).groupBy("_key", "_b").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_v").alias("_c"), F.sum("_v").alias("_sum"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        *[F.count_if(f"_count_{name}").alias(f"_count_{name}") for name in counts])
    return written.select("_key", "_v").where("_v IS NOT NULL"), stored(buckets, "quantile-buckets")


def _quantiles(rows: DataFrame, buckets: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    keys = ["_key"]
    rows = rows.withColumn("_b", _coarse(F.col("_v")))
    coarse = buckets.where("_b IS NOT NULL").select(*keys, "_b", "_c", "_lo", "_hi")
    running = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    coarse = coarse.withColumns({
        "_upto": F.sum("_c").over(running), "n": F.sum("_c").over(W.partitionBy(*keys)),
    })
    wanted = F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p"))
        for name, p in probabilities.items()
    ])
    position = F.col("w.p") * (F.col("n") - 1)
    # Each quantile needs the two neighbouring ranks (zero-based); both may be the same.
    targets = coarse.select("*", F.explode(wanted).alias("w")).select(
        *keys, "_b", "_lo", "_hi", "n", F.col("w.q").alias("_q"),
        (F.col("_upto") - F.col("_c")).alias("_start"), "_upto", position.alias("_pos"),
        F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))).alias("_rank"),
    ).where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_upto")))
    targets = stored(targets, "quantile-targets")  # a few rows per group, read several times

    hit = targets.groupBy(*keys, "_b").agg(
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_start").alias("_start")
    )
    width = F.col("_hi") - F.col("_lo")
    fine_bucket = F.when(width > 0, F.least(
        F.floor((F.col("_v") - F.col("_lo")) / width * FINE_SPLIT), F.lit(FINE_SPLIT - 1)
    )).otherwise(F.lit(0)).cast("int")
    # Equal values merge before the shuffle, so repeated values cost one row each.
    values = (
        rows.join(hit, [*keys, "_b"]).withColumn("_f", fine_bucket)
        .groupBy(*keys, "_b", "_f", "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_start").alias("_start"))
    )
    values = stored(values, "quantile-values")
    fine = values.groupBy(*keys, "_b", "_f").agg(
        F.sum("_c").alias("_fc"), F.first("_start").alias("_start")
    )
    in_bucket = W.partitionBy(*keys, "_b").orderBy("_f").rowsBetween(W.unboundedPreceding, -1)
    fine = fine.select(
        *keys, "_b", "_f", "_fc",
        (F.col("_start") + F.coalesce(F.sum("_fc").over(in_bucket), F.lit(0))).alias("_fstart"),
    )
    wanted_fine = fine.join(
        targets.select(*keys, "_b", "_q", "_rank", "_pos", "n"), [*keys, "_b"]
    ).where((F.col("_rank") >= F.col("_fstart"))
            & (F.col("_rank") < F.col("_fstart") + F.col("_fc")))
    fine_hit = wanted_fine.select(*keys, "_b", "_f", "_fstart").distinct()
    ordered = W.partitionBy(*keys, "_b", "_f").orderBy("_v").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    ranked = (
        values.drop("_start").join(fine_hit, [*keys, "_b", "_f"])
        .withColumn("_last", F.col("_fstart") + F.sum("_c").over(ordered))
        .withColumn("_first", F.col("_last") - F.col("_c"))
    )
    picked = ranked.select(*keys, "_b", "_f", "_v", "_first", "_last").join(
        wanted_fine.select(*keys, "_b", "_f", "_q", "_rank", "_pos", "n"), [*keys, "_b", "_f"]
    ).where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last")))
    lower = F.max(F.when(F.col("_rank") == F.floor("_pos"), F.col("_v")))
    upper = F.max(F.when(F.col("_rank") == F.ceil("_pos"), F.col("_v")))
    share = F.max(F.col("_pos") - F.floor("_pos"))
    quantiles = picked.groupBy(*keys, "_q").agg(
        (lower + (upper - lower) * share).alias("_value"), F.max("n").alias("n")
    )
    return quantiles.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_q") == name, F.col("_value"))).alias(name)
          for name in probabilities],
    )
