"""Roll-ups of performance events, hardware samples, queue logs and attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_totals(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return events.groupBy(*keys, "stage").agg(
        F.sum("duration_s").alias("total_s"), F.count(F.lit(1)).alias("events")
    )


def shard_rollup(shards: DataFrame) -> DataFrame:
    """Per run and per shard (rollup) stage totals from a ``stages`` map column."""
    exploded = shards.select("run_id", "shard_index", F.explode("stages").alias("stage", "s"))
    return exploded.rollup("run_id", "stage").agg(
        F.sum("s").alias("total_s"), F.count(F.lit(1)).alias("shards"), F.max("s").alias("max_s")
    ).where("run_id IS NOT NULL")


def shard_durations(shards: DataFrame) -> DataFrame:
    return shards.groupBy("run_id").agg(
        F.max("duration_s").alias("max_shard_s"), F.sum("duration_s").alias("sum_shard_s"),
        F.count(F.lit(1)).alias("shards"),
    )


HW_METRICS = ("rss_mb", "cpu_percent", "thread_count", "gpu_mem_used_mb", "gpu_util_percent")
HW_PEAKS = ("peak_rss_mb", "max_thread_count", "max_cpu_percent", "peak_gpu_mem_used_mb",
            "max_gpu_util_percent")


def hardware_summary(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample counts, peaks and mean utilisation of text metrics; unparsable readings are missing."""
    rows = samples.select(
        *keys, "gpu_index", *[F.expr(f"try_cast({m} AS DOUBLE)").alias(m) for m in HW_METRICS]
    )
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(F.trim("gpu_index") != "").alias("gpu_sample_count"),
        F.max("rss_mb").alias("peak_rss_mb"), F.max("thread_count").alias("max_thread_count"),
        F.max("cpu_percent").alias("max_cpu_percent"),
        F.max("gpu_mem_used_mb").alias("peak_gpu_mem_used_mb"),
        F.max("gpu_util_percent").alias("max_gpu_util_percent"),
        F.avg("gpu_util_percent").alias("mean_gpu_util_percent"),
    )


def merge_hardware(per_part: DataFrame) -> DataFrame:
    """Merge summaries: sum of counts, max of peaks, mean of means."""
    return per_part.agg(
        F.sum("sample_count").alias("sample_count"),
        F.sum("gpu_sample_count").alias("gpu_sample_count"),
        *[F.max(p).alias(p) for p in HW_PEAKS],
        F.avg("mean_gpu_util_percent").alias("mean_gpu_util_percent"),
    )


def write_summary(writes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dataset count, bytes and ratios; writes of unknown stored size count as raw bytes only."""
    stored = F.sum(F.when(F.col("storage_bytes") > 0, F.col("storage_bytes")))
    raw = F.sum(F.coalesce("raw_bytes", F.lit(0)))
    return writes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dataset_count"), raw.alias("total_raw_bytes"),
        stored.alias("total_storage_bytes"), F.try_divide(stored, raw).alias("storage_to_raw_ratio"),
        F.try_divide(raw, stored).alias("raw_to_storage_ratio"),
    )


def top_writes(writes: DataFrame, n: int = 10, by: str = "duration_s") -> DataFrame:
    """Slowest (or largest) writes; the id breaks ties. Planned as a distributed top-k."""
    return writes.orderBy(F.col(by).desc(), F.col("event_id")).limit(n)


def benchmark_rollup(rows: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Mean, median and max of every numeric column, overall (key NULL) and by key."""
    from channelspark.operators.quantiles import exact_quantiles

    long = rows.select(key, *metrics).unpivot([key], list(metrics), "metric", "value").select(
        F.col(key).cast("string").alias(key), "metric", F.col("value").cast("double").alias("value")
    )
    stats = long.groupingSets(
        [[F.col("metric")], [F.col(key), F.col("metric")]], F.col(key), F.col("metric")
    ).agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    overall = exact_quantiles(long, ["metric"], "value", {"median": 0.5}).select(
        F.lit(None).cast("string").alias(key), "metric", "median"
    )
    by_key = exact_quantiles(long, [key, "metric"], "value", {"median": 0.5}).select(
        key, "metric", "median"
    )
    medians = overall.unionByName(by_key).withColumnsRenamed({key: "_k", "metric": "_m"})
    return stats.join(
        medians, F.col(key).eqNullSafe(F.col("_k")) & (F.col("metric") == F.col("_m")), "left"
    ).drop("_k", "_m")


def scan_profile(scan: DataFrame, dataset: str, fragment: str, source: str, value: str
                 ) -> DataFrame:
    """Per dataset: fragments, distinct sources, users and the lowest finite share of a fragment."""
    finite = F.count(value) / F.count(F.lit(1))
    per_fragment = scan.groupBy(dataset, fragment, source).agg(
        F.count(F.lit(1)).alias("rows"), finite.alias("finite_rate")
    )
    users = scan.groupBy(dataset).agg(F.count_distinct("ue").alias("ue_count"))
    return per_fragment.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("fragments"), F.count_distinct(source).alias("sources"),
        F.sum("rows").alias("rows"), F.min("finite_rate").alias("min_finite_rate"),
    ).join(users, dataset)


STATUSES = ("completed", "failed", "skipped", "planned")


def status_rollup(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per status plus the total."""
    return log.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count(F.lit(1)).alias("total"),
    )


def merge_status_latest(log: DataFrame) -> DataFrame:
    """Latest record per entity by (ts, seq), as a map-side combined aggregate."""
    latest = F.max_by(F.struct("ts", "seq", "status"), F.struct("ts", "seq"))
    return log.groupBy("entity").agg(latest.alias("m")).select("entity", "m.ts", "m.seq", "m.status")


def fallback_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts that ended in a split, one row each with their shard id."""
    return attempts.where(F.col("status") == "split")


def fallback_summary(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Splits per run and reason; the ids stay rows of :func:`fallback_attempts`."""
    return fallback_attempts(attempts).groupBy(*keys, "reason").agg(
        F.count(F.lit(1)).alias("split_count"), F.count_distinct("shard_id").alias("shards"),
    )


def run_summary(planned: DataFrame, produced: DataFrame, attempts: DataFrame, perf: DataFrame
                ) -> DataFrame:
    """Planned and produced shards, produced order bounds, fallbacks and stage time per run."""
    plan = planned.groupBy("run_id").agg(F.count(F.lit(1)).alias("planned"))
    done = produced.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("produced"), F.sum("ue_count").alias("ue_count"),
        F.min_by("shard_index", F.struct("first_ue", "shard_index")).alias("first_shard"),
        F.max_by("shard_index", F.struct("first_ue", "shard_index")).alias("last_shard"),
    )
    splits = fallback_attempts(attempts).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("split_attempts")
    )
    stages = perf.groupBy("run_id").agg(F.sum("duration_s").alias("stage_s"))
    return (
        plan.join(done, "run_id", "left").join(splits, "run_id", "left")
        .join(stages, "run_id", "left")
        .fillna(0, ["produced", "split_attempts"])
        .withColumn("missing", F.col("planned") - F.col("produced"))
    )
