"""Queries over performance events, hardware samples, queue logs and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from channelspark.operators import telemetry as TM
from channelspark.plans import bindings as B
from channelspark.plans.registry import query, r, sr


def shard_perf(spark, sf):
    """One row per worker shard with its map of stage totals; a run is fifty workers."""
    per_stage = TM.stage_totals(B.perf(spark, sf), ["worker"])
    entries = F.collect_list(F.struct("stage", "total_s"))
    return per_stage.groupBy("worker").agg(
        F.map_from_entries(entries).alias("stages"), F.sum("total_s").alias("duration_s")
    ).select(F.expr("worker div 50").alias("run_id"), F.col("worker").alias("shard_index"), "stages",
             "duration_s")


@query("d16_shard_rollup", f"""WITH s AS (SELECT worker // 50 AS run_id, worker, stage, SUM(duration_s) AS s FROM fx_perf GROUP BY ALL)
  SELECT run_id, stage, {sr('SUM(s)')} AS total_s, COUNT(*) AS shards, {sr('MAX(s)')} AS max_s FROM s
  GROUP BY GROUPING SETS ((run_id, stage), (run_id))""", ("fx_perf",))
def d16(spark, sf):
    out = TM.shard_rollup(shard_perf(spark, sf))
    return out.withColumns({"total_s": r(F.col("total_s")), "max_s": r(F.col("max_s"))})


@query("d16_shard_durations", f"""WITH s AS (SELECT worker // 50 AS run_id, worker, SUM(duration_s) AS s FROM fx_perf GROUP BY ALL)
  SELECT run_id, {sr('MAX(s)')} AS max_shard_s, {sr('SUM(s)')} AS sum_shard_s, COUNT(*) AS shards FROM s GROUP BY run_id""",
       ("fx_perf",))
def d16_durations(spark, sf):
    out = TM.shard_durations(shard_perf(spark, sf))
    return out.withColumns({c: r(F.col(c)) for c in ("max_shard_s", "sum_shard_s")})


def hw_samples(spark, sf):
    """Text metrics with gaps: every thirteenth memory reading is unparsable."""
    value = F.col("value")
    return B.table(spark, sf, "events").select(
        F.col("user_id").alias("worker"), "ts",
        F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(value.cast("string")).alias("rss_mb"),
        (F.col("event_id") % 100).cast("string").alias("cpu_percent"),
        (F.col("event_id") % 64).cast("string").alias("thread_count"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise("0").alias("gpu_index"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 977).cast("string"))
        .alias("gpu_mem_used_mb"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 101).cast("string"))
        .alias("gpu_util_percent"),
    )


_HW_SQL = """h AS (SELECT user_id AS worker, CASE WHEN event_id % 13 <> 0 THEN value END AS rss, event_id % 100 AS cpu,
  event_id % 64 AS th, CASE WHEN event_id % 3 <> 0 THEN event_id % 977 END AS gm, CASE WHEN event_id % 3 <> 0 THEN event_id % 101 END AS gu
  FROM events), w AS (SELECT worker, COUNT(*) AS sample_count, COUNT(gm) AS gpu_sample_count, MAX(rss) AS peak_rss_mb,
  MAX(th)::DOUBLE AS max_thread_count, MAX(cpu)::DOUBLE AS max_cpu_percent, MAX(gm)::DOUBLE AS peak_gpu_mem_used_mb,
  MAX(gu)::DOUBLE AS max_gpu_util_percent, AVG(gu) AS mean_gpu FROM h GROUP BY worker)"""


@query("d17_hardware_summary", f"""WITH {_HW_SQL} SELECT * EXCLUDE (mean_gpu), {sr('mean_gpu')} AS mean_gpu_util_percent FROM w""")
def d17(spark, sf):
    out = TM.hardware_summary(hw_samples(spark, sf), ["worker"])
    return out.withColumn("mean_gpu_util_percent", r(F.col("mean_gpu_util_percent")))


@query("d17_merge_hardware", f"""WITH {_HW_SQL} SELECT SUM(sample_count)::BIGINT AS sample_count, SUM(gpu_sample_count)::BIGINT AS gpu_sample_count,
  MAX(peak_rss_mb) AS peak_rss_mb, MAX(max_thread_count) AS max_thread_count, MAX(max_cpu_percent) AS max_cpu_percent,
  MAX(peak_gpu_mem_used_mb) AS peak_gpu_mem_used_mb, MAX(max_gpu_util_percent) AS max_gpu_util_percent,
  {sr('AVG(mean_gpu)')} AS mean_gpu_util_percent FROM w""")
def d17_merge(spark, sf):
    out = TM.merge_hardware(TM.hardware_summary(hw_samples(spark, sf), ["worker"]))
    return out.withColumn("mean_gpu_util_percent", r(F.col("mean_gpu_util_percent")))


@query("d18_write_summary", f"""SELECT stage, COUNT(*) AS dataset_count, SUM(raw_bytes)::BIGINT AS total_raw_bytes,
  CAST(SUM(storage_bytes) FILTER (storage_bytes > 0) AS BIGINT) AS total_storage_bytes,
  {sr('SUM(storage_bytes) FILTER (storage_bytes > 0)::DOUBLE / SUM(raw_bytes)')} AS storage_to_raw_ratio,
  {sr('SUM(raw_bytes)::DOUBLE / SUM(storage_bytes) FILTER (storage_bytes > 0)')} AS raw_to_storage_ratio
  FROM fx_perf GROUP BY stage""", ("fx_perf",))
def d18(spark, sf):
    out = TM.write_summary(B.perf(spark, sf), ["stage"])
    return out.withColumns(
        {c: r(F.col(c)) for c in ("storage_to_raw_ratio", "raw_to_storage_ratio")}
    )


@query("d19_stage_totals", f"""SELECT stage, {sr('SUM(duration_s)', 4)} AS total_s, COUNT(*) AS events FROM fx_perf GROUP BY stage""",
       ("fx_perf",))
def d19(spark, sf):
    return TM.stage_totals(B.perf(spark, sf)).withColumn("total_s", r(F.col("total_s"), 4))


@query("d20_benchmark_rollup", f"""WITH l AS (UNPIVOT (SELECT stage, duration_s, raw_bytes::DOUBLE AS raw_bytes FROM fx_perf)
  ON duration_s, raw_bytes INTO NAME metric VALUE value)
  SELECT stage, metric, {sr('AVG(value)', 4)} AS mean, {sr('MEDIAN(value)', 4)} AS median, {sr('MAX(value)', 4)} AS max FROM l
  GROUP BY GROUPING SETS ((metric), (stage, metric))""", ("fx_perf",))
def d20(spark, sf):
    rows = B.perf(spark, sf).withColumn("raw_bytes", F.col("raw_bytes").cast("double"))
    out = TM.benchmark_rollup(rows, "stage", ["duration_s", "raw_bytes"])
    return out.withColumns({c: r(F.col(c), 4) for c in ("mean", "median", "max")})


@query("d21_scan_profile", f"""WITH s AS (SELECT bs % 7 AS dataset, ue // 16 AS fragment, ue // 64 AS source, ue,
  CASE WHEN valid THEN rssi_dbm END AS v FROM fx_rss),
  f AS (SELECT dataset, fragment, source, COUNT(*) AS n, COUNT(v)::DOUBLE / COUNT(*) AS rate FROM s GROUP BY ALL)
  SELECT f.dataset, COUNT(*) AS fragments, COUNT(DISTINCT source) AS sources, SUM(n)::BIGINT AS rows, {sr('MIN(rate)')} AS min_finite_rate,
  (SELECT COUNT(DISTINCT ue) FROM s WHERE s.dataset = f.dataset) AS ue_count FROM f GROUP BY f.dataset""", ("fx_rss",))
def d21(spark, sf):
    rows = B.rss(spark, sf).select(
        (F.col("bs") % 7).alias("dataset"), F.expr("ue div 16").alias("fragment"),
        F.expr("ue div 64").alias("source"), "ue", F.when(F.col("valid"), F.col("rssi_dbm")).alias("v"),
    )
    out = TM.scan_profile(rows, "dataset", "fragment", "source", "v")
    return out.withColumn("min_finite_rate", r(F.col("min_finite_rate")))


_STATUS = ", ".join(f"COUNT(*) FILTER (status = '{s}') AS {s}" for s in TM.STATUSES)


@query("d22_status_rollup", f"SELECT {_STATUS}, COUNT(*) AS total FROM fx_queue", ("fx_queue",))
def d22(spark, sf):
    return TM.status_rollup(B.queue(spark, sf))


@query("d22_status_by_entity", f"SELECT entity, {_STATUS}, COUNT(*) AS total FROM fx_queue GROUP BY entity", ("fx_queue",))
def d22_entity(spark, sf):
    return TM.status_rollup(B.queue(spark, sf), ["entity"])


def attempts(spark, sf):
    """Failed queue entries are attempts; those of even sequence number were split."""
    return B.queue(spark, sf).where("status = 'failed'").select(
        F.expr("entity div 100").alias("run_id"), F.col("entity").alias("shard_id"), "seq",
        F.when(F.col("seq") % 2 == 0, "split").otherwise("failed").alias("status"),
        F.when(F.col("seq") % 3 == 0, "oom").otherwise("timeout").alias("reason"),
    )


@query("d23_fallback_summary", """SELECT entity // 100 AS run_id, CASE WHEN seq % 3 = 0 THEN 'oom' ELSE 'timeout' END AS reason,
  COUNT(*) AS split_count, COUNT(DISTINCT entity) AS shards FROM fx_queue WHERE status = 'failed' AND seq % 2 = 0 GROUP BY ALL""",
       ("fx_queue",))
def d23(spark, sf):
    return TM.fallback_summary(attempts(spark, sf), ["run_id"])


@query("d23_fallback_attempts", """SELECT entity // 100 AS run_id, entity AS shard_id, seq FROM fx_queue
  WHERE status = 'failed' AND seq % 2 = 0""", ("fx_queue",))
def d23_attempts(spark, sf):
    return TM.fallback_attempts(attempts(spark, sf)).select("run_id", "shard_id", "seq")


@query("d45_run_summary", f"""WITH p AS (SELECT scene_id AS run_id, idx AS ue, (ROW_NUMBER() OVER (PARTITION BY scene_id ORDER BY idx) - 1) // 16
  AS shard_index FROM fx_points WHERE role = 'ue'),
  s AS (SELECT run_id, shard_index, COUNT(*) AS ue_count, MIN(ue) AS first_ue FROM p GROUP BY ALL),
  pr AS (SELECT * FROM s WHERE first_ue % 5 <> 2),
  a AS (SELECT run_id, COUNT(*) AS planned FROM s GROUP BY 1),
  b AS (SELECT run_id, COUNT(*) AS produced, SUM(ue_count)::BIGINT AS ue_count, MIN_BY(shard_index, first_ue) AS first_shard,
  MAX_BY(shard_index, first_ue) AS last_shard FROM pr GROUP BY 1),
  c AS (SELECT entity // 100 AS run_id, COUNT(*) AS split_attempts FROM fx_queue WHERE status = 'failed' AND seq % 2 = 0 GROUP BY 1),
  d AS (SELECT worker // 10 AS run_id, SUM(duration_s) AS stage_s FROM fx_perf GROUP BY 1)
  SELECT a.run_id, planned, COALESCE(produced, 0) AS produced, ue_count, first_shard, last_shard,
  COALESCE(split_attempts, 0) AS split_attempts, {sr('stage_s', 4)} AS stage_s, planned - COALESCE(produced, 0) AS missing
  FROM a LEFT JOIN b USING (run_id) LEFT JOIN c USING (run_id) LEFT JOIN d USING (run_id)""",
       ("fx_points", "fx_queue", "fx_perf"))
def d45(spark, sf):
    from channelspark.plans.queries_maps import fragments

    planned = fragments(spark, sf).withColumnRenamed("scene_id", "run_id")
    produced = planned.where("first_ue % 5 <> 2")
    perf = B.perf(spark, sf).withColumn("run_id", F.expr("worker div 10"))
    out = TM.run_summary(planned, produced, attempts(spark, sf), perf)
    return out.withColumn("stage_s", r(F.col("stage_s"), 4))


@query("f4_top_writes", "SELECT event_id, stage, duration_s FROM fx_perf ORDER BY duration_s DESC, event_id LIMIT 10", ("fx_perf",))
def f4(spark, sf):
    return TM.top_writes(B.perf(spark, sf)).select("event_id", "stage", "duration_s")


@query("f4_largest_writes", "SELECT event_id, stage, raw_bytes FROM fx_perf ORDER BY raw_bytes DESC, event_id LIMIT 10", ("fx_perf",))
def f4_largest(spark, sf):
    return TM.top_writes(B.perf(spark, sf), by="raw_bytes").select("event_id", "stage", "raw_bytes")


@query("f10_merge_status_latest", """SELECT entity, ts, seq, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity
  ORDER BY ts DESC, seq DESC) AS rn FROM fx_queue) t WHERE rn = 1""", ("fx_queue",))
def f10(spark, sf):
    return TM.merge_status_latest(B.queue(spark, sf))
