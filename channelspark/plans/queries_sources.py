"""Source, sink and streaming queries: tables are written in the format under test and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from channelspark import schemas
from channelspark.operators import paths as PO
from channelspark.operators import summaries as S
from channelspark.plans import bindings as B
from channelspark.plans.queries_maps import FRAGMENT_SQL, fragments
from channelspark.plans.queries_metrics import (M, PAIR_SQL, per_station, resource_files, rounded,
                                                sim_sql)
from channelspark.plans.registry import query, r, sr
from channelspark.session import work_path
from channelspark.sources import logs as LG
from channelspark.sources import points as PT
from channelspark.sources import reports as RP
from channelspark.sources import runs as RU
from channelspark.streaming import logs as ST


def label_documents(spark, sf) -> str:
    """One JSON document per scene: stations as position arrays, users as x, y, z fields."""
    p = B.points(spark, sf)
    bs = F.struct(F.array("x", "y", "z").alias("position"), "label")
    ue = F.struct("x", "y", "z", "label")

    def listed(role, item):
        entry = F.when(F.col("role") == role, F.struct("idx", item.alias("p")))
        return F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["p"])

    docs = p.groupBy("scene_id").agg(
        listed("bs", bs).alias("bs_points"), listed("ue", ue).alias("ue_points")
    )
    path = work_path(spark, "labels")
    docs.write.json(path)
    return path


_LOCAL = """pl AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY scene_id, role ORDER BY idx) - 1 AS loc FROM fx_points)"""


@query("a1_read_points", f"WITH {_LOCAL} SELECT scene_id, role, loc AS idx, x, y, z, label FROM pl", ("fx_points",))
def a1(spark, sf):
    return PT.read_points(PT.read_labels(spark, label_documents(spark, sf)))


@query("a2_count_points", """SELECT scene_id, COUNT(*) FILTER (role = 'bs') AS bs_count, COUNT(*) FILTER (role = 'ue') AS ue_count
  FROM fx_points GROUP BY scene_id""", ("fx_points",))
def a2(spark, sf):
    return PT.count_points(PT.read_labels(spark, label_documents(spark, sf)))


@query("a3_select_points", f"WITH {_LOCAL} SELECT scene_id, loc AS idx, label FROM pl WHERE role = 'ue' AND loc BETWEEN 3 AND 12",
       ("fx_points",))
def a3(spark, sf):
    points = PT.read_points(PT.read_labels(spark, label_documents(spark, sf)))
    return PT.select_points(points, "ue", start=3, max_count=10).select("scene_id", "idx", "label")


@query("a4_read_manifest", f"""WITH {FRAGMENT_SQL}, n AS (SELECT scene_id AS run_id, ROW_NUMBER() OVER (PARTITION BY scene_id ORDER BY shard_index) - 1 AS entry,
  shard_index, 'shard_' || shard_index || '.parquet' AS source, off AS append_offset, ue_count, first_ue FROM fo)
  SELECT * FROM n""", ("fx_points",))
def a4(spark, sf):
    entry = F.struct(
        F.col("shard_index").cast("string").alias("shard_id"), "shard_index",
        F.concat(F.lit("shard_"), F.col("shard_index").cast("string"), F.lit(".parquet")).alias("path"),
        F.col("offset").alias("append_offset"), F.col("ue_indices").alias("global_ue_indices"),
    )
    path = work_path(spark, "manifest")
    fragments(spark, sf).groupBy(F.col("scene_id").alias("run_id")).agg(
        F.sort_array(F.collect_list(F.struct("shard_index", entry.alias("e")))).alias("s")
    ).select("run_id", F.col("s.e").alias("results")).write.json(path)
    return RU.read_manifest(spark, path).select(
        "run_id", "entry", "shard_index", "source", "append_offset",
        F.size("global_ue_indices").cast("bigint").alias("ue_count"),
        F.get("global_ue_indices", F.lit(0)).alias("first_ue"),
    )


def shard_table(spark, sf) -> str:
    """rss as a sharded long table: run = scene, shard of sixteen users."""
    rows = B.rss(spark, sf).select(
        F.expr(f"ue div {B.UE_PER_SCENE}").alias("run_id"), F.expr("ue div 16").alias("shard_index"),
        "ue", "bs", "rssi_dbm", "valid",
    )
    path = work_path(spark, "rss")
    RU.write_long_table(rows, path, ["run_id", "shard_index"], "ue")
    return path


SHARD_SCHEMA = T.StructType([
    *schemas.RSS.fields, T.StructField("run_id", T.LongType()), T.StructField("shard_index", T.LongType()),
])


@query("a5_resolve_result_paths", """SELECT 'result_' || w AS name, ROW_NUMBER() OVER (ORDER BY w) - 1 AS position
  FROM (SELECT DISTINCT worker // 10 AS w FROM fx_perf) t""", ("fx_perf",))
def a5(spark, sf):
    """A folder per ten workers stands for a result file; names sort by number, not by text."""
    path = work_path(spark, "results")
    B.perf(spark, sf).select(
        F.concat(F.lit("result_"), F.expr("worker div 10").cast("string")).alias("file"), "event_id"
    ).repartition("file").write.partitionBy("file").json(path)
    found = RU.resolve_result_paths(spark, path, "*.json")
    name = F.regexp_extract("path", r"(result_\d+)/[^/]+$", 1)
    from channelspark.functions.text import natural_key
    from channelspark.operators.skew import with_rank

    names = found.select(name.alias("name")).distinct().withColumn(
        "number", F.get(natural_key(F.col("name")), F.lit(0))
    )
    return with_rank(names, [], "number", "position").select("name", "position")


@query("a6_scan_dataset", f"""SELECT ue // {B.UE_PER_SCENE} AS run_id, ue // 16 AS shard_index, COUNT(*) AS rows, COUNT(DISTINCT ue) AS ues,
  {sr('SUM(rssi_dbm)')} AS total, TRUE AS has_source FROM fx_rss GROUP BY ALL""", ("fx_rss",))
def a6(spark, sf):
    rows = RU.scan_dataset(spark, shard_table(spark, sf), SHARD_SCHEMA)
    return rows.groupBy("run_id", "shard_index").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ue").alias("ues"),
        r(F.sum("rssi_dbm")).alias("total"),
        F.bool_and(F.col("source_file").contains("shard_index=")).alias("has_source"),
    )


_LABELS = f"""SELECT tx, rx, COUNT(DISTINCT path) AS path_count, BOOL_OR(flag = 'A') AS los_exists,
  {sr('10 * LOG10(GREATEST(SUM(a_re * a_re + a_im * a_im) / 4.0::DOUBLE, 1e-30::DOUBLE))')} AS power_db FROM fx_paths GROUP BY tx, rx"""


@query("a7_scan_link_labels", _LABELS, ("fx_paths",))
def a7(spark, sf):
    labels = PO.link_summary(B.paths(spark, sf), 2, 2).withColumn("shard_index", F.expr("tx div 500"))
    path = work_path(spark, "labels")
    RU.write_long_table(labels, path, ["shard_index"], "tx")
    rows = RU.scan_dataset(spark, path, labels.schema,
                           ["tx", "rx", "path_count", "los_exists", "power_db"])
    return rows.drop("source_file").withColumn("power_db", r(F.col("power_db")))


def scene_index_file(spark, sf) -> str:
    """An index per class, with some malformed, non-object and blank lines."""
    entry = F.to_json(F.struct(F.col("source_scene_index").alias("index"), "scene_key", "scene_class"))
    i = F.col("source_scene_index")
    line = F.when(i % 97 == 5, '{"index": ').when(i % 89 == 3, "[1, 2]").when(i % 83 == 7, "  ")
    path = work_path(spark, "scene-index")
    (
        B.scenes(spark, sf)
        .select(F.col("scene_class").alias("stratum"), i.alias("i"), line.otherwise(entry).alias("value"))
        .repartition("stratum").sortWithinPartitions("stratum", "i")
        .select("stratum", "value").write.partitionBy("stratum").text(path)
    )
    return path


@query("a8_read_scene_index", """SELECT source_scene_index AS index, scene_key, scene_class FROM fx_scenes
  WHERE source_scene_index % 97 <> 5 AND source_scene_index % 89 <> 3 AND source_scene_index % 83 <> 7""", ("fx_scenes",))
def a8(spark, sf):
    return LG.read_scene_index(spark, scene_index_file(spark, sf))


@query("a8_scene_index_errors", """WITH n AS (SELECT source_scene_index AS i, scene_class, ROW_NUMBER() OVER (PARTITION BY scene_class
  ORDER BY source_scene_index) AS line FROM fx_scenes)
  SELECT scene_class, line, CASE WHEN i % 97 = 5 THEN 'malformed' ELSE 'not an object' END AS problem FROM n
  WHERE i % 97 = 5 OR i % 89 = 3""", ("fx_scenes",))
def a8_errors(spark, sf):
    out = LG.scene_index_errors(spark, scene_index_file(spark, sf))
    stratum = F.url_decode(F.regexp_extract("file", r"stratum=([^/]+)/", 1))
    return out.select(F.url_decode(stratum).alias("scene_class"), "line", "problem")


@query("a9_load_scene_catalog", """SELECT scene_key, scene_class, source_scene_index, bs_count, ue_count, link_count FROM fx_scenes
  WHERE scene_class IN ('Brand#1', 'Brand#2', 'Brand#3')""", ("fx_scenes",))
def a9(spark, sf):
    scenes = B.scenes(spark, sf)
    path = work_path(spark, "split-manifest")
    i = F.col("source_scene_index")
    scenes.select(
        F.col("scene_key").alias("scene_dir"), F.when(i % 2 == 0, F.col("scene_class")).alias("split_class"),
        F.when(i % 2 == 1, F.col("scene_class")).alias("class"), F.when(i % 3 == 0, i).alias("scene_index"),
    ).write.json(path)
    counts = scenes.select("scene_key", "bs_count", "ue_count")
    return LG.load_scene_catalog(spark, path, ["Brand#1", "Brand#2", "Brand#3"], counts)


@query("a10_read_perf_logs", f"""SELECT stage, COUNT(*) AS events, {sr('SUM(duration_s)', 4)} AS total_s, SUM(raw_bytes)::BIGINT AS raw_bytes,
  MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM fx_perf GROUP BY stage""", ("fx_perf",))
def a10(spark, sf):
    path = work_path(spark, "perf-json")
    perf = B.perf(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    perf.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return LG.read_perf_events(spark, path).groupBy("stage").agg(
        F.count(F.lit(1)).alias("events"), r(F.sum("duration_s"), 4).alias("total_s"),
        F.sum("raw_bytes").alias("raw_bytes"), F.min("ts").cast("timestamp_ntz").alias("first_ts"),
        F.max("ts").cast("timestamp_ntz").alias("last_ts"),
    )


@query("a10_read_hardware_csv", """SELECT user_id AS worker, COUNT(*) AS samples, COUNT(*) FILTER (event_id % 13 <> 0) AS readable FROM events GROUP BY 1""")
def a10_hardware(spark, sf):
    from channelspark.plans.queries_telemetry import hw_samples

    path = work_path(spark, "hw-csv")
    rows = hw_samples(spark, sf)
    RP.write_csv_report(rows, path)
    return LG.read_hardware_samples(spark, path, rows.schema).groupBy("worker").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count(F.expr("try_cast(rss_mb AS DOUBLE)")).alias("readable"),
    )


@query("a10_read_link_chunks", f"""SELECT event_id AS chunk, event_id * 10 AS links, {sr('duration_s')} AS duration_s FROM fx_perf""", ("fx_perf",))
def a10_chunks(spark, sf):
    path = work_path(spark, "chunks-csv")
    RP.write_csv_report(B.perf(spark, sf).select(
        F.col("event_id").alias("chunk"), F.col("raw_bytes").alias("links"), "duration_s"), path)
    return LG.read_link_chunks(spark, path).withColumn("duration_s", r(F.col("duration_s")))


@query("a11_write_long_table", f"""SELECT ue // {B.UE_PER_SCENE} AS run_id, ue // 16 AS shard_index, ue, bs, valid, {sr('rssi_dbm')} AS rssi_dbm FROM fx_rss""",
       ("fx_rss",))
def a11(spark, sf):
    rows = spark.read.schema(SHARD_SCHEMA).parquet(shard_table(spark, sf))
    return rows.withColumn("rssi_dbm", r(F.col("rssi_dbm")))


@query("a12_compact_shards", f"""SELECT ue // {B.UE_PER_SCENE} AS run_id, ue // 16 AS shard_index, ue, bs,
  ROW_NUMBER() OVER (PARTITION BY ue // {B.UE_PER_SCENE}, ue // 16 ORDER BY ue, bs) - 1 AS fragment_offset FROM fx_rss""",
       ("fx_rss",))
def a12(spark, sf):
    target = work_path(spark, "packed")
    RU.compact_shards(spark, shard_table(spark, sf), target, SHARD_SCHEMA, ["run_id", "shard_index"],
                      ["ue", "bs"])
    packed = T.StructType([*SHARD_SCHEMA.fields, T.StructField("fragment_offset", T.LongType())])
    return spark.read.schema(packed).parquet(target).select(
        "run_id", "shard_index", "ue", "bs", "fragment_offset")


@query("a13_write_csv_report", f"SELECT ue, bs, valid, {sr('rssi_dbm')} AS rssi_dbm FROM fx_rss", ("fx_rss",))
def a13(spark, sf):
    path = work_path(spark, "radio-map-csv")
    rows = B.rss(spark, sf)
    RP.write_csv_report(rows, path)
    back = spark.read.schema(rows.schema).option("header", True).csv(path)
    return back.withColumn("rssi_dbm", r(F.col("rssi_dbm")))


@query("a14_write_json_summary", """WITH f AS (SELECT rx_ant AS file, COUNT(*) AS n FROM fx_est GROUP BY rx_ant)
  SELECT 'file' AS kind, file, n AS re_count FROM f UNION ALL SELECT 'aggregate', NULL, SUM(n)::BIGINT FROM f""", ("fx_est",))
def a14(spark, sf):
    path = work_path(spark, "summary-json")
    files = resource_files(spark, sf)
    RP.write_json_summary(files, S.resource_total(files), path)
    rows = spark.read.schema("kind string, body string").json(path)
    return rows.select("kind", F.get_json_object("body", "$.file").cast("bigint").alias("file"),
                       F.get_json_object("body", "$.re_count").cast("bigint").alias("re_count"))


@query("a15_select_products", _LABELS, ("fx_paths",))
def a15(spark, sf):
    paths = B.paths(spark, sf)
    wide = PO.link_path_labels(paths).join(PO.link_summary(paths, 2, 2), ["tx", "rx"])
    out = RU.select_products(wide, ["labels"], ["tx", "rx"])
    return out.select("tx", "rx", "path_count", "los_exists", r(F.col("power_db")).alias("power_db"))


@query("a16_read_similarity_csv", f"WITH {PAIR_SQL}, s AS ({sim_sql('pr', 'tx, rx')}) SELECT tx AS ue, "
       f"CASE WHEN rx % 2 = 0 THEN 'even' ELSE 'odd' END AS comparison, COUNT(*) AS n, "
       + ", ".join(f"{sr(f'AVG({m})')} AS {m}" for m in M) + " FROM s GROUP BY ALL", ("fx_cfr",))
def a16(spark, sf):
    rows = per_station(spark, sf)
    paths = {}
    for name, rest in (("even", 0), ("odd", 1)):
        paths[name] = work_path(spark, f"similarity-{name}")
        RP.write_csv_report(rows.where(F.col("rx") % 2 == rest).select(
            F.col("tx").alias("ue"), *M), paths[name])
    out = RP.read_similarity_csv(spark, paths)
    return out.groupBy("ue", "comparison").agg(
        F.count(F.lit(1)).alias("n"), *[r(F.avg(m)).alias(m) for m in M])


def _event_stream(spark, sf):
    """The events file as a stream of performance events."""
    schema = B.table(spark, sf, "events").schema
    raw = ST.file_stream(spark, sf, schema, pattern="events.parquet")
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("user_id").alias("worker"),
                      F.col("event_type").alias("stage"), F.col("value").alias("duration_s"))


@query("h1_stream_status_counts", "SELECT status, COUNT(*) AS n FROM fx_queue GROUP BY status", ("fx_queue",))
def h1(spark, sf):
    path = work_path(spark, "queue-json")
    B.queue(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).write.json(path)
    log = ST.file_stream(spark, path, schemas.QUEUE_LOG, "json", max_files=4)
    counts = ST.status_counts(log)
    out = ST.batch_outputs(spark, ST.run_available(counts, "update", name="h1"), counts.schema)
    return ST.newest_per_key(out, ["status"])


@query("h2_stream_stage_totals", f"""SELECT DATE_TRUNC('hour', ts) AS start, stage, {sr('SUM(duration_s)', 4)} AS total_s, COUNT(*) AS events
  FROM fx_perf GROUP BY ALL""", ("fx_perf",))
def h2(spark, sf):
    windows = ST.stage_windows(_event_stream(spark, sf))
    out = ST.batch_outputs(spark, ST.run_available(windows, "update", name="h2"), windows.schema)
    return ST.newest_per_key(out, ["start", "stage"]).withColumns(
        {"total_s": r(F.col("total_s"), 4), "start": F.col("start").cast("timestamp_ntz")})


@query("h2_stream_late_rows", """WITH m AS (SELECT DATE_TRUNC('hour', MAX(ts) - INTERVAL 1 HOUR) AS closed FROM fx_perf)
  SELECT COUNT(*) + COUNT(*) FILTER (ts < closed) AS "read", COUNT(*) AS kept, COUNT(*) FILTER (ts < closed) AS late
  FROM fx_perf, m""", ("fx_perf",))
def h2_late(spark, sf):
    """All events in time, then those of closed windows once more, in several files and a second run."""
    events = B.perf(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    closed = events.agg(F.date_trunc("hour", F.max("ts") - F.expr("INTERVAL 1 HOUR"))).scalar()
    source = work_path(spark, "late")
    events.repartition(2, "ts").write.parquet(source)
    path = ST.run_available(ST.stage_windows(ST.file_stream(spark, source, events.schema)), "update", name="h2-late")
    events.where(F.col("ts") < closed).repartition(4, "event_id").write.mode("append").parquet(source)
    windows = ST.stage_windows(ST.file_stream(spark, source, events.schema, max_files=2))
    ST.run_available(windows, "update", path)
    current = ST.newest_per_key(ST.batch_outputs(spark, path, windows.schema), ["start", "stage"])
    return ST.late_rows(spark, path, current, "events")


@query("h3_stream_hw_peaks", f"""WITH w AS (SELECT event_id, duration_s, TIME_BUCKET(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * n AS start
  FROM fx_perf, (SELECT UNNEST(RANGE(4)) AS n) t)
  SELECT start, {sr('MAX(duration_s)')} AS peak_rss_mb, {sr('AVG(event_id % 101)')} AS mean_util, COUNT(*) AS samples FROM w GROUP BY start""",
       ("fx_perf",))
def h3(spark, sf):
    samples = _event_stream(spark, sf).select(
        "ts", F.col("duration_s").alias("rss_mb"), (F.col("event_id") % 101).alias("util"))
    windows = ST.hardware_windows(samples)
    out = ST.batch_outputs(spark, ST.run_available(windows, "update", name="h3"), windows.schema)
    return ST.newest_per_key(out, ["start"]).withColumns(
        {"peak_rss_mb": r(F.col("peak_rss_mb")), "mean_util": r(F.col("mean_util")),
         "start": F.col("start").cast("timestamp_ntz")})


@query("h4_stream_worker_sessions", f"""WITH g AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY worker ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM fx_perf),
  s AS (SELECT *, SUM(brk) OVER (PARTITION BY worker ORDER BY ts) AS n FROM g),
  c AS (SELECT worker, MIN(ts) AS start, MAX(ts) + INTERVAL 6 HOUR AS stop, COUNT(*) AS events, {sr('SUM(duration_s)', 4)} AS busy_s FROM s GROUP BY worker, n)
  SELECT * FROM c WHERE stop <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM fx_perf)""", ("fx_perf",))
def h4(spark, sf):
    sessions = ST.worker_sessions(_event_stream(spark, sf))
    out = ST.batch_outputs(spark, ST.run_available(sessions, "append", name="h4"), sessions.schema)
    return out.drop("batch").withColumns({
        "busy_s": r(F.col("busy_s"), 4), "start": F.col("start").cast("timestamp_ntz"),
        "stop": F.col("stop").cast("timestamp_ntz")})


@query("h5_stream_latest_status", """SELECT entity, ts, seq, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity
  ORDER BY ts DESC, seq DESC) AS rn FROM fx_queue) t WHERE rn = 1""", ("fx_queue",))
def h5(spark, sf):
    """Every third line is delivered twice; replays must not count."""
    queue = B.queue(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path = work_path(spark, "queue-replayed")
    queue.unionByName(queue.where("seq % 3 = 0")).write.parquet(path)
    log = ST.file_stream(spark, path, queue.schema)
    return ST.latest_status(log).select(
        "entity", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", "status")


@query("h7_stream_shard_ingest", f"""SELECT worker, COUNT(*) AS events, {sr('SUM(duration_s)', 4)} AS total_s FROM fx_perf GROUP BY worker""", ("fx_perf",))
def h7(spark, sf):
    """Two deliveries of shard files; the second run resumes and reads only the new ones."""
    perf = B.perf(spark, sf)
    source = work_path(spark, "shards")
    early = perf.where("worker % 2 = 0")
    early.write.mode("append").parquet(source)
    target = ST.ingest_shards(spark, source, perf.schema)
    perf.where("worker % 2 = 1").write.mode("append").parquet(source)
    ST.ingest_shards(spark, source, perf.schema, target)
    out = ST.batch_outputs(spark, target, perf.schema)
    return out.groupBy("worker").agg(
        F.count(F.lit(1)).alias("events"), r(F.sum("duration_s"), 4).alias("total_s"))
