"""Sources, sinks and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from channelspark import schemas
from channelspark.session import shared_dir, work_path
from channelspark.sources import logs as LG
from channelspark.sources import points as PT
from channelspark.sources import reports as RP
from channelspark.sources import runs as RU
from channelspark.streaming import logs as ST


def lines(spark, texts, name):
    path = work_path(spark, name)
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(path)
    return path


def test_label_documents(spark):
    good = {"scene_id": 1, "bs_points": [{"position": [1, 2, 3], "label": "a"}],
            "ue_points": [{"x": 4, "y": 5, "z": 6}, {"position": [7, 8, 9]}]}
    labels = PT.read_labels(spark, lines(spark, [json.dumps(good)], "good"))
    points = PT.read_points(labels)
    got = sorted((r.role, r.idx, r.x, r.z) for r in points.collect())
    assert got == [("bs", 0, 1.0, 3.0), ("ue", 0, 4.0, 6.0), ("ue", 1, 7.0, 9.0)]
    assert PT.count_points(labels).first()[1:] == (1, 2)
    assert PT.select_points(points, "ue", max_count=9, start=1).count() == 1  # clipped
    assert PT.select_points(points, "ue", max_count=9, indices=[0, 1]).count() == 2
    for bad in ({"start": 1, "count": 2}, {"indices": [2]}, {"start": 2}):
        with pytest.raises(Exception, match="exceeds"):
            PT.select_points(points, "ue", max_count=9, **bad).collect()
    for document, match in (({"scene_id": 1, "bs_points": []}, "top-level"),
                            ({"scene_id": 1, "bs_points": [{"position": [1, 2]}], "ue_points": []},
                             "three coordinates")):
        path = lines(spark, [json.dumps(document)], "bad")
        with pytest.raises(Exception, match=match):
            PT.read_points(PT.read_labels(spark, path)).collect()


def test_scene_index_reports_line_numbers(spark):
    path = lines(spark, ['{"index": 0}', "", "{oops", '{"index": 1}', "[3]"], "index")
    assert [r["index"] for r in LG.read_scene_index(spark, path).orderBy("index").collect()] == [0, 1]
    bad = LG.scene_index_errors(spark, path).orderBy("line").collect()
    assert [(r.line, r.problem) for r in bad] == [(3, "malformed"), (5, "not an object")]


def test_manifest_single_run_and_bundles(spark):
    docs = [{"run_id": 1, "result": "all.parquet"},
            {"run_id": 2, "results": [
                {"shard_id": "000", "shard_index": 0, "path": "a", "bundle": "b",
                 "append_offset": 4, "global_ue_indices": [8, 9]}]}]
    path = lines(spark, [json.dumps(d) for d in docs], "manifest")
    rows = {r.run_id: r for r in RU.read_manifest(spark, path).collect()}
    assert rows[1].source == "all.parquet"
    assert rows[2].source == "b" and rows[2].append_offset == 4
    assert rows[2].global_ue_indices == [8, 9]


def test_products():
    assert RU.resolve_products(["rtt", "range", "labels"]) == ["ranging", "link_labels"]
    assert len(RU.resolve_products(["all"])) == 15
    for bad in (["nothing"], []):
        with pytest.raises(ValueError):
            RU.resolve_products(bad)


def test_natural_order_of_results(spark):
    base = work_path(spark, "natural")
    for n in (10, 2, 1):
        spark.range(1).write.json(f"{base}/result_{n}")
    found = RU.resolve_result_paths(spark, base, "*.json").select("path").collect()
    order = [r.path.split("result_")[1].split("/")[0] for r in found]
    assert sorted(order) == ["1", "10", "2"] and len(order) == 3


def test_empty_similarity_table_is_an_error(spark):
    path = work_path(spark, "empty")
    RP.write_csv_report(spark.createDataFrame([], RP.SIMILARITY), path)
    with pytest.raises(ValueError, match="empty"):
        RP.read_similarity_csv(spark, {"x": path})


def test_hot_shard_is_written_by_several_tasks(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(1).alias("shard"),
                                    F.col("id").alias("ue"))
    path = work_path(spark, "long")
    RU.write_long_table(rows, path, ["shard"], "ue", files=4)
    back = RU.scan_dataset(spark, path, rows.schema)
    files = back.groupBy("shard").agg(F.count_distinct("source_file").alias("n"), F.count("*").alias("c"))
    got = {r.shard: (r.n, r.c) for r in files.collect()}
    assert got[0][0] > 1 and got[0][1] == 3000 and got[1][1] == 1000


def events(spark, stamps, start=0):
    base = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(start + i, base + timedelta(minutes=m), 1, "solve", 2.0, 0, 0)
         for i, m in enumerate(stamps)], schemas.PERF_EVENTS)


def test_late_rows_are_dropped_after_the_watermark(spark):
    source = work_path(spark, "perf")
    events(spark, [0, 10, 70, 400]).coalesce(1).write.mode("append").parquet(source)
    windows = ST.stage_windows(ST.file_stream(spark, source, schemas.PERF_EVENTS))
    path = ST.run_available(windows, "append")
    events(spark, [20, 410, 800], 10).coalesce(1).write.mode("append").parquet(source)  # 20: late
    windows = ST.stage_windows(ST.file_stream(spark, source, schemas.PERF_EVENTS))
    ST.run_available(windows, "append", path)
    rows = ST.batch_outputs(spark, path, windows.schema).orderBy("start").collect()
    assert [(r.start.hour, r.events) for r in rows] == [(0, 2), (1, 1), (6, 2)]
    assert ST.dropped_late(spark, path).agg({"dropped": "sum"}).first()[0] == 1


def test_late_rows_of_more_than_a_hundred_batches_and_a_restart(spark, request):
    """Progress keeps 100 batches only; the batch log keeps all, over two runs."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", partitions))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    source = work_path(spark, "perf")
    events(spark, [0, 6000]).coalesce(1).write.mode("append").parquet(source)
    path = ST.run_available(ST.stage_windows(ST.file_stream(spark, source, schemas.PERF_EVENTS)), "update")
    late = events(spark, [m % 60 for m in range(330)], 10)  # windows closed by the first run
    late.repartition(110, "event_id").write.mode("append").parquet(source)
    files = spark.read.schema(schemas.PERF_EVENTS).parquet(source).select(F.input_file_name()).distinct().count()
    windows = ST.stage_windows(ST.file_stream(spark, source, schemas.PERF_EVENTS, max_files=1))
    ST.run_available(windows, "update", path)
    current = ST.newest_per_key(ST.batch_outputs(spark, path, windows.schema), ["start", "stage"])
    assert tuple(ST.late_rows(spark, path, current, "events").first()) == (332, 2, 330)
    log = ST.batch_log(spark, path)
    assert files > 100 and log.where("rows > 0").count() == files
    # rows of one window in one file are combined before they are dropped: one each
    assert ST.dropped_late(spark, path).agg({"dropped": "sum"}).first()[0] == files - 1


def test_latest_status_resumes_and_emits_changes_only(spark):
    source = work_path(spark, "queue")
    t = datetime(2024, 1, 1)

    def deliver(*items):
        rows = [(e, i, t + timedelta(minutes=i), f"s{i}") for e, i in items]
        spark.createDataFrame(rows, schemas.QUEUE_LOG).coalesce(1).write.mode("append").parquet(source)
        return ST.file_stream(spark, source, schemas.QUEUE_LOG, max_files=1)

    path = work_path(spark, "latest")
    ST.latest_status(deliver((0, 0), (1, 1), (2, 9)), path)
    log = deliver((1, 4), (1, 1), (2, 3))  # newer, replayed, older than what is known
    got = {r.entity: r.status for r in ST.latest_status(log, path).collect()}
    assert got == {0: "s0", 1: "s4", 2: "s9"}
    changed = ST.batch_outputs(spark, path, ST.status_changes(log).schema).where("batch > 0")
    assert {r.entity for r in changed.collect()} == {1, 2}


def test_ingest_reads_each_file_once(spark):
    source = work_path(spark, "ingest")
    events(spark, [0, 1]).write.mode("append").parquet(source)
    path = ST.ingest_shards(spark, source, schemas.PERF_EVENTS)
    events(spark, [2], 7).write.mode("append").parquet(source)
    ST.ingest_shards(spark, source, schemas.PERF_EVENTS, path)
    ids = [r.event_id for r in ST.batch_outputs(spark, path, schemas.PERF_EVENTS).collect()]
    assert sorted(ids) == [0, 1, 7]


def test_replays_do_not_change_the_latest_status(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 1, t, "planned"), (1, 2, t + timedelta(minutes=1), "completed"),
            (1, 1, t, "planned"), (2, 3, t, "failed")]
    source = work_path(spark, "queue")
    spark.createDataFrame(rows, schemas.QUEUE_LOG).write.parquet(source)
    log = ST.file_stream(spark, source, schemas.QUEUE_LOG)
    got = {r.entity: r.status for r in ST.latest_status(log).collect()}
    assert got == {1: "completed", 2: "failed"}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
