"""Joins, shards, sampling and maps against brute force on small tables, with hot keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from channelspark.functions import grid
from channelspark.operators import links as L
from channelspark.operators import nearest as NE
from channelspark.operators import paths as PO
from channelspark.operators import quality as QA
from channelspark.operators import radiomap as RM
from channelspark.operators import sampling as SA
from channelspark.operators import shards as SH
from channelspark.operators.skew import salted_join, with_rank

PATH_SCHEMA = ("tx bigint, rx bigint, rx_ant int, tx_ant int, path bigint, tau_s double, "
               "a_re double, a_im double, phi_r double, theta_r double, phi_t double, "
               "theta_t double, interactions array<int>")


def path(ra, ta, p, tau, a, angle, codes):
    return (0, 0, ra, ta, p, tau, a, 0.0, angle, angle + 1, angle + 2, angle + 3, codes)


def test_path_labels_pick_each_their_own_angles(spark):
    df = spark.createDataFrame([
        path(0, 0, 0, 3e-9, 0.2, 0.3, []), path(1, 0, 1, 1e-9, 0.1, 0.1, [1]),
        path(0, 1, 2, 2e-9, 10.0, 0.2, [1, 2]), path(1, 1, 1, 1e-9, 0.1, 0.9, [1]),
    ], PATH_SCHEMA)
    row = PO.link_path_labels(df).first()
    assert (row.first_delay_s, row.first_azimuth_rad) == (1e-9, 0.1)  # tie: lower antenna
    assert (row.strongest_delay_s, row.strongest_azimuth_rad) == (2e-9, 0.2)
    assert row.los_distance_m == pytest.approx(3e-9 * 299792458) and row.los_azimuth_rad == 0.3
    assert PO.link_path_labels(df, "aod").first().first_azimuth_rad == pytest.approx(2.1)
    assert PO.angle_source(True, "uplink") == "aod" and PO.angle_source(True, "downlink") == "aoa"
    summary = PO.link_summary(df, 2, 2).first()
    assert summary.path_count == 3 and summary.los_exists and summary.nlos_exists
    assert summary.power_db == pytest.approx(10 * np.log10((0.04 + 0.02 + 100) / 4))


def test_cir_to_cfr_in_parts_equals_plain(spark):
    rng = np.random.default_rng(2)
    rows = [(0, 0, 0, 0, p, float(rng.uniform(0, 1e-7)), float(rng.normal()), float(rng.normal()),
             0., 0., 0., 0., []) for p in range(90)]
    rows += [(1, 0, 0, 0, p, 1e-8 * p, 1.0, 0.0, 0., 0., 0., 0., []) for p in range(3)]
    df = spark.createDataFrame(rows, PATH_SCHEMA)
    freqs = grid.frequency_grid(F.lit(1e9), F.lit(1e7), F.lit(4))
    keys = ["tx", "k"]
    plain = PO.cir_to_cfr(df, freqs).toPandas().sort_values(keys)
    hot = PO.cir_to_cfr(df, freqs, part_paths=10).toPandas().sort_values(keys)
    assert len(plain) == len(hot) == 8
    assert np.allclose(plain[["re", "im"]], hot[["re", "im"]], atol=1e-9)
    f = 1e9 + (np.arange(4) - 1.5) * 1e7 / 4
    expected = sum((r[6] + 1j * r[7]) * np.exp(-2j * np.pi * f * r[5]) for r in rows[:90])
    got = plain[plain.tx == 0]
    assert np.allclose(got.re + 1j * got.im, expected, atol=1e-6)


def test_power_control_clips(spark):
    links = spark.createDataFrame([(0, 0, -90.0), (0, 1, -80.0), (1, 0, -10.0), (1, 1, -10.0)],
                                  "tx bigint, rx bigint, power_db double")
    out = {r.tx: r for r in PO.uplink_power_control(links, p0_dbm=-20.0, alpha=1.0).collect()}
    assert out[0].serving_rx == 1 and out[0].tx_power_dbm == 23.0 and out[0].clipped
    assert out[1].serving_rx == 0 and out[1].tx_power_dbm == -10.0 and not out[1].clipped
    fixed = PO.uplink_power_control(links, enabled=False, fixed_tx_power_dbm=23.0).first()
    assert fixed.amplitude_scale == pytest.approx(np.sqrt(200), rel=1e-2)


def test_rank_and_salted_join_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(np.arange(900) < 600, 0, np.arange(900) % 7),
                        "i": rng.permutation(5000)[:900]})
    df = spark.createDataFrame(pdf)
    ranked = with_rank(df, ["g"], "i", "rank", width=64).toPandas()
    expected = pdf.assign(rank=pdf.groupby("g").i.rank().astype(int) - 1)
    merged = ranked.merge(expected, on=["g", "i"])
    assert (merged.rank_x == merged.rank_y).all() and len(merged) == 900
    few = spark.createDataFrame([(g, g * 10) for g in range(7)], "g bigint, v bigint")
    joined = salted_join(df, few, ["g"], "i", salts=5)
    assert joined.count() == 900 and joined.where("v != g * 10").count() == 0


def test_positions_and_links(spark):
    schema = "scene_id bigint, role string, idx bigint, x double, y double, z double, label string"
    points = spark.createDataFrame(
        [(0, "ue", i, float(i % 2), 0.0, 1.5, "") for i in range(4)]
        + [(0, "bs", i, 3.0, 4.0, 13.5, "") for i in range(3)], schema)
    links = L.link_geometry(L.build_links(points)).toPandas().sort_values("link_index")
    assert list(links.link_index) == list(range(12)) and list(links.tx) == sorted(links.tx)
    assert links.distance_m.iloc[0] == 13.0 and links.distance_2d_m.iloc[0] == 5.0
    down = L.build_links(points, "downlink").toPandas()
    assert len(down) == 12 and down.tx.max() == 2
    users = points.where("role = 'ue'")
    matched = {r.left_idx: r.right_idx for r in L.match_by_position(users, users).collect()}
    assert matched == {0: 0, 1: 1, 2: 0, 3: 1}
    with pytest.raises(ValueError):
        L.link_roles("sideways")


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(4)
    xy = np.vstack([rng.uniform(0, 40, (60, 2)), np.full((40, 2), 7.25),  # one busy position
                    rng.normal(30, 0.05, (60, 2))])  # and one busy tile
    value = rng.normal(size=len(xy))
    samples = spark.createDataFrame(
        [(0, i, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(xy, value))],
        "s bigint, id bigint, x double, y double, value double")
    grid_xy = [(i, j, i * 4.0 + 3.25, j * 4.0 + 3.25) for i in range(10) for j in range(10)]
    targets = spark.createDataFrame([(0, *t) for t in grid_xy],
                                    "s bigint, i bigint, j bigint, x double, y double")
    out = NE.knn_idw(targets, samples, scene="s", target=["i", "j"], k=5, power=2.0)
    got = {(r.i, r.j): r.value for r in out.collect()}
    assert len(got) == 100
    for i, j, x, y in grid_xy:
        d = np.hypot(xy[:, 0] - x, xy[:, 1] - y)
        near = np.lexsort((np.arange(len(d)), d))[:5]
        w = 1 / np.maximum(d[near], 1e-9) ** 2
        expected = value[near[0]] if d[near[0]] <= 1e-9 else (w * value[near]).sum() / w.sum()
        assert got[i, j] == pytest.approx(expected, rel=1e-9), (i, j)
    few = NE.knn_idw(targets, samples.where("id < 3"), scene="s", target=["i", "j"], k=5, power=2.0)
    assert few.count() == 100  # fewer samples than neighbours


def test_allocation_and_interleave(spark):
    scenes = spark.createDataFrame([("small", i) for i in range(4)] + [("normal", i) for i in range(8)],
                                   "c string, i bigint")
    quotas = SA.largest_remainder_allocation(scenes, "c", 6)
    assert {r.c: r.quota for r in quotas.collect()} == {"small": 2, "normal": 4}
    order = SA.interleave_positions(quotas, "c").orderBy("position").collect()
    assert [r.position for r in order] == list(range(6))
    assert [r.c for r in order] == ["normal", "small", "normal", "normal", "small", "normal"]
    with pytest.raises(Exception, match="exceeds"):
        SA.largest_remainder_allocation(scenes, "c", 20).collect()


def test_sampling_takes_the_first_by_hash(spark):
    rows = spark.range(600).select(F.when(F.col("id") < 400, "hot").otherwise("cold").alias("c"), "id")
    quotas = spark.createDataFrame([("hot", 150), ("cold", 20)], "c string, quota bigint")
    got = SA.stratified_sample(rows, "c", ["id"], quotas, 3).toPandas()
    hashed = rows.withColumn("h", SA.seeded_order(["id"], 3)).toPandas().sort_values("h")
    for c, n in (("hot", 150), ("cold", 20)):
        assert got[got.c == c].sort_values("rank").id.tolist() == hashed[hashed.c == c].id.head(n).tolist()
        assert sorted(got[got.c == c]["rank"]) == list(range(1, n + 1))


def test_batches_respect_both_caps(spark):
    rows = spark.createDataFrame([("r", i, u) for i, u in enumerate([5, 5, 5, 20, 1, 1, 1, 1])],
                                 "run string, fragment bigint, ue_count bigint")
    got = SH.training_batches(rows, "run", 3, 12).orderBy("fragment").collect()
    assert [r.batch for r in got] == [0, 0, 1, 2, 3, 3, 3, 4]
    many = [(f"r{run}", 10 * i, 1 + (7 * i * i + run) % 9) for run in range(4) for i in range(1, 150)]
    got = SH.training_batches(spark.createDataFrame(many, rows.schema), "run", 7, 30).collect()
    want, state = {}, {}
    for run, fragment, ue in many:
        batch, held, total = state.get(run, (0, 0, 0))
        if held and (held >= 7 or total + ue > 30):
            batch, held, total = batch + 1, 0, 0
        state[run] = batch, held + 1, total + ue
        want[run, fragment] = batch
    assert {(r.run, r.fragment): r.batch for r in got} == want
    free = SH.training_batches(rows, "run", None, None).select("batch").distinct().collect()
    assert [r.batch for r in free] == [0]


def test_shards_cover_and_stay_contiguous(spark):
    users = spark.range(8884).withColumnRenamed("id", "ue").withColumn("run", F.lit(0))
    table = SH.with_offsets(SH.shard_table(SH.assign_by_index(users, 1000), ["run"]), ["run"])
    sizes = [r.ue_count for r in table.orderBy("shard_index").collect()]
    assert sizes == [1000] * 8 + [884]
    assert SH.contiguity_violations(table, ["run"]).count() == 0
    expected = spark.createDataFrame([(0, 0, 8999)], "run int, first bigint, last bigint")
    assert SH.coverage_gaps(expected, users, ["run"], chunk=100).count() == 116


def test_union_needs_equal_stations(spark):
    a = spark.createDataFrame([(0, 0), (0, 1)], "ue bigint, bs bigint")
    b = spark.createDataFrame([(1, 0)], "ue bigint, bs bigint")
    assert SH.union_shards([a, a], "ue", "bs").count() == 4
    with pytest.raises(Exception, match="station"):
        SH.union_shards([a, b], "ue", "bs").count()


def test_clean_tables_pass(spark, sf):
    from channelspark.plans import bindings as B

    points = B.points(spark, sf)
    links = L.link_geometry(L.build_links(points)).withMetadata("distance_m", {"unit": "m"})
    assert QA.link_table(links, points, ["distance_m"]).count() == 0
    assert QA.all_finite(links, "links", ["distance_m"]).count() == 0
    assert QA.columns(links, "links", ["tx", "rx"], ["flag"]).count() == 0


def test_top_n_is_limited_before_the_shuffle(spark, sf):
    from channelspark.plans import bindings as B

    plan = PO.first_paths(B.paths(spark, sf), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_cir_to_cfr_sums_scattered_paths_where_they_are_shuffled(spark):
    """Path numbers far apart do not cut a pair into parts, so its unnested rows are shuffled once only."""
    rows = [(i // 3, 0, 0, 0, i * 10_000_000, 1e-8, 1.0, 0.0, 0., 0., 0., 0., []) for i in range(300)]
    out = PO.cir_to_cfr(spark.createDataFrame(rows, PATH_SCHEMA), frequency_grid := grid.frequency_grid(F.lit(1e9), F.lit(1e7), F.lit(4)))
    got = out.where("tx = 7").orderBy("k").collect()
    f = spark.range(1).select(frequency_grid).first()[0]
    assert out.count() == 400 and np.allclose([r.re + 1j * r.im for r in got], 3 * np.exp(-2j * np.pi * np.array(f) * 1e-8))
    plain = out._jdf.queryExecution().optimizedPlan().children().head().toString()  # pairs that are not cut up
    assert plain.count("Aggregate") - plain.count("Aggregate [tx#") <= 1 and "_part#" not in plain


def test_scan_reads_only_needed_columns(spark, sf):
    from channelspark.plans import bindings as B

    plan = PO.link_summary(B.paths(spark, sf), 2, 2)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "l_quantity" not in schema and "l_shipdate" not in schema


def test_concatenation_of_batches(spark):
    batches = spark.createDataFrame(
        [("r", 4, 0, 2, "up", [7, 8]), ("r", 9, 0, 1, "up", [3]), ("r", 12, 1, 2, "down", [1, 2])],
        "run string, fragment bigint, batch bigint, ue_count bigint, role string, ue_indices array<bigint>")
    data = spark.createDataFrame([("r", f, i) for f, n in ((4, 2), (9, 1), (12, 2)) for i in range(n)],
                                 "run string, fragment bigint, row bigint")
    got = SH.concat_rows(data, batches, "run", ["role"]).orderBy("batch", "position").collect()
    assert [(r.batch, r.position, r.fragment) for r in got] == [(0, 0, 4), (0, 1, 4), (0, 2, 9), (1, 0, 12), (1, 1, 12)]
    lists = SH.batch_indices(batches, "run", ["ue_indices"]).orderBy("batch").collect()
    assert [(r.fragments, r.ue_indices) for r in lists] == [([4, 9], [7, 8, 3]), ([12], [1, 2])]
    mixed = batches.withColumn("batch", F.lit(0))
    with pytest.raises(Exception, match="shared value"):
        SH.concat_rows(data, mixed, "run", ["role"]).collect()


def test_concatenated_rows_are_not_broadcast(spark, sf):
    """Unnested rows look as small as what they come from; they must not be sent through the driver."""
    from channelspark.plans import load_all
    from channelspark.plans.registry import QUERIES

    batches = spark.range(100).select(F.lit("r").alias("run"), F.col("id").alias("fragment"), (F.col("id") % 9).alias("batch"),
                                      F.lit(50).cast("bigint").alias("ue_count"), F.lit("up").alias("role"))
    data = batches.select("run", "fragment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ue_count") - 1)).alias("row"))
    joined = SH.concat_rows(data, batches, "run", ["role"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.select("batch", "position").distinct().count() == joined.count() == 5000
    load_all()
    plan = QUERIES["e12_concat_rows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan.split("Join")[0]  # unnested above every join
