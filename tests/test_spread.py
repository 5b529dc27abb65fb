"""Operators whose groups may hold most rows: weighted medians, spread sampling, hot-key joins, covariance blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelspark.operators import sampling as SA
from channelspark.operators import sequences as Q
from channelspark.operators import shards as SH
from channelspark.operators import skew as SK
from channelspark.operators import spectrum as SP
from channelspark.operators.quantiles import quantile_summary


def median(v, w):
    order = np.argsort(v, kind="stable")
    return v[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]


def test_weighted_median_of_one_large_group(spark):
    rng = np.random.default_rng(2)
    groups = {
        "hot": (np.round(rng.normal(0, 3, 20000), 3), rng.integers(1, 50, 20000).astype(float)),
        "near": (1 + rng.uniform(0, 1e-9, 500), rng.integers(1, 4, 500).astype(float)),
        "same": (np.full(50, -2.5), np.ones(50)),
        "wide": (np.array([-1e300, -1.0, 0.0, 1e-14, 5.0, 1e300]), np.array([1.0, 1, 1, 1, 1, 1])),
        "one": (np.array([7.0]), np.array([0.25])),
    }
    rows = [(g, float(a), float(b)) for g, (v, w) in groups.items() for a, b in zip(v, w)] + [("none", None, 1.0), ("one", 3.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(8)
    got = {r.g: r.median for r in Q.weighted_median(df, ["g"], "v", "w").collect()}
    assert got == {"none": None} | {g: median(*vw) for g, vw in groups.items()}


def spread(points, count):
    """(item, x, y) rows; plain farthest-first."""
    centre = np.mean([p[1:] for p in points], axis=0)
    d = {p[0]: (p[1] - centre[0]) ** 2 + (p[2] - centre[1]) ** 2 for p in points}
    at = {p[0]: p for p in points}
    chosen = [min(d, key=lambda i: (-d[i], i))]
    while len(chosen) < min(count, len(points)):
        gap = {i: min((p[1] - at[c][1]) ** 2 + (p[2] - at[c][2]) ** 2 for c in chosen) for i, p in at.items() if i not in chosen}
        chosen.append(min(gap, key=lambda i: (-gap[i], i)))
    return chosen


def test_farthest_points_against_plain_search(spark):
    rng = np.random.default_rng(3)
    scenes = {
        0: [(i, *map(float, xy)) for i, xy in enumerate(rng.uniform(-9, 9, (300, 2)))],
        1: [(i, float(i % 5), float(i % 3)) for i in range(60)],  # ties and repeated places
        2: [(4, 1.0, 1.0)], 3: [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)],
        4: [(i, *map(float, xy)) for i, xy in enumerate(np.vstack([rng.normal(0, 1e-3, (2000, 2)), [[50, 50]]]))],
    }
    df = spark.createDataFrame([(s, *p) for s, ps in scenes.items() for p in ps], "s bigint, i bigint, x double, y double")
    rows = SA.farthest_point_sample(df, "s", "i", 9).orderBy("s", "pick").collect()
    got = {s: [r.i for r in rows if r.s == s] for s in scenes}
    for s, points in scenes.items():
        if s == 4:
            assert got[s][0] == 2000 and len(set(got[s])) == 9
        else:
            assert got[s] == spread(points, 9), s


def test_far_cells_keep_their_distances(spark):
    """A cell out of reach of the last choice is passed on as it is."""
    df = spark.createDataFrame([(0, i, 10.0 * i, 0.0) for i in range(40)], "s bigint, i bigint, x double, y double")
    cells = SA._cells(df, "s", "i")
    first = cells.groupBy("s").agg(F.max("top").alias("best"))
    cells = SA._after(cells, first, "s", True)
    second = cells.groupBy("s").agg(F.max("top").alias("best"))
    after = SA._after(cells, second, "s", False)
    flat = lambda d: {p["item"]: p["d"] for r in d.collect() for p in r.points}
    before, now = flat(cells), flat(after)
    assert sum(before[i] == now[i] for i in before) >= 18 and sum(v < 0 for v in now.values()) == 2


def test_only_hot_keys_are_copied(spark):
    many = spark.range(10000).select(F.when(F.col("id") < 6000, 0).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("i"))
    few = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = {r.k: r["_salts"] for r in SK.hot_keys(many, ["k"], 10).collect()}
    assert hot == {0: 7}
    joined = SK.salted_join(many, few, ["k"], "i", salts=10)
    assert joined.count() == 10000 and joined.where("v <> 2 * k").count() == 0 and joined.columns == ["k", "i", "v"]


def test_covariance_blocks_of_uneven_rows(spark):
    schema = "tx int, rx int, rx_ant long, tx_ant int, h array<struct<re:double,im:double>>"
    rows = [(0, 0, 0, 0, [(1.0, 2.0), (3.0, -1.0)]), (0, 0, 1, 0, [(0.5, 0.5)]), (0, 0, 0, 1, [(float("nan"), 1.0)]),
            (0, 0, 1, 1, [(2.0, float("inf"))]), (0, 1, 0, 0, [(0.0, 0.0)]), (0, 2, 0, 0, None)]
    got = {(r.rx, r.i, r.j): complex(r.re, r.im) for r in SP.rx_covariance(spark.createDataFrame(rows, schema), ["tx", "rx"]).collect()}
    a, b = np.array([1 + 2j, 3 - 1j, 1j]), np.array([0.5 + 0.5j, 2])
    assert got[0, 0, 0] == pytest.approx((abs(a) ** 2).mean()) and got[0, 1, 1] == pytest.approx((abs(b) ** 2).mean())
    cross = (a[0] * b[0].conj() + a[2] * b[1].conj()) / 2
    assert got[0, 0, 1] == pytest.approx(cross) and got[0, 1, 0] == pytest.approx(cross.conj()) and len(got) == 4


def greedy(sizes, most, cap):
    out, held, total, batch = [], 0, 0, 0
    for n in sizes:
        if held and (held >= most or total + n > cap):
            batch, held, total = batch + 1, 0, 0
        out.append(batch)
        held, total = held + 1, total + n
    return out


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_batches_cross_blocks(spark, block):
    """Many small blocks, batches that begin anywhere in them, and batches longer than a block."""
    rng = np.random.default_rng(block)
    runs = {"a": rng.integers(0, 9, 150).tolist(), "b": [0] * 40 + [50] + [1] * 30, "c": [99], "d": [3] * 41}
    rows = [(r, 7 * i, int(n)) for r, sizes in runs.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "run string, fragment bigint, ue_count bigint").repartition(5)
    got = SH.training_batches(df, "run", 11, 20, block).orderBy("run", "fragment").collect()
    assert {r: [g.batch for g in got if g.run == r] for r in runs} == {r: greedy(s, 11, 20) for r, s in runs.items()}
    free = SH.training_batches(df, "run", None, 20, block).orderBy("run", "fragment").collect()
    assert {r: [g.batch for g in free if g.run == r] for r in runs} == {r: greedy(s, 10**9, 20) for r, s in runs.items()}


def test_statistics_come_with_the_quantiles(spark):
    rows = [("a", 1.0, True), ("a", 3.0, None), ("a", None, True), ("b", None, False), (None, 2.0, True)]
    df = spark.createDataFrame(rows, "k string, v double, f boolean")
    got = {r.k: (r.rows, r.n, r["sum"], r.min, r.max, r.m, r.yes) for r in quantile_summary(df, ["k"], "v", {"m": 0.5}, {"yes": F.col("f")}).collect()}
    assert got == {"a": (3, 2, 4.0, 1.0, 3.0, 2.0, 2), "b": (1, 0, None, None, None, None, 0), None: (1, 1, 2.0, 2.0, 2.0, 2.0, 1)}
    none = quantile_summary(df.limit(0), [], "v", {"m": 0.5}).collect()
    assert len(none) == 1 and none[0].n == 0 and none[0].m is None
