"""Nearest neighbours on the tile pyramid: dense spots, outliers, targets outside, bounded pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelspark.operators import nearest as NE

SAMPLES = "s bigint, id bigint, x double, y double, value double"


def scenes(spark, xy_by_scene):
    rows = [(s, i, float(x), float(y), float(i % 7)) for s, xy in xy_by_scene.items() for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, SAMPLES)


def brute(xy, at, k):
    d = np.hypot(xy[:, 0] - at[0], xy[:, 1] - at[1])
    return list(np.lexsort((np.arange(len(d)), d))[:k])


@pytest.fixture(scope="module")
def layouts():
    rng = np.random.default_rng(7)
    return {
        0: rng.uniform(-50, 50, (400, 2)),
        1: np.vstack([rng.normal(3, 1e-4, (3000, 2)), rng.uniform(0, 100, (30, 2)), [[1e4, -1e4]]]),  # dense spot and an outlier
        2: np.array([[1.0, 1.0]]),
        3: np.vstack([np.stack([np.linspace(0, 1, 200), np.zeros(200)], 1), np.stack([np.linspace(0, 1, 200), np.zeros(200)], 1)]),  # a line, twice
        4: np.repeat(np.array([[0.0, 0.0], [5.0, 5.0]]), 20, axis=0),
    }


def test_against_brute_force(spark, layouts):
    rng = np.random.default_rng(8)
    places = {s: np.vstack([rng.uniform(-60, 110, (20, 2)), [[3.0, 3.0], [3.0001, 2.9999], [1e4, -9e3], [-1e6, 1e6], [0.5, 0.0]]]) for s in layouts}
    targets = spark.createDataFrame([(s, i, float(x), float(y)) for s, xy in places.items() for i, (x, y) in enumerate(xy)], "s bigint, t bigint, x double, y double")
    found = NE.nearest(targets, scenes(spark, layouts), scene="s", target=["t"], k=6).collect()
    got = {}
    for row in sorted(found, key=lambda r: r["rank"]):
        got.setdefault((row.s, row.t), []).append(row.id)
    want = {(s, i): brute(layouts[s], at, 6) for s, xy in places.items() for i, at in enumerate(xy)}
    assert got == want


def test_pairs_stay_bounded(spark, layouts):
    """A far target meets the edge of a dense spot, a target inside meets its own part of it."""
    samples = scenes(spark, {1: layouts[1]})
    targets = spark.createDataFrame([(1, 0, -70.0, -70.0), (1, 1, 3.0, 3.0), (1, 2, 3.0, -4000.0)], "s bigint, t bigint, x double, y double")
    box = NE.boxes(samples, "s", 6)
    located = samples.join(box, "s").withColumns({"_ix": NE._cell("x"), "_iy": NE._cell("y")})
    tiles, many = NE.pyramid(located, "s", 6)
    placed = targets.join(box, "s").withColumns({"_ix": NE._cell("x"), "_iy": NE._cell("y"), "_cap": F.lit(NE.DEPTH)})
    asked = NE.candidate_tiles(placed, tiles, many, "s", ["s", "t"], 6)
    pairs = {r.t: r.n for r in asked.groupBy("t").agg(F.sum("_n").alias("n")).collect()}
    assert set(pairs) == {0, 1, 2} and max(pairs.values()) < 12 * NE.crowded(6)


def test_no_samples(spark):
    none = spark.createDataFrame([], SAMPLES)
    targets = spark.createDataFrame([(1, 0, 0.0, 0.0)], "s bigint, t bigint, x double, y double")
    assert NE.knn_idw(targets, none, scene="s", target=["t"], k=3, power=2.0).count() == 0
    odd = spark.createDataFrame([(1, 0, float("nan"), 0.0, 1.0), (1, 1, 2.0, 0.0, float("nan")), (1, 2, 1.0, 0.0, 4.0)], SAMPLES)
    assert NE.knn_idw(targets, odd, scene="s", target=["t"], k=3, power=2.0).first().value == 4.0
