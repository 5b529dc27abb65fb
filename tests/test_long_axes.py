"""Segmented scans along long axes against numpy and against the one-window operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelspark.operators import long_axes as LX
from channelspark.operators import sequences as Q


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_unwrap_equals_numpy(spark, block):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(scale=2.0, size=500))
    phase = np.angle(np.exp(1j * walk))
    rows = spark.createDataFrame([("a", i, float(p)) for i, p in enumerate(phase)]
                                 + [("b", 3 * i, float(p)) for i, p in enumerate(phase[:40])], "v string, k int, p double")
    got = rows_of(LX.unwrap_phase(rows, ["v"], "p", block=block), "v", "k", "unwrapped")
    want = list(np.unwrap(phase)) + list(np.unwrap(phase[:40]))
    np.testing.assert_allclose([g[2] for g in got], want, atol=1e-9)


@pytest.mark.parametrize("block", [1, 5, 50])
def test_first_cluster_and_interpolation_equal_the_one_window_operators(spark, block):
    rng = np.random.default_rng(5)
    bins = [(v, int(b), float(rng.integers(1, 9))) for v in range(12)
            for b in np.cumsum(rng.integers(1, 6 if v % 2 else 9, size=30))]
    peaks = spark.createDataFrame(bins, "v int, bin int, power double").withColumn("x", F.col("bin") * 2)
    for gap in (3, 5, 8):
        names = ("v", "bin", "power", "x")
        assert rows_of(LX.first_peak_cluster(peaks, ["v"], gap, ["x"], block), *names) == rows_of(
            Q.first_peak_cluster(peaks, ["v"], gap, ["x"]), *names)
    points = spark.createDataFrame([(v, b, p) for v, b, p in bins] + [(0, bins[0][1], 4.0)], "v int, k int, y double")
    got = rows_of(LX.linear_interpolate(points, ["v"], ["y"], 170, block), "v", "k", "y")
    want = rows_of(Q.linear_interpolate(points, ["v"], ["y"], 170), "v", "k", "y")
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want])


def test_one_long_vector_is_spread_over_tasks(spark, request):
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would be put together again
    phase = (F.col("id") * 0.9) % (2 * np.pi) - np.pi
    rows = spark.range(1_000_000).select(F.lit(0).alias("v"), F.col("id").alias("k"), phase.alias("p"))
    done = LX.unwrap_phase(rows, ["v"], "p", block=10_000)
    sizes = [r.n for r in done.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) < 800_000
    slope = done.agg(((F.max_by("unwrapped", "k") - F.min_by("unwrapped", "k")) / 999_999).alias("s")).first().s
    assert slope == pytest.approx(0.9)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "v int, k int, y double")
    assert LX.unwrap_phase(none, ["v"], "y").count() == 0
    assert LX.linear_interpolate(none, ["v"], ["y"], 9).count() == 0
    one = spark.createDataFrame([(1, 5, 2.0)], "v int, k int, y double")
    assert rows_of(LX.linear_interpolate(one, ["v"], ["y"], 9, block=2), "k", "y") == [(k, 2.0) for k in range(9)]


def test_long_axes_of_different_lengths_end_at_their_own_last_sample(spark, tmp_path):
    """A table whose last link lacks antennas: query and SQL give the same rows."""
    import verify
    from channelspark.plans import load_all
    from channelspark.plans.registry import ORACLES, QUERIES

    load_all()
    vectors = spark.range(30).select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(i + F.col("id")).cast("float")).alias("embedding"))
    vectors.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    con = verify.duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    name = "e5_interpolate_long_axis"
    ok, note, _ = verify.compare(spark, con, QUERIES[name], ORACLES[name], str(tmp_path))
    assert ok, note
