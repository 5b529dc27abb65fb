"""Queries through the registered SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from channelspark.functions.udfs import register_functions, weighted_median
from channelspark.plans import bindings as B
from channelspark.plans.registry import query, r, sr


@query("u1_frequency_grid", f"""SELECT source_scene_index, k,
  {sr('3.5e9::DOUBLE + (k - (bs_count - 1) / 2.0) * (20e6 / bs_count)', 3)} AS f_hz
  FROM (SELECT *, UNNEST(RANGE(bs_count)) AS k FROM fx_scenes) t""", ("fx_scenes",))
def u1(spark, sf):
    register_functions(spark)
    rows = spark.sql(
        "SELECT source_scene_index, g.k, g.f_hz FROM {scenes}, "
        "LATERAL frequency_grid(3.5e9D, 20e6D, bs_count) g", scenes=B.scenes(spark, sf),
    )
    return rows.withColumn("f_hz", r(F.col("f_hz"), 3))


@query("u2_srs_re_grid", """SELECT source_scene_index, s AS symbol,
  UNNEST(RANGE((ue_count % 5) * 12 + 1, LEAST((ue_count % 5 + bs_count + 1) * 12, 240), 4)) AS k
  FROM fx_scenes, (SELECT UNNEST(RANGE(2)) AS s) t""", ("fx_scenes",))
def u2(spark, sf):
    register_functions(spark)
    return spark.sql(
        "SELECT source_scene_index, g.symbol, g.k FROM {scenes}, "
        "LATERAL srs_re_grid(2, ue_count % 5, bs_count + 1, 4, 1, 240) g",
        scenes=B.scenes(spark, sf),
    )


@query("u3_weighted_median", f"""WITH s AS (SELECT vec_id, re, SUM(re * re + im * im) OVER (PARTITION BY vec_id ORDER BY re) AS c,
  SUM(re * re + im * im) OVER (PARTITION BY vec_id) AS t FROM fx_cfr)
  SELECT vec_id, {sr('MIN(re) FILTER (c >= t / 2)')} AS median FROM s GROUP BY vec_id""", ("fx_cfr",))
def u3(spark, sf):
    rows = B.samples(B.cfr(spark, sf)).withColumn("w", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return rows.groupBy("vec_id").agg(r(weighted_median("re", "w")).alias("median"))
