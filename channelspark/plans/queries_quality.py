"""Data-quality queries: each corrupts one field of a derived table and lists the violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from channelspark.functions import paths as P
from channelspark.operators import contracts as CT
from channelspark.operators import links as L
from channelspark.operators import paths as PO
from channelspark.operators import quality as QA
from channelspark.operators import resources as RS
from channelspark.operators import spectrum as SP
from channelspark.plans import bindings as B
from channelspark.plans.queries_links import LINKS
from channelspark.plans.queries_maps import FRAGMENT_SQL, fragments, users
from channelspark.plans.queries_metrics import EVAL_SQL, evaluation
from channelspark.plans.registry import query


def _v(rule: str, table: str, key: str, detail: str, source: str) -> str:
    return f"""SELECT '{rule}' AS rule_id, '{table}' AS "table", CAST({key} AS VARCHAR) AS key,
      CAST({detail} AS VARCHAR) AS detail FROM {source}"""


@query("q1_columns", "WITH n AS (SELECT COUNT(*) FILTER (range_m IS NULL) AS c FROM fx_ranging) "
       + _v("Q1", "ranging", "'snr_db'", "'missing'", "n") + " UNION ALL "
       + _v("Q1", "ranging", "'truth_m'", "'forbidden'", "n") + " UNION ALL "
       + _v("Q1", "ranging", "'range_m'", "'null rows: ' || c", "n"), ("fx_ranging",))
def q1(spark, sf):
    return QA.columns(B.ranging(spark, sf), "ranging", ["estimator", "success", "range_m", "snr_db"],
                      ["truth_m"])


@query("q1_product_columns", "WITH n AS (SELECT COUNT(*) FILTER (range_m IS NULL) AS c FROM fx_ranging) "
       + " UNION ALL ".join(_v("Q1", "ranging", f"'{c}'", "'missing'", "n") for c in ("toa_s", "rtt_s", "error_m"))
       + " UNION ALL " + _v("Q1", "ranging", "'spectrum'", "'forbidden'", "n") + " UNION ALL "
       + _v("Q1", "ranging", "'range_m'", "'null rows: ' || c", "n"), ("fx_ranging",))
def q1_products(spark, sf):
    rows = B.ranging(spark, sf).withColumn("spectrum", F.lit(0.0))
    return QA.product_columns(rows, "ranging", ["ranging"])


@query("q2_increasing_frequency", """WITH l AS (SELECT vec_id, re <= LAG(re) OVER (PARTITION BY vec_id ORDER BY k) AS bad FROM fx_cfr),
  c AS (SELECT vec_id, COUNT(*) FILTER (bad) AS n FROM l GROUP BY vec_id) """
       + _v("Q2", "frequency", "vec_id", "n", "c WHERE n > 0"), ("fx_cfr",))
def q2(spark, sf):
    rows = B.cfr(spark, sf).select("vec_id", F.col("h.re").alias("grid"))
    return QA.increasing(rows, "frequency", ["vec_id"], "grid")


@query("q3_some_finite", _v("Q3", "cfr", "vec_id", "'no finite value'", "(SELECT DISTINCT vec_id FROM fx_cfr WHERE label = 3) t"),
       ("fx_cfr",))
def q3(spark, sf):
    nan = F.when(F.col("label") == 3, F.lit(float("nan"))).otherwise(F.col("re"))
    rows = B.samples(B.cfr(spark, sf)).select("vec_id", nan.alias("re"))
    return QA.some_finite(rows, "cfr", ["vec_id"], "re")


@query("q4_all_finite", f"WITH {EVAL_SQL} "
       + _v("Q4", "evaluation", "'nmse_db'", "COUNT(*)", "ev WHERE rx = 2") + " UNION ALL "
       + _v("Q4", "evaluation", "'corr'", "COUNT(*)", "ev WHERE rx = 3"), ("fx_est",))
def q4(spark, sf):
    ev = evaluation(spark, sf)
    bad = ev.withColumns({
        "nmse_db": F.when(F.col("rx") == 2, F.lit(float("nan"))).otherwise(F.col("nmse_db")),
        "corr": F.when(F.col("rx") != 3, F.col("corr")),
    })
    return QA.all_finite(bad, "evaluation", ["nmse_db", "corr", "phase_err_rad"])


@query("q5_label_values", "WITH p AS (SELECT tx, rx, BOOL_OR(flag = 'A') AS los, BOOL_OR(flag = 'R') AS ok FROM fx_paths GROUP BY ALL) "
       + _v("Q5", "links", "tx || '-' || rx", "'label not finite'", "p WHERE ok AND NOT los"), ("fx_paths",))
def q5(spark, sf):
    labels = PO.link_path_labels(B.paths(spark, sf))
    valid = B.paths(spark, sf).groupBy("tx", "rx").agg(
        F.bool_or(P.path_type(F.col("interactions")) == "mixed").alias("valid")
    )
    return QA.label_values(labels.join(valid, ["tx", "rx"]), ["tx", "rx"], ["first_delay_s"],
                           ["los_distance_m"])


@query("q6_ranging_consistency", "WITH r AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'pdp_peak' ELSE 'phase_slope' END AS estimator, "
       "l_orderkey, l_linenumber, l_discount > 0.01::DOUBLE AS fin, l_discount > 0.01::DOUBLE OR l_quantity = 7 AS ok, "
       "CASE WHEN l_discount > 0.01::DOUBLE THEN 1 ELSE -1 END AS bin FROM lineitem) "
       + _v("Q6", "ranging", "estimator || '-' || l_orderkey || '-' || l_linenumber", "'success flag disagrees'",
            "r WHERE fin <> ok OR (ok AND bin < 0) OR (NOT ok AND bin <> -1)")
       + " UNION ALL " + _v("Q6", "ranging", "'music'", "'default estimator missing'", "(SELECT COUNT(*) FROM r) t"))
def q6(spark, sf):
    return QA.ranging_consistency(_flagged_ranges(spark, sf), ["estimator", "l_orderkey", "l_linenumber"], "music")


def _flagged_ranges(spark, sf):
    """Ranges whose success flag is wrong at some quantities."""
    fin = F.col("l_discount") > 0.01
    return B.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "pdp_peak").otherwise("phase_slope")
        .alias("estimator"), "l_orderkey", "l_linenumber",
        F.when(fin, F.col("l_quantity")).alias("range_m"),
        (fin | (F.col("l_quantity") == 7)).alias("success"),
        F.when(fin, 1).otherwise(-1).alias("delay_bin"),
    )


@query("q7_path_samples", _v("Q7", "paths", "tx || '-' || rx || '-' || path",
                             "CASE WHEN tau_s > 4.95e-8 THEN 'not finite' ELSE 'too few vertices' END",
                             "fx_paths WHERE tau_s > 4.95e-8 OR (flag = 'R' AND rx_ant = 1)"), ("fx_paths",))
def q7(spark, sf):
    return QA.path_samples(_short_paths(spark, sf), ["tx", "rx", "path"], ["tau_s", "a_re"])


def _short_paths(spark, sf):
    """Paths with an infinite delay or a vertex too few here and there."""
    depth = P.path_depth(F.col("interactions"))
    short = (P.path_type(F.col("interactions")) == "mixed") & (F.col("rx_ant") == 1)
    return B.paths(spark, sf).select(
        "tx", "rx", "path", depth.alias("depth"), "a_re",
        (depth + 2 - F.when(short, 1).otherwise(0)).alias("vertex_count"),
        F.when(F.col("tau_s") > 4.95e-8, F.lit(float("inf"))).otherwise(F.col("tau_s")).alias("tau_s"),
    )


@query("q8_shard_indices", f"WITH {FRAGMENT_SQL} "
       + _v("Q8", "shards", "scene_id || '-' || shard_index",
            "CASE WHEN shard_index > 5 THEN 'shard index' ELSE 'length' END",
            "fo WHERE shard_index > 5 OR first_ue % 5 = 2"), ("fx_points",))
def q8(spark, sf):
    rows = fragments(spark, sf)
    wrong = rows.withColumn(
        "ue_count", F.col("ue_count") + F.when(F.col("first_ue") % 5 == 2, 1).otherwise(0)
    )
    planned = rows.select("scene_id").distinct().withColumn("shard_count", F.lit(6))
    limits = users(spark, sf).groupBy("scene_id").agg(
        F.min("ue").alias("first"), F.max("ue").alias("last")
    )
    return QA.shard_indices(wrong, ["scene_id"], planned, limits)


@query("q9_bundle_offsets", f"WITH {FRAGMENT_SQL}, t AS (SELECT scene_id, SUM(ue_count) AS n FROM fo GROUP BY scene_id) "
       + _v("Q9", "bundle", "scene_id || '-' || shard_index", "'offset gap'",
            "fo WHERE scene_id % 4 = 2 AND shard_index = 1") + " UNION ALL "
       + _v("Q9", "bundle", "scene_id || '-' || shard_index", "'offset gap'",
            "fo WHERE scene_id % 4 = 2 AND shard_index = 2") + " UNION ALL "
       + _v("Q9", "bundle", "scene_id", "'total differs'", "t WHERE n <> 105"), ("fx_points",))
def q9(spark, sf):
    moved = F.when((F.col("scene_id") % 4 == 2) & (F.col("shard_index") == 1), 3).otherwise(0)
    rows = fragments(spark, sf).withColumn("offset", F.col("offset") + moved)
    totals = rows.select("scene_id").distinct().withColumn("total", F.lit(B.UE_PER_SCENE))
    return QA.bundle_offsets(rows, ["scene_id"], totals)


@query("q10_multiuser_slots", "WITH u AS (SELECT scene_id, idx, ROW_NUMBER() OVER (PARTITION BY scene_id ORDER BY idx) - 1 AS n "
       "FROM fx_points WHERE role = 'ue') "
       + _v("Q10", "frames", "scene_id || '-' || n // 4 || '-' || n % 4", "'slot index'", "u WHERE idx % 50 = 7"), ("fx_points",))
def q10(spark, sf):
    rows = users(spark, sf).select("scene_id", F.col("ue").alias("tx"))
    slots = RS.frame_slots(rows, 4, ["scene_id"]).select(
        "scene_id", "frame", "slot", (F.col("tx") >= 0).alias("active"),
        F.when(F.col("tx") % 50 == 7, F.lit(-5)).otherwise(F.col("tx")).alias("tx"),
    )
    top = users(spark, sf).groupBy("scene_id").agg((F.max("ue") + 1).alias("tx_count"))
    return QA.multiuser_slots(slots.join(top, "scene_id"), ["scene_id"], F.col("tx_count"))


@query("q10_collision_mask", """WITH u AS (SELECT scene_id, idx AS tx, ROW_NUMBER() OVER (PARTITION BY scene_id ORDER BY idx) - 1 AS n
  FROM fx_points WHERE role = 'ue'),
  e AS (SELECT scene_id, n // 6 AS frame, s AS symbol, UNNEST(RANGE(tx % 4, 24, 4)) AS k FROM u, (SELECT UNNEST([0, 1]) AS s) t),
  o AS (SELECT scene_id, frame, symbol, k, COUNT(*) AS n FROM e GROUP BY ALL) """
       + _v("Q10", "occupancy", "scene_id || '-' || frame || '-' || symbol || '-' || k", "'collision flag'",
            "o WHERE n > 1 AND k = 5"), ("fx_points",))
def q10_mask(spark, sf):
    from channelspark.plans.queries_sequences import _elements

    occupancy = RS.resource_occupancy(_elements(spark, sf), ["scene_id"])
    wrong = occupancy.withColumn("collision", F.col("collision") & (F.col("k") != 5))
    return QA.collision_mask(wrong, ["scene_id"])


@query("q11_iq_layout", "WITH c AS (SELECT source_scene_index, ue_count // 10 AS fft, bs_count - 2 AS cp, bs_count AS sym, "
       "bs_count * (ue_count // 10 + bs_count - 2) + CASE WHEN bs_count = 5 THEN 1 ELSE 0 END AS n FROM fx_scenes) "
       + _v("Q11", "iq", "source_scene_index", "CASE WHEN fft < 2 OR cp < 0 OR sym < 1 THEN 'sizes' ELSE 'sample count' END",
            "c WHERE fft < 2 OR cp < 0 OR sym < 1 OR n <> sym * (fft + cp)"), ("fx_scenes",))
def q11(spark, sf):
    fft, cp, symbols = F.expr("ue_count div 10"), F.col("bs_count") - 2, F.col("bs_count")
    extra = F.when(F.col("bs_count") == 5, 1).otherwise(0)
    rows = B.scenes(spark, sf).select(
        "source_scene_index", fft.alias("fft"), cp.alias("cp"), symbols.alias("symbols"),
        (symbols * (fft + cp) + extra).alias("sample_count"),
    )
    return QA.iq_layout(rows, ["source_scene_index"])


@query("q12_block_errors", "WITH c AS (SELECT worker, COUNT(*) FILTER (stage = 'error') AS e, COUNT(*) AS n FROM fx_perf GROUP BY worker) "
       + _v("Q12", "evaluation", "worker", "CASE WHEN worker % 6 = 1 THEN 'counts' ELSE 'rate' END",
            "c WHERE worker % 6 = 1 OR (worker % 6 = 2 AND e > 0)"), ("fx_perf",))
def q12(spark, sf):
    counts = B.perf(spark, sf).groupBy("worker").agg(
        F.count_if(F.col("stage") == "error").alias("errors"), F.count(F.lit(1)).alias("blocks")
    )
    rows = counts.select(
        "worker",
        F.when(F.col("worker") % 6 == 1, F.col("blocks") + 1).otherwise(F.col("errors"))
        .alias("errors"), "blocks",
        (F.col("errors") / F.col("blocks") * F.when(F.col("worker") % 6 == 2, 1.1).otherwise(1.0))
        .alias("rate"),
    )
    return QA.block_errors(rows, ["worker"])


@query("q13_spectrum_axes", "WITH l AS (SELECT DISTINCT tx, rx FROM fx_cfr WHERE rx = 1) "
       + _v("Q13", "array", "tx || '-' || rx", "72", "l"), ("fx_cfr",))
def q13(spark, sf):
    from channelspark.plans.queries_sequences import ANGLES, LAYOUT, LINK

    cov = SP.rx_covariance(B.cfr(spark, sf), LINK)
    rows = SP.spectrum_rows(SP.bartlett_spectrum(cov, LINK, LAYOUT, ANGLES), LINK, ANGLES)
    cut = rows.where((F.col("rx") != 1) | (F.col("zenith_idx") != 8))
    return QA.rows_per_key(cut, "array", LINK, ANGLES.zenith[2] * ANGLES.azimuth[2], "Q13",
                           B.cfr(spark, sf).select(*LINK))


@query("q14_link_table", f"WITH {LINKS}, n AS (SELECT scene_id, COUNT(*) AS n, COUNT(*) FILTER (tx % 100 = 3 AND rx % 7 = 2) AS d FROM lk GROUP BY scene_id) "
       + _v("Q14", "links", "scene_id", "n - d", "n WHERE d > 0") + " UNION ALL "
       + _v("Q14", "links", "'bearing_rad'", "'unit missing'", "(SELECT COUNT(*) FROM lk) t"), ("fx_points",))
def q14(spark, sf):
    points = B.points(spark, sf)
    links = L.link_geometry(L.build_links(points)).withMetadata("distance_m", {"unit": "m"})
    kept = links.where(~((F.col("tx") % 100 == 3) & (F.col("rx") % 7 == 2)))
    return QA.link_table(kept, points, ["distance_m", "bearing_rad"])


@query("q15_axis_shapes", "WITH c AS (SELECT tx, rx, COUNT(*) AS n FROM fx_est WHERE NOT (vec_id % 50 = 9 AND k > 20) GROUP BY ALL) "
       + _v("Q15", "cfr", "tx || '-' || rx", "n", "c WHERE n <> 128"), ("fx_est",))
def q15(spark, sf):
    rows = B.samples(B.cfr_est(spark, sf).select("vec_id", "tx", "rx", "h"))
    cut = rows.where(~((F.col("vec_id") % 50 == 9) & (F.col("k") > 20)))
    return QA.rows_per_key(cut, "cfr", ["tx", "rx"], 4 * B.SUBCARRIERS, axis=B.cfr_est(spark, sf))


@query("q_ranging_contract", "WITH r AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'pdp_peak' ELSE 'phase_slope' END AS estimator, "
       "l_orderkey, l_linenumber, l_discount > 0.01::DOUBLE AS fin, l_discount > 0.01::DOUBLE OR l_quantity = 7 AS ok FROM lineitem), "
       "n AS (SELECT COUNT(*) FILTER (NOT fin) AS c FROM r) "
       + _v("Q1", "ranging", "'snr_db'", "'missing'", "n") + " UNION ALL "
       + _v("Q1", "ranging", "'success'", "'forbidden'", "n") + " UNION ALL "
       + _v("Q1", "ranging", "'range_m'", "'null rows: ' || c", "n WHERE c > 0") + " UNION ALL "
       + _v("Q4", "ranging", "'range_m'", "c", "n WHERE c > 0") + " UNION ALL "
       + _v("Q6", "ranging", "estimator || '-' || l_orderkey || '-' || l_linenumber", "'success flag disagrees'",
            "r WHERE fin <> ok") + " UNION ALL "
       + _v("Q6", "ranging", "'music'", "'default estimator missing'", "n") + " UNION ALL "
       + _v("Q14", "ranging", "'range_m'", "'unit missing'", "n") + " UNION ALL "
       + _v("Q15", "ranging", "estimator", "COUNT(*)", "r GROUP BY estimator HAVING COUNT(*) <> 1000"))
def ranging_contract(spark, sf):
    keys = ("estimator", "l_orderkey", "l_linenumber")
    return CT.violations(_flagged_ranges(spark, sf), CT.Contract(
        "ranging", required=["estimator", "range_m", "snr_db"], forbidden=["success", "truth_m"],
        units=["range_m"], finite=["range_m", "delay_bin"], rows=[QA.ranging_rule(keys)],
        values=[("Q6", "estimator", "music", "default estimator missing"),
                ("Q6", "estimator", "pdp_peak", "default estimator missing")],
        sizes=[CT.Size("Q15", ("estimator",), 1000)]))


@query("q_response_contract", """WITH e AS (SELECT *, label = 3 AS bad FROM fx_est WHERE NOT (vec_id % 50 = 9 AND k > 20)),
  c AS (SELECT tx, rx, COUNT(*) AS n FROM e GROUP BY ALL), t AS (SELECT COUNT(*) AS n FROM e WHERE bad) """
       + _v("Q3", "cfr", "vec_id", "'no finite value'", "(SELECT DISTINCT vec_id FROM e WHERE bad) t") + " UNION ALL "
       + _v("Q4", "cfr", "'re'", "n", "t WHERE n > 0") + " UNION ALL "
       + _v("Q15", "cfr", "tx || '-' || rx", "n", "c WHERE n <> 128"), ("fx_est",))
def response_contract(spark, sf):
    """Samples with infinite values and short vectors: rules per row, column, vector and link at once."""
    rows = B.samples(B.cfr_est(spark, sf).select("vec_id", "tx", "rx", "label", "h"))
    cut = rows.where(~((F.col("vec_id") % 50 == 9) & (F.col("k") > 20))).withColumn(
        "re", F.when(F.col("label") == 3, F.lit(float("nan"))).otherwise(F.col("re")))
    return CT.violations(cut, CT.Contract(
        "cfr", required=["vec_id", "k"], finite=["re", "im"], some_finite=[(("vec_id",), "re")],
        sizes=[CT.Size("Q15", ("tx", "rx"), 4 * B.SUBCARRIERS, B.cfr_est(spark, sf))]))


@query("q_path_contract", "WITH n AS (SELECT tx, rx, COUNT(*) AS n FROM fx_paths GROUP BY ALL) "
       + _v("Q7", "paths", "tx || '-' || rx || '-' || path",
            "CASE WHEN tau_s > 4.95e-8 THEN 'not finite' ELSE 'too few vertices' END",
            "fx_paths WHERE tau_s > 4.95e-8 OR (flag = 'R' AND rx_ant = 1)") + " UNION ALL "
       + _v("Q4", "paths", "'tau_s'", "c", "(SELECT COUNT(*) AS c FROM fx_paths WHERE tau_s > 4.95e-8) t WHERE c > 0")
       + " UNION ALL " + _v("Q15", "paths", "tx || '-' || rx", "n", "n WHERE n <> 4"), ("fx_paths",))
def path_contract(spark, sf):
    return CT.violations(_short_paths(spark, sf), CT.Contract(
        "paths", required=["tx", "rx", "path"], forbidden=["power_db"], finite=["tau_s", "a_re"],
        rows=[QA.path_rule(("tx", "rx", "path"), ["tau_s", "a_re"])],
        sizes=[CT.Size("Q15", ("tx", "rx"), 4)]))
