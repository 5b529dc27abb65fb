"""Queries over channel estimates: error metrics, similarity, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.operators import cfr as K
from channelspark.operators import summaries as S
from channelspark.plans import bindings as B
from channelspark.plans.registry import query, r, sr

EVAL_SQL = """sums AS (SELECT tx, rx, SUM(re * re + im * im) AS s, SUM(ere * ere + eim * eim) AS e,
  SUM(POW(ere - re, 2) + POW(eim - im, 2)) AS d, AVG(SQRT(POW(ere - re, 2) + POW(eim - im, 2))) AS ad,
  AVG(ATAN2(eim * re - ere * im, ere * re + eim * im)) AS ph, SUM(ere * re + eim * im) AS cr,
  SUM(eim * re - ere * im) AS ci, BOOL_AND(label <> 3) AS valid FROM fx_est GROUP BY tx, rx),
  ev AS (SELECT tx, rx, valid,
  CASE WHEN valid THEN 10 * LOG10(GREATEST(d / GREATEST(s, 1e-30::DOUBLE), 1e-30::DOUBLE)) ELSE 0 END AS nmse_db,
  CASE WHEN valid THEN 20 * LOG10(GREATEST(ad, 1e-30::DOUBLE)) ELSE 0 END AS amp_err_db,
  CASE WHEN valid THEN ph ELSE 0 END AS phase_err_rad,
  CASE WHEN valid THEN SQRT(cr * cr + ci * ci) / GREATEST(SQRT(s) * SQRT(e), 1e-30::DOUBLE) ELSE 0 END AS corr,
  CASE WHEN d > 0 THEN 10 * LOG10(s / d) END AS snr_db FROM sums)"""
PAIR_SQL = """pr AS (SELECT a.tx, a.rx, a.rx_ant, a.k, a.re AS lre, a.im AS lim, b.re AS rre, b.im AS rim FROM fx_cfr a
  JOIN fx_cfr b ON b.vec_id = (a.vec_id + 1) % (SELECT MAX(vec_id) + 1 FROM embeddings) AND a.k = b.k)"""


def sim_sql(source: str, keys: str) -> str:
    """SELECT of the four similarities by ``keys`` (a GROUP BY list)."""
    def l2(left: str, right: str) -> str:
        return f"1 - SQRT(SUM(POW({left} - {right}, 2))) / (SQRT(SUM(POW({left}, 2))) + SQRT(SUM(POW({right}, 2))))"

    lm, rm = "SQRT(lre * lre + lim * lim)", "SQRT(rre * rre + rim * rim)"
    score = "(0.5 * (1 + COS(ATAN2(rim * lre - rre * lim, rre * lre + rim * lim))))"
    weight = f"SQRT({lm} * {rm})"
    phase = f"SUM({weight} * {score}) / SUM({weight})"
    cols = {"magnitude": l2(lm, rm), "phase": phase, "i": l2("lre", "rre"), "q": l2("lim", "rim")}
    out = ", ".join(f"LEAST(GREATEST({e}, 0), 1) AS {n}" for n, e in cols.items())
    group = keys if keys.upper().startswith("GROUPING") else keys
    names = keys if not keys.upper().startswith("GROUPING") else "tx, rx"
    return f"SELECT {names}, {out} FROM {source} GROUP BY {group}"


def rounded(names) -> str:
    return ", ".join(f"{sr(n)} AS {n}" for n in names)


M = K.METRICS
SIM_COLS = rounded(M)


def evaluation(spark, sf):
    pairs = B.cfr_est(spark, sf).withColumn("valid", F.col("label") != 3)
    return K.cfr_metrics(pairs, ["tx", "rx"], valid="valid")


def run_pairs(spark, sf):
    left = B.cfr(spark, sf)
    right = left.select(B.previous(left).alias("vec_id"), F.col("h").alias("r"))
    return left.join(right, "vec_id")


def run_samples(spark, sf, keys=("tx", "rx")):
    return K.paired_samples(run_pairs(spark, sf), list(keys), "h", "r")


def per_station(spark, sf):
    return K.similarity(run_samples(spark, sf), ["tx", "rx"])


def long_metrics(spark, sf):
    table = per_station(spark, sf).withColumn("comparison", F.col("rx") % 2)
    return S.unpivot_metrics(table, ["tx", "rx", "comparison"], M)


LONG_SQL = f"""{PAIR_SQL}, ps AS ({sim_sql('pr', 'tx, rx')}),
  lg AS (UNPIVOT (SELECT *, rx % 2 AS comparison FROM ps) ON magnitude, phase, i, q INTO NAME metric VALUE value)"""


@query("d6_cfr_metrics", f"""WITH {EVAL_SQL} SELECT tx, rx, valid,
  {rounded(['nmse_db', 'amp_err_db', 'phase_err_rad', 'corr'])} FROM ev""", ("fx_est",))
def d6(spark, sf):
    names = ["nmse_db", "amp_err_db", "phase_err_rad", "corr"]
    return evaluation(spark, sf).select(
        "tx", "rx", "valid", *[r(F.col(n)).alias(n) for n in names]
    )


@query("d7_similarity_l2", f"WITH {PAIR_SQL}, s AS ({sim_sql('pr', 'GROUPING SETS ((tx), (tx, rx))')}) "
       f"SELECT tx, rx, {rounded(['magnitude', 'i', 'q'])} FROM s", ("fx_cfr",))
def d7(spark, sf):
    out = K.similarity_levels(run_samples(spark, sf), ["tx"], ["rx"])
    return out.select("tx", "rx", *[r(F.col(m)).alias(m) for m in ("magnitude", "i", "q")])


@query("d8_similarity_phase", f"WITH {PAIR_SQL}, s AS ({sim_sql('pr', 'tx, rx')}) "
       f"SELECT tx, rx, {sr('phase')} AS phase FROM s", ("fx_cfr",))
def d8(spark, sf):
    return per_station(spark, sf).select("tx", "rx", r(F.col("phase")).alias("phase"))


@query("d9_bs_mean", f"WITH {PAIR_SQL}, s AS ({sim_sql('pr', 'tx, rx')}) SELECT tx, "
       + ", ".join(f"{sr(f'AVG({m})')} AS {m}" for m in M) + " FROM s GROUP BY tx", ("fx_cfr",))
def d9(spark, sf):
    return K.station_mean(per_station(spark, sf), ["tx"]).select(
        "tx", *[r(F.col(m)).alias(m) for m in M]
    )


@query("c3_pair_shards", f"""WITH a AS (SELECT * FROM fx_cfr WHERE label <> 3),
  b AS (SELECT vec_id - 1 AS vec_id, k, re, im, (vec_id - 1) // 20 AS tx, (vec_id - 1) // 4 % 5 AS rx FROM fx_cfr WHERE label <> 5),
  j AS (SELECT COALESCE(a.tx, b.tx) AS tx, COALESCE(a.rx, b.rx) AS rx, a.re AS lre, a.im AS lim, b.re AS rre, b.im AS rim,
  a.vec_id IS NOT NULL AS l, b.vec_id IS NOT NULL AS r FROM a FULL JOIN b ON a.vec_id = b.vec_id AND a.k = b.k),
  p AS (SELECT tx, rx, BOOL_OR(l) AS in_left, BOOL_OR(r) AS in_right FROM j GROUP BY tx, rx),
  bo AS (SELECT * FROM j WHERE l AND r), s AS ({sim_sql('bo', 'tx, rx')})
  SELECT p.tx, p.rx, in_left, in_right, """ + ", ".join(
      f"CASE WHEN in_left AND in_right THEN {sr(m)} ELSE 0.0 END AS {m}" for m in M)
       + " FROM p LEFT JOIN s USING (tx, rx)", ("fx_cfr",))
def c3(spark, sf):
    rows = B.cfr(spark, sf)
    left = rows.where("label <> 3").select("vec_id", "h")
    right = rows.where("label <> 5").select((F.col("vec_id") - 1).alias("vec_id"), "h")

    def keyed(df):
        return df.withColumns({"tx": F.expr("vec_id div 20"), "rx": F.expr("vec_id div 4 % 5")})

    out = K.pair_shards(keyed(left), keyed(right), ["tx", "rx"], ["vec_id", "tx", "rx"])
    return out.select("tx", "rx", "in_left", "in_right", *[r(F.col(m)).alias(m) for m in M])


@query("d10_metric_summary", f"""WITH {LONG_SQL} SELECT comparison, metric, COUNT(value) AS finite_count,
  {sr('MIN(value)')} AS min, {sr('MEDIAN(value)')} AS median, {sr('AVG(value)')} AS mean, {sr('MAX(value)')} AS max
  FROM lg GROUP BY comparison, metric""", ("fx_cfr",))
def d10(spark, sf):
    out = S.metric_summary(long_metrics(spark, sf), ["comparison", "metric"])
    return out.select("comparison", "metric", "finite_count",
                      *[r(F.col(n)).alias(n) for n in ("min", "median", "mean", "max")])


@query("d11_ranging_summary", f"""WITH e AS (SELECT *, CASE WHEN success THEN ABS(range_m - truth_m) END AS e FROM fx_ranging)
  SELECT estimator, COUNT(*) AS total, COUNT(*) FILTER (success) AS successes,
  {sr('COUNT(e)::DOUBLE / COUNT(*)')} AS finite_rate, {sr('AVG(e)')} AS mean_abs_m,
  {sr('QUANTILE_CONT(e, 0.5)')} AS median_abs_m, {sr('QUANTILE_CONT(e, 0.8)')} AS p80_abs_m,
  {sr('QUANTILE_CONT(e, 0.95)')} AS p95_abs_m FROM e GROUP BY estimator""", ("fx_ranging",))
def d11(spark, sf):
    names = ["finite_rate", "mean_abs_m", "median_abs_m", "p80_abs_m", "p95_abs_m"]
    return S.ranging_summary(B.ranging(spark, sf)).select(
        "estimator", "total", "successes", *[r(F.col(n)).alias(n) for n in names]
    )


@query("d39_estimator_vs_truth", f"""SELECT estimator, {sr('truth_m')} AS truth_m, {sr('range_m')} AS range_m,
  {sr('range_m - truth_m')} AS error_m FROM fx_ranging WHERE success""", ("fx_ranging",))
def d39(spark, sf):
    return S.estimator_vs_truth(B.ranging(spark, sf)).select(
        "estimator", *[r(F.col(n)).alias(n) for n in ("truth_m", "range_m", "error_m")]
    )


@query("b27_histogram_bin", f"""WITH e AS (SELECT estimator, range_m - truth_m AS e FROM fx_ranging WHERE success),
  x AS (SELECT estimator, MIN(e) AS lo, MAX(e) AS hi FROM e GROUP BY estimator)
  SELECT estimator, CASE WHEN hi > lo THEN CAST(LEAST(FLOOR((e - lo) / (hi - lo) * 50), 49) AS BIGINT) ELSE 0 END AS bin,
  {sr('lo')} AS lo, {sr('hi')} AS hi, COUNT(*) AS n FROM e JOIN x USING (estimator) GROUP BY ALL""", ("fx_ranging",))
def b27(spark, sf):
    rows = S.estimator_vs_truth(B.ranging(spark, sf))
    return S.histogram(rows, ["estimator"], "error_m", 50).withColumns({n: r(F.col(n)) for n in ("lo", "hi")})


@query("d12_diagnostics_report", f"""WITH {EVAL_SQL}, w AS (SELECT tx, rx, nmse_db FROM ev ORDER BY nmse_db DESC, tx, rx LIMIT 1)
  SELECT COUNT(*) AS num_links, COUNT(*) FILTER (NOT valid) AS num_failed_links,
  {sr('AVG(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0 END)')} AS detection_rate,
  {sr('1 - AVG(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0 END)')} AS failure_rate,
  (SELECT tx FROM w) AS worst_tx, (SELECT rx FROM w) AS worst_rx, (SELECT {sr('nmse_db')} FROM w) AS worst_nmse_db,
  {sr('MEDIAN(nmse_db) FILTER (valid)')} AS median_nmse_db, {sr('MEDIAN(snr_db) FILTER (valid)')} AS median_snr_db,
  {sr('MEDIAN(ABS(phase_err_rad)) FILTER (valid)')} AS median_phase_error_rad FROM ev""", ("fx_est",))
def d12(spark, sf):
    names = ["detection_rate", "failure_rate", "worst_nmse_db", "median_nmse_db",
             "median_snr_db", "median_phase_error_rad"]
    out = S.diagnostics_report(evaluation(spark, sf), ["tx", "rx"])
    return out.select("num_links", "num_failed_links", "worst_tx", "worst_rx",
                      *[r(F.col(n)).alias(n) for n in names])


@query("d13_run_compare_summary", f"""WITH {EVAL_SQL}, f AS (SELECT rx AS run, tx % 5 AS file,
  COUNT(*) AS links, COUNT(*) FILTER (valid) AS ok, MEDIAN(nmse_db) AS med, QUANTILE_CONT(nmse_db, 0.95) AS p95
  FROM ev GROUP BY 1, 2)
  SELECT run, COUNT(*) AS file_count, SUM(links)::BIGINT AS link_count,
  CASE WHEN run % 2 = 0 THEN 'std_a,std_b' ELSE 'std_c' END AS standards,
  CASE WHEN run % 2 = 0 THEN 'full,none' ELSE 'none' END AS spectra, {sr('SUM(ok)::DOUBLE / SUM(links)')} AS valid_rate,
  {sr('MEDIAN(med)')} AS median_nmse_db, {sr('QUANTILE_CONT(p95, 0.95)')} AS p95_nmse_db FROM f GROUP BY run""",
       ("fx_est",))
def d13(spark, sf):
    standard = F.when(F.col("rx") % 2 == 1, "std_c").when(F.col("tx") % 2 == 0, "std_a").otherwise(
        "std_b")
    rows = evaluation(spark, sf).select(
        F.col("rx").alias("run"), (F.col("tx") % 5).alias("file"), standard.alias("standard"),
        F.when((F.col("rx") % 2 == 0) & (F.col("tx") % 2 == 1), "full").otherwise("none").alias("spectrum"),
        "nmse_db", "valid",
    )
    return S.run_compare_summary(rows).select(
        "run", "file_count", "link_count", F.concat_ws(",", "standards").alias("standards"),
        F.concat_ws(",", "spectra").alias("spectra"),
        *[r(F.col(n)).alias(n) for n in ("valid_rate", "median_nmse_db", "p95_nmse_db")],
    )


@query("d14_variant_metrics", f"""WITH p AS (SELECT a.rx_ant AS reference, b.rx_ant AS candidate, a.re AS lre, a.im AS lim,
  b.re AS rre, b.im AS rim FROM fx_cfr a JOIN fx_cfr b ON a.tx = b.tx AND a.rx = b.rx AND a.k = b.k AND a.rx_ant <> b.rx_ant),
  q AS (SELECT *, lre * lre + lim * lim AS l2, rre * rre + rim * rim AS r2, rre * lre + rim * lim AS cr,
  rim * lre - rre * lim AS ci FROM p)
  SELECT reference, candidate, COUNT(*) AS sample_count,
  {sr('10 * LOG10(GREATEST(SUM(POW(rre - lre, 2) + POW(rim - lim, 2)) / GREATEST(SUM(l2), 1e-30::DOUBLE), 1e-30::DOUBLE))')} AS nmse_db,
  {sr('SQRT(POW(SUM(cr), 2) + POW(SUM(ci), 2)) / GREATEST(SQRT(SUM(l2) * SUM(r2)), 1e-30::DOUBLE)')} AS correlation,
  {sr('AVG(ABS(20 * LOG10(SQRT(r2) + 1e-30::DOUBLE) - 20 * LOG10(SQRT(l2) + 1e-30::DOUBLE)))')} AS magnitude_mae_db,
  {sr('AVG(ABS(ATAN2(ci, cr)))')} AS phase_mae_rad, {sr('SQRT(AVG(POW(ATAN2(ci, cr), 2)))')} AS phase_rmse_rad
  FROM q GROUP BY reference, candidate""", ("fx_cfr",))
def d14(spark, sf):
    from channelspark.operators.links import pairwise_variants

    rows = B.cfr(spark, sf).select("tx", "rx", "rx_ant", "h")
    pairs = pairwise_variants(rows, ["tx", "rx"], ["h"], "rx_ant")
    samples = K.paired_samples(pairs, ["reference", "candidate"], "ref_h", "cand_h")
    names = ["nmse_db", "correlation", "magnitude_mae_db", "phase_mae_rad", "phase_rmse_rad"]
    return K.variant_metrics(samples, ["reference", "candidate"]).select(
        "reference", "candidate", "sample_count", *[r(F.col(n)).alias(n) for n in names]
    )


_RES_SQL = f"""e AS (SELECT rx_ant AS file, re * re + im * im AS l2, ere * ere + eim * eim AS r2,
  POW(ere - re, 2) + POW(eim - im, 2) AS er FROM fx_est),
  n AS (SELECT *, 10 * LOG10(GREATEST(er / GREATEST(l2, 1e-30::DOUBLE), 1e-30::DOUBLE)) AS nmse FROM e),
  f AS (SELECT file, COUNT(*) AS re_count, COUNT(*) FILTER (r2 > 0) AS nonzero_count, AVG(nmse) AS nmse_mean_db,
  MEDIAN(nmse) AS nmse_median_db, AVG(SQRT(er)) AS abs_error_mean, MAX(SQRT(er)) AS abs_error_max,
  BOOL_OR(r2 > 0) AS estimate_nonzero, MIN(r2) AS power_min, AVG(r2) AS power_mean, MAX(r2) AS power_max
  FROM n GROUP BY file)"""
_RES_NUM = ["nmse_mean_db", "nmse_median_db", "abs_error_mean", "abs_error_max", "power_min",
            "power_mean", "power_max"]


def resource_files(spark, sf):
    pairs = B.cfr_est(spark, sf).withColumn("file", F.col("rx_ant"))
    return S.resource_summary(K.paired_samples(pairs, ["file"], "h", "est"), ["file"])


@query("d15_resource_summary", f"""WITH {_RES_SQL} SELECT file, re_count, nonzero_count, estimate_nonzero, {rounded(_RES_NUM)}
  FROM f""", ("fx_est",))
def d15(spark, sf):
    return resource_files(spark, sf).select(
        "file", "re_count", "nonzero_count", "estimate_nonzero",
        *[r(F.col(n)).alias(n) for n in _RES_NUM],
    )


@query("d15_resource_total", f"""WITH {_RES_SQL} SELECT COUNT(*) AS files, SUM(re_count)::BIGINT AS re_count,
  BOOL_AND(estimate_nonzero) AS all_nonzero, {sr('AVG(nmse_mean_db)')} AS nmse_mean_db,
  {sr('MAX(abs_error_max)')} AS abs_error_max FROM f""", ("fx_est",))
def d15_total(spark, sf):
    out = S.resource_total(resource_files(spark, sf))
    return out.withColumns({n: r(F.col(n)) for n in ("nmse_mean_db", "abs_error_max")})


@query("d24_block_error_rate", f"""SELECT worker, CAST(COUNT(*) FILTER (stage = 'error') AS BIGINT) AS errors,
  COUNT(*) AS total, {sr("COUNT(*) FILTER (stage = 'error')::DOUBLE / COUNT(*)")} AS rate FROM fx_perf GROUP BY worker""",
       ("fx_perf",))
def d24(spark, sf):
    rows = B.perf(spark, sf).select(
        "worker", (F.col("stage") == "error").cast("bigint").alias("errors"),
        F.lit(1).cast("bigint").alias("blocks"),
    )
    out = S.block_error_rate(rows, ["worker"], "errors", "blocks")
    return out.withColumn("rate", r(F.col("rate")))


@query("d42_nmse_vs_snr", f"""WITH {EVAL_SQL} SELECT tx, rx, {sr('snr_db')} AS snr_db, {sr('nmse_db')} AS nmse_db FROM ev
  WHERE snr_db IS NOT NULL""", ("fx_est",))
def d42(spark, sf):
    return S.nmse_vs_snr(evaluation(spark, sf), ["tx", "rx"]).select(
        "tx", "rx", r(F.col("snr_db")).alias("snr_db"), r(F.col("nmse_db")).alias("nmse_db")
    )


@query("d42_nmse_histogram", f"""WITH {EVAL_SQL}, v AS (SELECT nmse_db FROM ev WHERE nmse_db IS NOT NULL AND snr_db IS NOT NULL),
  x AS (SELECT MIN(nmse_db) AS lo, MAX(nmse_db) AS hi FROM v)
  SELECT CASE WHEN hi > lo THEN CAST(LEAST(FLOOR((nmse_db - lo) / (hi - lo) * 40), 39) AS BIGINT) ELSE 0 END AS bin,
  {sr('lo')} AS lo, {sr('hi')} AS hi, COUNT(*) AS n FROM v, x GROUP BY ALL""", ("fx_est",))
def d42_histogram(spark, sf):
    rows = S.nmse_vs_snr(evaluation(spark, sf), [])
    return S.histogram(rows, [], "nmse_db", 40).withColumns({n: r(F.col(n)) for n in ("lo", "hi")})


@query("f5_worst_link", f"""WITH {EVAL_SQL} SELECT tx, rx, {sr('nmse_db')} AS nmse_db FROM ev
  ORDER BY ev.nmse_db DESC, tx, rx LIMIT 1""", ("fx_est",))
def f5(spark, sf):
    ev = evaluation(spark, sf)
    return ev.agg(S.worst_link(ev, ["tx", "rx"]).alias("w")).select(
        "w.tx", "w.rx", r(F.col("w.nmse_db")).alias("nmse_db")
    )


@query("b17_drop_metric_zeros", f"""SELECT tx, rx, rx_ant, COUNT(CASE WHEN re > 0 THEN re END) AS kept,
  {sr('SUM(CASE WHEN re > 0 THEN re END)')} AS total FROM fx_cfr GROUP BY ALL""", ("fx_cfr",))
def b17(spark, sf):
    rows = S.drop_metric_zeros(B.samples(B.cfr(spark, sf)), ["re"])
    return rows.groupBy("tx", "rx", "rx_ant").agg(
        F.count("re").alias("kept"), r(F.sum("re")).alias("total")
    )


@query("b17_count_metric_zeros", "SELECT COUNT(*) FILTER (re <= 0) AS re, COUNT(*) FILTER (im <= 0) AS im FROM fx_cfr",
       ("fx_cfr",))
def b17_counts(spark, sf):
    return S.count_metric_zeros(B.samples(B.cfr(spark, sf)), ["re", "im"])


_NORM = """CASE WHEN MAX(value) OVER ({w}) > MIN(value) OVER ({w}) THEN (value - MIN(value) OVER ({w}))
  / (MAX(value) OVER ({w}) - MIN(value) OVER ({w})) ELSE 1.0 END"""


def _normalize(scope, window):
    sql = f"WITH {LONG_SQL} SELECT tx, rx, metric, {sr(_NORM.format(w=window))} AS normalized FROM lg"

    @query(f"b18_normalize_{scope}", sql, ("fx_cfr",))
    def run(spark, sf):
        out = S.normalize_minmax(long_metrics(spark, sf), scope)
        return out.select("tx", "rx", "metric", r(F.col("normalized")).alias("normalized"))


_normalize("per_metric_global", "PARTITION BY metric")
_normalize("all_metrics_global", "")
_normalize("per_comparison_metric", "PARTITION BY comparison, metric")


@query("b19_sanitize_nan", f"""WITH d AS (SELECT vec_id, k, re / NULLIF(ROUND(im, 1), 0) AS q FROM fx_cfr)
  SELECT vec_id, COUNT(q) AS finite, {sr('SUM(COALESCE(q, 0))')} AS total FROM d GROUP BY vec_id""", ("fx_cfr",))
def b19(spark, sf):
    im = F.round("im", 1)
    nan = F.when(im == 0, F.lit(float("nan"))).otherwise(F.col("re") / F.nullif(im, F.lit(0.0)))
    rows = B.samples(B.cfr(spark, sf)).select("vec_id", nan.alias("q"))
    return rows.groupBy("vec_id").agg(
        F.count(C.nan_to_null(F.col("q"))).alias("finite"),
        r(F.sum(C.nan_to_zero(F.col("q")))).alias("total"),
    )


@query("b31_wrap_phase", f"""SELECT vec_id, k, {sr('p - 2 * PI() * FLOOR((p + PI()) / (2 * PI()))')} AS phase
  FROM (SELECT vec_id, k, 3 * ATAN2(im, re) AS p FROM fx_cfr) t""", ("fx_cfr",))
def b31(spark, sf):
    rows = B.samples(B.cfr(spark, sf))
    phase = C.wrap_phase(3 * C.angle(F.col("re"), F.col("im")))
    return rows.select("vec_id", F.col("k").cast("bigint").alias("k"), r(phase).alias("phase"))
