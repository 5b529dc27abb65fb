"""Queries over subcarrier and delay sequences: ranging, spectra, sounding resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.functions import grid
from channelspark.operators import cfr as K
from channelspark.operators import channel as CH
from channelspark.operators import long_axes as LX
from channelspark.operators import ranging as RG
from channelspark.operators import resources as RS
from channelspark.operators import sequences as Q
from channelspark.operators import spectrum as SP
from channelspark.operators.paths import link_path_labels
from channelspark.plans import bindings as B
from channelspark.plans.registry import query, r, sr

SPACING, N = B.SPACING_HZ, B.SUBCARRIERS
LINK = ["tx", "rx"]
C0 = "299792458.0::DOUBLE"


def truth(spark, sf):
    """Truth delay per link; receiver 4 has none."""
    links = B.cfr(spark, sf).select("tx", "rx").distinct()
    delay = ((F.col("tx") * 5 + F.col("rx")) % 7 + 1) * 1e-9
    return links.withColumn("truth_delay_s", F.when(F.col("rx") != 4, delay))


TRUTH_SQL = """tr AS (SELECT DISTINCT tx, rx, CASE WHEN rx <> 4 THEN ((tx * 5 + rx) % 7 + 1) * 1e-9::DOUBLE END AS truth
  FROM fx_cfr)"""
UNWRAP_SQL = """ph AS (SELECT *, ATAN2(im, re) AS p FROM fx_cfr),
  st AS (SELECT *, p - LAG(p) OVER (PARTITION BY vec_id ORDER BY k) AS d FROM ph),
  wr AS (SELECT *, d + PI() - 2 * PI() * FLOOR((d + PI()) / (2 * PI())) - PI() AS m FROM st),
  co AS (SELECT *, CASE WHEN d IS NULL OR ABS(d) < PI() THEN 0 WHEN m = -PI() AND d > 0 THEN PI() - d ELSE m - d END AS c FROM wr),
  un AS (SELECT *, p + SUM(c) OVER (PARTITION BY vec_id ORDER BY k) AS u FROM co)"""
PDP_SQL = f"""hw AS (SELECT tx, rx, rx_ant, k, re * (0.5 - 0.5 * COS(2 * PI() * k / 31)) AS re,
  im * (0.5 - 0.5 * COS(2 * PI() * k / 31)) AS im FROM fx_cfr),
  bn AS (SELECT UNNEST(RANGE(256)) AS bin),
  pr AS (SELECT tx, rx, rx_ant, bin, SUM(re * COS(2 * PI() * k * bin / 256) - im * SIN(2 * PI() * k * bin / 256)) / 256 AS re,
  SUM(re * SIN(2 * PI() * k * bin / 256) + im * COS(2 * PI() * k * bin / 256)) / 256 AS im FROM hw, bn GROUP BY ALL),
  pw AS (SELECT tx, rx, bin, AVG(re * re + im * im) AS power FROM pr GROUP BY ALL)"""
_PEAK_SQL = """nb AS (SELECT *, LAG(power, 1, -1) OVER w AS lo, LEAD(power, 1, -1) OVER w AS hi FROM pw
  WINDOW w AS (PARTITION BY tx, rx ORDER BY bin))"""
RANGE_SQL = f"""{PDP_SQL}, {_PEAK_SQL},
  lk AS (SELECT tx, rx, MAX(power) AS top, MEDIAN(power) AS fl, MIN_BY(bin, -power) AS topbin FROM pw GROUP BY tx, rx),
  cd AS (SELECT nb.*, top, fl FROM nb JOIN lk USING (tx, rx) JOIN tr USING (tx, rx) WHERE truth IS NOT NULL AND power >= lo AND power >= hi
  AND power >= top * POW(10, -1.2) AND bin <= topbin),
  gp AS (SELECT *, CASE WHEN bin - LAG(bin, 1, bin) OVER (PARTITION BY tx, rx ORDER BY bin) > 8 THEN 1 ELSE 0 END AS brk FROM cd),
  isl AS (SELECT *, SUM(brk) OVER (PARTITION BY tx, rx ORDER BY bin) AS island FROM gp),
  pk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tx, rx ORDER BY power DESC, bin) AS rn FROM isl WHERE island = 0),
  of AS (SELECT *, 10 * LOG10(top / fl) AS snr, LN(lo) - 2 * LN(power) + LN(hi) AS den FROM pk WHERE rn = 1),
  det AS (SELECT tx, rx, bin, power, snr, (bin + CASE WHEN bin IN (0, 255) OR ABS(den) < 1e-12 THEN 0
  ELSE LEAST(GREATEST(0.5 * (LN(lo) - LN(hi)) / den, -1), 1) END) / 256e6::DOUBLE AS toa FROM of WHERE snr >= 6),
  pdp AS (SELECT tr.tx, tr.rx, truth, toa, COALESCE(bin, -1) AS bin, power, snr FROM tr LEFT JOIN det USING (tx, rx))"""
SLOPE_SQL = f"""{UNWRAP_SQL}, sx AS (SELECT *, (k - 15.5::DOUBLE) * 1e6::DOUBLE AS f, re * re + im * im AS w FROM un WHERE rx <> 4),
  mn AS (SELECT vec_id, SUM(w * f) / SUM(w) AS fm, SUM(w * u) / SUM(w) AS um FROM sx GROUP BY vec_id),
  ft AS (SELECT vec_id, SUM(w * (f - fm) * (u - um)) / SUM(w * (f - fm) * (f - fm)) AS b, ANY_VALUE(fm) AS fm, ANY_VALUE(um) AS um
  FROM sx JOIN mn USING (vec_id) GROUP BY vec_id),
  prs AS (SELECT tx, rx, vec_id, AVG(w) AS mp, -ANY_VALUE(b) / (2 * PI()) AS toa,
  SQRT(SUM(w * POW(u - um - b * (f - fm), 2)) / SUM(w)) AS res FROM sx JOIN ft USING (vec_id) GROUP BY ALL),
  ok AS (SELECT * FROM prs WHERE toa >= 0 AND mp >= 1e-12),
  wm AS (SELECT *, SUM(mp) OVER (PARTITION BY tx, rx ORDER BY toa) AS ct, SUM(mp) OVER (PARTITION BY tx, rx ORDER BY res) AS cr,
  SUM(mp) OVER (PARTITION BY tx, rx) AS tot FROM ok),
  sl AS (SELECT tx, rx, MIN(toa) FILTER (ct >= tot / 2) AS toa, MIN(res) FILTER (cr >= tot / 2) AS res FROM wm GROUP BY tx, rx),
  slope AS (SELECT tr.tx, tr.rx, truth, toa, res FROM tr LEFT JOIN sl USING (tx, rx))"""


def _outcome(prefix: str = "") -> str:
    return f"""{sr('toa * 1e9', 5)} AS toa_ns, {sr(f'toa * {C0}', 5)} AS range_m, {sr('2e9 * toa', 5)} AS rtt_ns,
      {sr(f'(toa - truth) * {C0}', 5)} AS error_m, toa IS NOT NULL AS success"""


def _ranging_columns():
    return [
        r(F.col("toa_s") * 1e9, 5).alias("toa_ns"), r(F.col("range_m"), 5).alias("range_m"),
        r(F.col("rtt_s") * 1e9, 5).alias("rtt_ns"), r(F.col("error_m"), 5).alias("error_m"),
        "success",
    ]


@query("e1_unwrap_phase", f"WITH {UNWRAP_SQL} SELECT vec_id, k, {sr('u')} AS unwrapped FROM un", ("fx_cfr",))
def e1(spark, sf):
    rows = B.samples(B.cfr(spark, sf).repartition("tx", "rx")).select(
        "tx", "rx", "vec_id", "k", C.angle(F.col("re"), F.col("im")).alias("phase")
    )
    return Q.unwrap_phase(rows, ["tx", "rx", "vec_id"], "phase").select(
        "vec_id", F.col("k").cast("bigint").alias("k"), r(F.col("unwrapped")).alias("unwrapped")
    )


def profile(spark, sf):
    options = RG.PdpOptions(SPACING, N)
    return RG.power_delay_profile(B.cfr(spark, sf), options)


@query("e2_local_peaks", f"""WITH {PDP_SQL}, {_PEAK_SQL} SELECT tx, rx, bin, {sr('power * 1e6', 5)} AS power FROM nb
  WHERE power >= lo AND power >= hi""", ("fx_cfr",))
def e2(spark, sf):
    return Q.local_peaks(profile(spark, sf), LINK).select(
        "tx", "rx", F.col("bin").cast("bigint").alias("bin"), r(F.col("power") * 1e6, 5).alias("power")
    )


@query("e3_first_peak_cluster", f"""WITH {PDP_SQL}, {_PEAK_SQL},
  gp AS (SELECT *, CASE WHEN bin - LAG(bin, 1, bin) OVER (PARTITION BY tx, rx ORDER BY bin) > 12 THEN 1 ELSE 0 END AS brk
  FROM nb WHERE power >= lo AND power >= hi),
  isl AS (SELECT *, SUM(brk) OVER (PARTITION BY tx, rx ORDER BY bin) AS island FROM gp)
  SELECT tx, rx, MIN_BY(bin, -power) AS bin, {sr('MAX(power) * 1e6', 5)} AS power FROM isl WHERE island = 0 GROUP BY tx, rx""",
       ("fx_cfr",))
def e3(spark, sf):
    out = Q.first_peak_cluster(Q.local_peaks(profile(spark, sf), LINK), LINK, 12)
    return out.select("tx", "rx", F.col("bin").cast("bigint").alias("bin"),
                      r(F.col("power") * 1e6, 5).alias("power"))


@query("e4_parabolic_offset", f"""WITH {PDP_SQL}, {_PEAK_SQL} SELECT tx, rx, bin, {sr('''CASE WHEN bin IN (0, 255) OR
  ABS(LN(GREATEST(lo, 1e-300)) - 2 * LN(power) + LN(GREATEST(hi, 1e-300))) < 1e-12 THEN 0
  ELSE LEAST(GREATEST(0.5 * (LN(GREATEST(lo, 1e-300)) - LN(GREATEST(hi, 1e-300)))
  / (LN(GREATEST(lo, 1e-300)) - 2 * LN(power) + LN(GREATEST(hi, 1e-300))), -1), 1) END''', 5)} AS shift
  FROM nb WHERE power >= lo AND power >= hi""", ("fx_cfr",))
def e4(spark, sf):
    shift = Q.parabolic_offset(F.col("power"), F.col("left"), F.col("right"))
    return Q.local_peaks(profile(spark, sf), LINK).select(
        "tx", "rx", F.col("bin").cast("bigint").alias("bin"), r(shift, 5).alias("shift")
    )


@query("e19_pdp_peak_ranging", f"""WITH {TRUTH_SQL}, {RANGE_SQL} SELECT tx, rx, bin AS delay_bin, {_outcome()},
  {sr('power * 1e6', 5)} AS peak_power, {sr('snr', 5)} AS peak_snr_db FROM pdp""", ("fx_cfr",))
def e19(spark, sf):
    out = RG.pdp_peak_ranging(B.cfr(spark, sf), RG.PdpOptions(SPACING, N), truth(spark, sf))
    return out.select("tx", "rx", F.col("delay_bin").cast("bigint").alias("delay_bin"),
                      *_ranging_columns(), r(F.col("peak_power") * 1e6, 5).alias("peak_power"),
                      r(F.col("peak_snr_db"), 5).alias("peak_snr_db"))


@query("e20_phase_slope_ranging", f"""WITH {TRUTH_SQL}, {SLOPE_SQL} SELECT tx, rx, {_outcome()}, {sr('res', 5)} AS residual_rad
  FROM slope""", ("fx_cfr",))
def e20(spark, sf):
    out = RG.phase_slope_ranging(B.cfr(spark, sf), SPACING, N, truth(spark, sf))
    return out.select("tx", "rx", *_ranging_columns(),
                      r(F.col("residual_rad"), 5).alias("residual_rad"))


@query("e21_run_ranging", f"""WITH {TRUTH_SQL}, {RANGE_SQL}, {SLOPE_SQL}
  SELECT 'pdp_peak' AS estimator, tx, rx, {_outcome()}, TRUE AS is_default FROM pdp
  UNION ALL SELECT 'phase_slope', tx, rx, {_outcome()}, FALSE FROM slope""", ("fx_cfr",))
def e21(spark, sf):
    out = RG.run_ranging(B.cfr(spark, sf), truth(spark, sf), SPACING, N)
    return out.select("estimator", "tx", "rx", *_ranging_columns(), "is_default")


@query("d36_weighted_median", f"""WITH s AS (SELECT tx, rx, re, SUM(re * re + im * im) OVER (PARTITION BY tx, rx ORDER BY re) AS c,
  SUM(re * re + im * im) OVER (PARTITION BY tx, rx) AS t FROM fx_cfr)
  SELECT tx, rx, {sr('MIN(re) FILTER (c >= t / 2)')} AS median FROM s GROUP BY tx, rx""", ("fx_cfr",))
def d36(spark, sf):
    rows = B.samples(B.cfr(spark, sf)).withColumn("w", C.abs2(F.col("re"), F.col("im")))
    out = Q.weighted_median(rows, LINK, "re", "w")
    return out.withColumn("median", r(F.col("median")))


@query("d37_weighted_line_fit", f"""WITH s AS (SELECT tx, rx, k - 15.5::DOUBLE AS x, re AS y, re * re + im * im AS w FROM fx_cfr),
  m AS (SELECT tx, rx, SUM(w * x) / SUM(w) AS xm, SUM(w * y) / SUM(w) AS ym FROM s GROUP BY tx, rx)
  SELECT tx, rx, {sr('SUM(w * (x - xm) * (y - ym)) / SUM(w * (x - xm) * (x - xm))')} AS slope,
  {sr('ANY_VALUE(ym) - SUM(w * (x - xm) * (y - ym)) / SUM(w * (x - xm) * (x - xm)) * ANY_VALUE(xm)')} AS intercept
  FROM s JOIN m USING (tx, rx) GROUP BY tx, rx""", ("fx_cfr",))
def d37(spark, sf):
    rows = B.samples(B.cfr(spark, sf)).select(
        "tx", "rx", (F.col("k") - 15.5).alias("x"), F.col("re").alias("y"),
        C.abs2(F.col("re"), F.col("im")).alias("w"),
    )
    return Q.weighted_line_fit(rows, LINK, "x", "y", "w").select(
        "tx", "rx", r(F.col("slope")).alias("slope"), r(F.col("intercept")).alias("intercept")
    )


COV_SQL = """cov AS (SELECT a.tx, a.rx, a.rx_ant AS i, b.rx_ant AS j, AVG(a.re * b.re + a.im * b.im) AS re,
  AVG(a.im * b.re - a.re * b.im) AS im FROM fx_cfr a JOIN fx_cfr b ON a.tx = b.tx AND a.rx = b.rx AND a.k = b.k
  GROUP BY ALL)"""
LAYOUT = SP.ArrayLayout(2, 2)
ANGLES = SP.AngleGrid((0.0, 3.0, 9), (-3.0, 3.0, 9))


@query("d33_rx_covariance", f"WITH {COV_SQL} SELECT tx, rx, i, j, {sr('re')} AS re, {sr('im')} AS im FROM cov", ("fx_cfr",))
def d33(spark, sf):
    return SP.rx_covariance(B.cfr(spark, sf), LINK).select(
        "tx", "rx", "i", "j", r(F.col("re")).alias("re"), r(F.col("im")).alias("im")
    )


AXES = ["snapshot", *LINK]
AXES_SQL = """cov AS (SELECT a.snapshot, a.tx, a.rx, a.rx_ant AS i, b.rx_ant AS j, AVG(a.re * b.re + a.im * b.im) AS re,
  AVG(a.im * b.re - a.re * b.im) AS im FROM fx_axes a JOIN fx_axes b ON a.tx = b.tx AND a.rx = b.rx AND a.snapshot = b.snapshot
  AND a.tx_ant = b.tx_ant AND a.k = b.k GROUP BY ALL)"""


@query("d33_covariance_per_snapshot", f"WITH {AXES_SQL} SELECT snapshot, tx, rx, i, j, {sr('re')} AS re, {sr('im')} AS im FROM cov", ("fx_axes",))
def d33_axes(spark, sf):
    return SP.rx_covariance(B.cfr_axes(spark, sf), AXES).select(
        *AXES, "i", "j", r(F.col("re")).alias("re"), r(F.col("im")).alias("im")
    )


def _bartlett_sql(position_x: str, position_y: str, position_z: str) -> str:
    return f"""WITH {COV_SQL}, el AS (SELECT e, e // 2 AS c, e % 2 AS w FROM (SELECT UNNEST(RANGE(4)) AS e) t),
  rxs AS (SELECT DISTINCT rx FROM fx_cfr),
  ps AS (SELECT rx, e, (c - 0.5) * 0.5 AS py, (0.5 - w) * 0.5 AS pz FROM el, rxs),
  an AS (SELECT zi, ai, zi * 0.375::DOUBLE AS ze, -3.0::DOUBLE + ai * 0.75::DOUBLE AS az FROM
  (SELECT UNNEST(RANGE(9)) AS zi) a, (SELECT UNNEST(RANGE(9)) AS ai) b),
  sv AS (SELECT rx, e, zi, ai, 2 * PI() * (({position_x}) * SIN(ze) * COS(az) + ({position_y}) * SIN(ze) * SIN(az)
  + ({position_z}) * COS(ze)) AS ph FROM ps, an),
  pj AS (SELECT c.tx, c.rx, s.zi, s.ai, GREATEST(SUM(c.re * COS(t.ph - s.ph) - c.im * SIN(t.ph - s.ph)) / 4, 0) AS p
  FROM cov c JOIN sv s ON s.rx = c.rx AND s.e = c.i JOIN sv t ON t.rx = c.rx AND t.e = c.j AND t.zi = s.zi AND t.ai = s.ai
  GROUP BY ALL)
  SELECT tx, rx, zi AS zenith_idx, ai AS azimuth_idx, {sr('p / MAX(p) OVER (PARTITION BY tx, rx)', 5)} AS power FROM pj"""


def _spectrum(spark, sf, orientation=None):
    cov = SP.rx_covariance(B.cfr(spark, sf), LINK)
    spectra = SP.bartlett_spectrum(cov, LINK, LAYOUT, ANGLES, orientation)
    return SP.spectrum_rows(spectra, LINK, ANGLES)


@query("d34_bartlett_spectrum", _bartlett_sql("0", "py", "pz"), ("fx_cfr",))
def d34(spark, sf):
    return _spectrum(spark, sf).withColumn("power", r(F.col("power"), 5))


@query("d34_bartlett_per_snapshot", f"""WITH {AXES_SQL},
  ps AS (SELECT e, (e // 2 - 0.5) * 0.5 AS py, (0.5 - e % 2) * 0.5 AS pz FROM (SELECT UNNEST(RANGE(4)) AS e) t),
  an AS (SELECT zi, ai, zi * 0.375::DOUBLE AS ze, -3.0::DOUBLE + ai * 0.75::DOUBLE AS az FROM
  (SELECT UNNEST(RANGE(9)) AS zi) a, (SELECT UNNEST(RANGE(9)) AS ai) b),
  sv AS (SELECT e, zi, ai, 2 * PI() * (py * SIN(ze) * SIN(az) + pz * COS(ze)) AS ph FROM ps, an),
  pj AS (SELECT c.snapshot, c.tx, c.rx, s.zi, s.ai, GREATEST(SUM(c.re * COS(t.ph - s.ph) - c.im * SIN(t.ph - s.ph)) / 4, 0) AS p
  FROM cov c JOIN sv s ON s.e = c.i JOIN sv t ON t.e = c.j AND t.zi = s.zi AND t.ai = s.ai GROUP BY ALL)
  SELECT snapshot, tx, rx, zi AS zenith_idx, ai AS azimuth_idx, {sr('p / MAX(p) OVER (PARTITION BY snapshot, tx, rx)', 5)} AS power FROM pj""",
       ("fx_axes",))
def d34_axes(spark, sf):
    cov = SP.rx_covariance(B.cfr_axes(spark, sf), AXES)
    rows = SP.spectrum_rows(SP.bartlett_spectrum(cov, AXES, LAYOUT, ANGLES), AXES, ANGLES)
    return rows.withColumn("power", r(F.col("power"), 5))


# Receiver r is turned by alpha = 0.3 r about z and gamma = 0.2 r about x.
@query("d34_bartlett_rotated", _bartlett_sql(
    "-SIN(0.3 * rx) * (COS(0.2 * rx) * py - SIN(0.2 * rx) * pz)",
    "COS(0.3 * rx) * (COS(0.2 * rx) * py - SIN(0.2 * rx) * pz)",
    "SIN(0.2 * rx) * py + COS(0.2 * rx) * pz"), ("fx_cfr",))
def d34_rotated(spark, sf):
    turned = B.cfr(spark, sf).select("rx").distinct().select(
        "rx", (F.col("rx") * 0.3).alias("alpha"), F.lit(0.0).alias("beta"),
        (F.col("rx") * 0.2).alias("gamma"),
    )
    return _spectrum(spark, sf, turned).withColumn("power", r(F.col("power"), 5))


@query("d43_row_limits", f"""SELECT tx, {sr('CASE WHEN MAX(re) > MIN(re) THEN MIN(re) ELSE 0 END')} AS vmin,
  {sr('CASE WHEN MAX(re) > MIN(re) THEN MAX(re) ELSE 1 END')} AS vmax FROM fx_cfr GROUP BY tx""", ("fx_cfr",))
def d43(spark, sf):
    return SP.row_limits(B.samples(B.cfr(spark, sf)), ["tx"], "re").select(
        "tx", r(F.col("vmin")).alias("vmin"), r(F.col("vmax")).alias("vmax")
    )


@query("c10_nearest_bin", """WITH g AS (SELECT i, 0.0 + i * 0.3875::DOUBLE AS z, -3.2::DOUBLE + i * 0.8::DOUBLE AS a FROM (SELECT UNNEST(RANGE(9)) AS i) t),
  f AS (SELECT tx, rx, theta_r AS ze, phi_r AS az FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tx, rx
  ORDER BY tau_s, rx_ant, tx_ant, path) AS rn FROM fx_paths) t WHERE rn = 1)
  SELECT tx, rx, MIN_BY(zi.i, ABS(zi.z - ze)) AS zenith_idx, MIN_BY(ai.i, ABS(ai.a - az)) AS azimuth_idx
  FROM f, g zi, g ai GROUP BY tx, rx""", ("fx_paths",))
def c10(spark, sf):
    angles = SP.AngleGrid((0.0, 3.1, 9), (-3.2, 3.2, 9))
    labels = link_path_labels(B.paths(spark, sf))
    out = SP.angle_label(labels, "first_zenith_rad", "first_azimuth_rad", angles)
    return out.select("tx", "rx", "zenith_idx", "azimuth_idx")


_AUG_SQL = """rt AS (SELECT vec_id, k, 0.5 + 2 * PI() * k * (vec_id % 11) * 1e-6 + 2 * PI() * k * 3.0 / 32 AS ph,
  re, im FROM fx_cfr),
  sc AS (SELECT vec_id, k, (re * COS(ph) - im * SIN(ph)) * POW(10, 6.0 / 20) AS re,
  (re * SIN(ph) + im * COS(ph)) * POW(10, 6.0 / 20) AS im FROM rt),
  mg AS (SELECT *, SQRT(re * re + im * im) AS m FROM sc)"""


@query("b24_augment_channel", f"""WITH {_AUG_SQL} SELECT vec_id, k, {sr('CASE WHEN m > 0.6 THEN re * 0.6 / m ELSE re END')} AS re,
  {sr('CASE WHEN m > 0.6 THEN im * 0.6 / m ELSE im END')} AS im, MAX(m) OVER (PARTITION BY vec_id) > 0.6 AS clipped FROM mg""",
       ("fx_cfr",))
def b24(spark, sf):
    out = CH.augment_channel(
        B.cfr(spark, sf), phase_offset_rad=0.5, sfo_ppm=F.col("vec_id") % 11,
        timing_offset_samples=3.0, agc_gain_db=6.0, fft_size=32, clipping_threshold=0.6,
    )
    return B.samples(out.select("vec_id", "clipped", "h")).select(
        "vec_id", F.col("k").cast("bigint").alias("k"), r(F.col("re")).alias("re"),
        r(F.col("im")).alias("im"), "clipped",
    )


@query("b26_add_awgn", """SELECT COUNT(*) AS n, TRUE AS mean_ok, TRUE AS variance_ok, TRUE AS independent_ok FROM fx_cfr""",
       ("fx_cfr",))
def b26(spark, sf):
    """Statistical check: noise mean, variance and I/Q correlation within five standard errors."""
    clean = B.samples(B.cfr(spark, sf))
    noisy = CH.add_awgn(clean.withColumnsRenamed({"re": "re0", "im": "im0"}).withColumns(
        {"re": F.col("re0"), "im": F.col("im0")}), ["vec_id", "k"], F.lit(0.5), seed=7)
    n_re, n_im = F.col("re") - F.col("re0"), F.col("im") - F.col("im0")
    n = F.count(F.lit(1))
    return noisy.agg(
        n.alias("n"),
        (F.abs(F.avg(n_re)) + F.abs(F.avg(n_im)) < 10 * F.sqrt(0.25 / n)).alias("mean_ok"),
        (F.abs(F.avg(n_re * n_re + n_im * n_im) / 0.5 - 1) < 5 / F.sqrt(n)).alias("variance_ok"),
        (F.abs(F.avg(n_re * n_im)) < 5 * 0.25 / F.sqrt(n)).alias("independent_ok"),
    )


@query("d27_mix_iq", f"""SELECT tx // 4 AS frame, rx, rx_ant, k, {sr('SUM(re)')} AS re, {sr('SUM(im)')} AS im, COUNT(*) AS users
  FROM fx_cfr GROUP BY ALL""", ("fx_cfr",))
def d27(spark, sf):
    slots = RS.frame_slots(B.cfr(spark, sf).select("tx").distinct(), 4)
    out = CH.mix_iq(B.samples(B.cfr(spark, sf)), slots, ["rx", "rx_ant", "k"])
    return out.select("frame", "rx", "rx_ant", F.col("k").cast("bigint").alias("k"),
                      r(F.col("re")).alias("re"), r(F.col("im")).alias("im"), "users")


def _srs_config(spark, sf):
    return B.scenes(spark, sf).select(
        "source_scene_index", F.explode(F.array(F.lit(0), F.lit(1))).alias("symbol"),
        "bs_count", "ue_count",
    ).select(
        "source_scene_index", "symbol", (F.col("ue_count") % 5 + F.col("symbol")).alias("start_prb"),
        (F.col("bs_count") + 1).alias("prb_count"),
        (F.lit(2) + 2 * (F.col("bs_count") % 2)).alias("comb_size"),
        (F.col("ue_count") / 10 % 2).cast("bigint").alias("comb_offset"),
        F.lit(240).cast("bigint").alias("total"),
    )


@query("b28_srs_re_grid", """WITH c AS (SELECT source_scene_index, s AS symbol, ue_count % 5 + s AS st, bs_count + 1 AS n,
  2 + 2 * (bs_count % 2) AS comb, ue_count // 10 % 2 AS co FROM fx_scenes, (SELECT UNNEST([0, 1]) AS s) t)
  SELECT source_scene_index, symbol, UNNEST(RANGE(st * 12 + co, LEAST((st + n) * 12, 240), comb)) AS k FROM c""",
       ("fx_scenes",))
def b28(spark, sf):
    return RS.srs_re_grid(_srs_config(spark, sf), ["source_scene_index"]).withColumns(
        {"symbol": F.col("symbol").cast("bigint"), "k": F.col("k").cast("bigint")}
    )


@query("b28_symbol_hopping", """SELECT source_scene_index, symbol, UNNEST(RANGE((2 + hop) * 12 + ue_count // 10 % 2, (2 + hop + n) * 12, 4)) AS k
  FROM fx_scenes, (VALUES (0, 0, 6), (1, 9, 3), (2, 4, 14), (3, 0, 1)) AS h(symbol, hop, n)""", ("fx_scenes",))
def b28_hopping(spark, sf):
    """Four symbols, each with its own first resource block and width."""
    hops = grid.symbol_prbs(4, 240, 2, None, [0, 9, 4, 0], [6, 3, 14, 1])
    allocations = F.array(*[
        F.struct(F.lit(symbol).alias("symbol"), F.lit(start).alias("start_prb"), F.lit(count).alias("prb_count"))
        for symbol, (start, count) in enumerate(hops)
    ])
    config = B.scenes(spark, sf).select(
        "source_scene_index", F.inline(allocations), F.lit(4).alias("comb_size"),
        F.expr("ue_count div 10 % 2").alias("comb_offset"), F.lit(240).alias("total"),
    )
    return RS.srs_re_grid(config, ["source_scene_index"]).withColumns(
        {"symbol": F.col("symbol").cast("int"), "k": F.col("k").cast("bigint")}
    )


@query("b29_is_scheduled", """SELECT source_scene_index, CASE WHEN bs_count = 3 THEN ue_count // 10 = bs_count
  ELSE ue_count // 10 >= bs_count AND (ue_count // 10 - bs_count) % (link_count % 7 + 1) = 0 END AS scheduled
  FROM fx_scenes""", ("fx_scenes",))
def b29(spark, sf):
    trigger = F.when(F.col("bs_count") == 3, "aperiodic").otherwise("periodic")
    slot = F.expr("ue_count div 10")
    return B.scenes(spark, sf).select(
        "source_scene_index",
        grid.is_scheduled(trigger, slot, F.col("bs_count"), F.col("link_count") % 7 + 1)
        .alias("scheduled"),
    )


@query("e5_linear_interpolate", f"""WITH p AS (SELECT vec_id, k, re * 1.05 AS re, im * 1.05 AS im FROM fx_cfr
  WHERE k % 4 = vec_id % 4),
  g AS (SELECT DISTINCT vec_id, j FROM p, (SELECT UNNEST(RANGE(32)) AS j) t),
  e AS (SELECT g.vec_id, g.j, (SELECT MAX(k) FROM p WHERE p.vec_id = g.vec_id AND p.k <= g.j) AS a,
  (SELECT MIN(k) FROM p WHERE p.vec_id = g.vec_id AND p.k >= g.j) AS b FROM g)
  SELECT e.vec_id, e.j AS k,
  {sr('CASE WHEN a IS NULL THEN q.re WHEN b IS NULL OR a = b THEN p.re ELSE p.re + (q.re - p.re) * (j - a) / (b - a) END')} AS re,
  {sr('CASE WHEN a IS NULL THEN q.im WHEN b IS NULL OR a = b THEN p.im ELSE p.im + (q.im - p.im) * (j - a) / (b - a) END')} AS im
  FROM e LEFT JOIN p ON p.vec_id = e.vec_id AND p.k = a LEFT JOIN p q ON q.vec_id = e.vec_id AND q.k = b""", ("fx_cfr",))
def e5(spark, sf):
    """Comb-4 sounding on two symbols (the second 10 % stronger), filled to all subcarriers."""
    config = B.cfr(spark, sf).select(
        "vec_id", "h", F.explode(F.array(F.lit(0), F.lit(1))).alias("symbol"),
        F.lit(0).alias("start_prb"), F.lit(3).alias("prb_count"), F.lit(4).alias("comb_size"),
        F.col("rx_ant").alias("comb_offset"), F.lit(N).alias("total"),
    )
    elements = RS.srs_re_grid(config, ["vec_id", "h"])
    gain = 1 + F.lit(0.1) * F.col("symbol")
    sample = F.get("h", F.col("k"))
    points = elements.select("vec_id", "k", (sample["re"] * gain).alias("re"),
                             (sample["im"] * gain).alias("im"))
    out = Q.linear_interpolate(points, ["vec_id"], ["re", "im"], N)
    return out.select("vec_id", F.col("k").cast("bigint").alias("k"), r(F.col("re")).alias("re"),
                      r(F.col("im")).alias("im"))


@query("e6_frame_slots", """WITH u AS (SELECT scene_id, idx AS tx, ROW_NUMBER() OVER (PARTITION BY scene_id ORDER BY idx) - 1 AS n
  FROM fx_points WHERE role = 'ue'), f AS (SELECT scene_id, n // 4 AS frame, n % 4 AS slot, tx FROM u),
  a AS (SELECT DISTINCT scene_id, frame, s AS slot FROM f, (SELECT UNNEST(RANGE(4)) AS s) t)
  SELECT a.scene_id, a.frame, a.slot, COALESCE(tx, -1) AS tx FROM a LEFT JOIN f USING (scene_id, frame, slot)""", ("fx_points",))
def e6(spark, sf):
    users = B.points(spark, sf).where("role = 'ue'").select("scene_id", F.col("idx").alias("tx"))
    return RS.frame_slots(users, 4, ["scene_id"])


@query("e7_prb_split", """SELECT source_scene_index, slot, slot * (ue_count // bs_count) + LEAST(slot, ue_count % bs_count) AS start,
  ue_count // bs_count + CASE WHEN slot < ue_count % bs_count THEN 1 ELSE 0 END AS count
  FROM (SELECT *, UNNEST(RANGE(bs_count)) AS slot FROM fx_scenes) t""", ("fx_scenes",))
def e7(spark, sf):
    slots = B.scenes(spark, sf).withColumn(
        "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bs_count") - 1))
    )
    block = grid.prb_split(F.col("ue_count"), F.col("bs_count"), F.col("slot"))
    return slots.withColumn("b", block).select("source_scene_index", "slot", "b.start", "b.count")


@query("c12_frame_positions", f"""WITH u AS (SELECT scene_id, idx AS tx, x, y, ROW_NUMBER() OVER (PARTITION BY scene_id ORDER BY idx) - 1 AS n
  FROM fx_points WHERE role = 'ue'), f AS (SELECT scene_id, n // 4 AS frame, n % 4 AS slot, tx, x, y FROM u),
  a AS (SELECT DISTINCT scene_id, frame, s AS slot FROM f, (SELECT UNNEST(RANGE(4)) AS s) t)
  SELECT a.scene_id, a.frame, a.slot, {sr('x')} AS x, {sr('y')} AS y FROM a LEFT JOIN f USING (scene_id, frame, slot)""",
       ("fx_points",))
def c12(spark, sf):
    users = B.points(spark, sf).where("role = 'ue'")
    slots = RS.frame_slots(users.select("scene_id", F.col("idx").alias("tx")), 4, ["scene_id"])
    return RS.frame_positions(slots, users, ["scene_id"]).select(
        "scene_id", "frame", "slot", r(F.col("x")).alias("x"), r(F.col("y")).alias("y")
    )


def _elements(spark, sf):
    """Six users per frame, comb 4 with offset tx % 4 on two symbols of 24 subcarriers."""
    users = B.points(spark, sf).where("role = 'ue'").select("scene_id", F.col("idx").alias("tx"))
    config = RS.frame_slots(users, 6, ["scene_id"]).where("tx >= 0").select(
        "scene_id", "frame", "slot", "tx", F.explode(F.array(F.lit(0), F.lit(1))).alias("symbol"),
        F.lit(0).alias("start_prb"), F.lit(2).alias("prb_count"), F.lit(4).alias("comb_size"),
        (F.col("tx") % 4).alias("comb_offset"), F.lit(24).alias("total"),
    )
    return RS.srs_re_grid(config, ["scene_id", "frame", "slot", "tx"])


@query("d25_resource_occupancy", """WITH u AS (SELECT scene_id, idx AS tx, ROW_NUMBER() OVER (PARTITION BY scene_id ORDER BY idx) - 1 AS n
  FROM fx_points WHERE role = 'ue'),
  e AS (SELECT scene_id, n // 6 AS frame, s AS symbol, UNNEST(RANGE(tx % 4, 24, 4)) AS k FROM u, (SELECT UNNEST([0, 1]) AS s) t)
  SELECT scene_id, frame, symbol, k, COUNT(*) AS users, COUNT(*) > 1 AS collision FROM e GROUP BY ALL""", ("fx_points",))
def d25(spark, sf):
    out = RS.resource_occupancy(_elements(spark, sf), ["scene_id"])
    return out.withColumns({"symbol": F.col("symbol").cast("bigint"), "k": F.col("k").cast("bigint")})


@query("d26_multiuser_error_table", f"""WITH sl AS (SELECT tx, tx // 4 AS frame, tx % 4 AS slot FROM (SELECT DISTINCT tx FROM fx_cfr) t),
  el AS (SELECT frame, slot, tx, s AS symbol, UNNEST(RANGE(tx % 3, 24, 3)) AS k FROM sl, (SELECT UNNEST([0, 1]) AS s) t),
  al AS (SELECT frame, slot, tx, UNNEST(RANGE(0, 8 * (slot + 1))) AS k FROM sl),
  oc AS (SELECT frame, symbol, k, COUNT(*) AS n FROM el GROUP BY ALL),
  cl AS (SELECT frame, COUNT(*) FILTER (n > 1) AS frame_collision_count FROM oc GROUP BY frame),
  er AS (SELECT tx, rx, k, POW(ere - re, 2) + POW(eim - im, 2) AS e, re * re + im * im AS s FROM fx_est),
  rn AS (SELECT frame, slot, rx, 10 * LOG10(SUM(e) / SUM(s)) AS v FROM el JOIN er USING (tx, k) GROUP BY ALL),
  an AS (SELECT frame, slot, rx, 10 * LOG10(SUM(e) / SUM(s)) AS v FROM al JOIN er USING (tx, k) GROUP BY ALL)
  SELECT sl.frame, sl.slot, sl.tx, rn.rx, (SELECT COUNT(*) FROM el WHERE el.tx = sl.tx) AS resource_re,
  (SELECT COUNT(*) FROM al WHERE al.tx = sl.tx) AS allocated_subcarriers, frame_collision_count,
  {sr('rn.v')} AS resource_nmse_db, {sr('an.v')} AS allocated_nmse_db
  FROM sl JOIN rn USING (frame, slot) JOIN an ON an.frame = rn.frame AND an.slot = rn.slot AND an.rx = rn.rx
  JOIN cl ON cl.frame = sl.frame""", ("fx_est",))
def d26(spark, sf):
    slots = RS.frame_slots(B.cfr(spark, sf).select("tx").distinct(), 4)
    active = slots.where("tx >= 0")
    elements = RS.srs_re_grid(active.select(
        "frame", "slot", "tx", F.explode(F.array(F.lit(0), F.lit(1))).alias("symbol"),
        F.lit(0).alias("start_prb"), F.lit(2).alias("prb_count"), F.lit(3).alias("comb_size"),
        (F.col("tx") % 3).alias("comb_offset"), F.lit(24).alias("total"),
    ), ["frame", "slot", "tx"])
    allocated = active.select(
        "frame", "slot", "tx",
        F.explode(F.sequence(F.lit(0), (8 * (F.col("slot") + 1) - 1).cast("int"))).alias("k"),
    )
    samples = K.paired_samples(B.cfr_est(spark, sf), ["tx", "rx"], "h", "est")
    out = RS.multiuser_error_table(slots, elements, allocated, samples)
    return out.withColumns({n: r(F.col(n)) for n in ("resource_nmse_db", "allocated_nmse_db")})


@query("c11_resource_truth", f"""WITH pt AS (SELECT * FROM (VALUES (0, 0, 0, 0), (0, 1, 2, 0), (1, 0, 1, 1), (1, 1, -1, 1)) v(port, symbol, ant, co)),
  re AS (SELECT port, symbol, ant, UNNEST(RANGE(co, 24, 2)) AS k FROM pt),
  lk AS (SELECT DISTINCT tx, rx FROM fx_cfr)
  SELECT lk.tx, lk.rx, port, symbol, re.k, {sr('COALESCE(c.re, 0)')} AS re, {sr('COALESCE(c.im, 0)')} AS im FROM lk CROSS JOIN re
  LEFT JOIN fx_cfr c ON c.tx = lk.tx AND c.rx = lk.rx AND c.rx_ant = re.ant AND c.k = re.k
  WHERE ant < 0 OR c.re IS NOT NULL""", ("fx_cfr",))
def c11(spark, sf):
    def port(number, symbol, antenna, offset):
        fields = {"port": number, "symbol": symbol, "tx_ant": antenna, "start_prb": 0,
                  "prb_count": 2, "comb_size": 2, "comb_offset": offset, "total": N}
        return F.struct(*[F.lit(v).alias(n) for n, v in fields.items()])

    ports = F.array(port(0, 0, 0, 0), port(0, 1, 2, 0), port(1, 0, 1, 1), port(1, 1, -1, 1))
    cfr = B.cfr(spark, sf).select("tx", "rx", F.col("rx_ant").cast("int").alias("tx_ant"), "h")
    out = RS.resource_truth(cfr, LINK, ports)
    return out.select(
        "tx", "rx", *[F.col(c).cast("bigint").alias(c) for c in ("port", "symbol", "k")],
        r(F.col("re")).alias("re"), r(F.col("im")).alias("im"),
    )


@query("e22_resource_ls_estimate", f"""WITH sy AS (SELECT UNNEST([0, 1]) AS s), po AS (SELECT UNNEST([0, 1]) AS port),
  y AS (SELECT vec_id, s, k, re * (1 + 0.1 * s) AS re, im * (1 + 0.1 * s) AS im FROM fx_cfr, sy),
  p AS (SELECT port, s, k, (1 + port) * COS(0.7 * (k + s) + port) AS pr, (1 + port) * SIN(0.7 * (k + s) + port) AS pi
  FROM po, sy, (SELECT UNNEST(RANGE(32)) AS k) ks)
  SELECT vec_id, port, k, {sr('SUM(re * pr + im * pi) / SUM(pr * pr + pi * pi)')} AS re,
  {sr('SUM(im * pr - re * pi) / SUM(pr * pr + pi * pi)')} AS im FROM y JOIN p USING (s, k) GROUP BY ALL""", ("fx_cfr",))
def e22(spark, sf):
    symbols = F.array(F.lit(0), F.lit(1))
    gain = 1 + F.lit(0.1) * F.col("symbol")
    received = B.samples(B.cfr(spark, sf)).withColumn("symbol", F.explode(symbols)).select(
        "vec_id", "symbol", "k", (F.col("re") * gain).alias("re"), (F.col("im") * gain).alias("im")
    )
    turn = F.lit(0.7) * (F.col("k") + F.col("symbol")) + F.col("port")
    pilots = (
        spark.range(N).select(F.col("id").cast("int").alias("k"))
        .withColumn("symbol", F.explode(symbols)).withColumn("port", F.explode(symbols))
        .withColumns({"p_re": (1 + F.col("port")) * F.cos(turn),
                      "p_im": (1 + F.col("port")) * F.sin(turn)})
    )
    out = RS.resource_ls_estimate(received, pilots, ["vec_id"])
    return out.select("vec_id", F.col("port").cast("bigint").alias("port"),
                      F.col("k").cast("bigint").alias("k"), r(F.col("re")).alias("re"),
                      r(F.col("im")).alias("im"))


@query("e18_timestamps", f"""SELECT source_scene_index, i AS snapshot, {sr('i / (bs_count * 10.0)')} AS timestamp_s
  FROM (SELECT *, UNNEST(RANGE(bs_count)) AS i FROM fx_scenes) t""", ("fx_scenes",))
def e18(spark, sf):
    times = grid.timestamps(F.col("bs_count"), F.col("bs_count") * 10.0)
    return B.scenes(spark, sf).select(
        "source_scene_index", F.posexplode(times).alias("snapshot", "t")
    ).select("source_scene_index", F.col("snapshot").cast("bigint").alias("snapshot"),
             r(F.col("t")).alias("timestamp_s"))


_LONG = "ax AS (SELECT rx_ant, vec_id // 4 * 32 + k AS pos, re, im, re * re + im * im AS power FROM fx_cfr)"


def long_axis(spark, sf):
    """All samples of a receive antenna along one axis: four vectors that grow with the table."""
    rows = B.samples(B.cfr(spark, sf).select("vec_id", "rx_ant", "h"))
    return rows.select("rx_ant", (F.expr("vec_id div 4") * N + F.col("k")).alias("pos"), "re", "im")


@query("e1_unwrap_long_axis", f"""WITH {_LONG}, ph AS (SELECT *, ATAN2(im, re) AS p FROM ax),
  st AS (SELECT *, p - LAG(p) OVER (PARTITION BY rx_ant ORDER BY pos) AS d FROM ph),
  tn AS (SELECT *, CASE WHEN d > PI() THEN -1 WHEN d < -PI() THEN 1 ELSE 0 END AS t FROM st)
  SELECT rx_ant, pos, {sr('p + 2 * PI() * SUM(t) OVER (PARTITION BY rx_ant ORDER BY pos)')} AS unwrapped FROM tn""", ("fx_cfr",))
def e1_long(spark, sf):
    rows = long_axis(spark, sf).withColumn("phase", C.angle(F.col("re"), F.col("im")))
    return LX.unwrap_phase(rows, ["rx_ant"], "phase", "pos", block=1024).select(
        "rx_ant", "pos", r(F.col("unwrapped")).alias("unwrapped"))


@query("e3_first_cluster_long_axis", f"""WITH {_LONG},
  gp AS (SELECT *, pos - LAG(pos, 1, pos) OVER (PARTITION BY rx_ant ORDER BY pos) > 20 AS brk FROM ax WHERE power > 0.03),
  rn AS (SELECT *, BOOL_OR(brk) OVER (PARTITION BY rx_ant ORDER BY pos) AS off FROM gp)
  SELECT rx_ant, ARG_MAX(pos, power) AS bin, {sr('MAX(power)')} AS power FROM rn WHERE NOT off GROUP BY rx_ant""", ("fx_cfr",))
def e3_long(spark, sf):
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    rows = long_axis(spark, sf).select("rx_ant", F.col("pos").alias("bin"), power.alias("power")).where("power > 0.03")
    return LX.first_peak_cluster(rows, ["rx_ant"], 20, block=128).withColumn("power", r(F.col("power")))


@query("e5_interpolate_long_axis", f"""WITH {_LONG}, mk AS (SELECT *, pos * 7 % 11 = 3 AND pos // 200 % 3 <> 1 AS known FROM ax),
  nb AS (SELECT rx_ant, pos, CASE WHEN known THEN pos END AS kp, CASE WHEN known THEN re END AS kr FROM mk),
  fl AS (SELECT rx_ant, pos, LAST_VALUE(kp IGNORE NULLS) OVER b AS a, LAST_VALUE(kr IGNORE NULLS) OVER b AS ra,
    FIRST_VALUE(kp IGNORE NULLS) OVER f AS z, FIRST_VALUE(kr IGNORE NULLS) OVER f AS rz FROM nb
    WINDOW b AS (PARTITION BY rx_ant ORDER BY pos ROWS UNBOUNDED PRECEDING),
      f AS (PARTITION BY rx_ant ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT rx_ant, pos, {sr('CASE WHEN a IS NULL THEN rz WHEN z IS NULL OR a = z THEN ra ELSE ra + (rz - ra) * (pos - a) / (z - a) END')} AS re
  FROM fl""", ("fx_cfr",))
def e5_long(spark, sf):
    """Comb samples with gaps of 200 positions, filled along the whole axis of each antenna: to its own last sample."""
    rows = long_axis(spark, sf)
    ends = rows.groupBy("rx_ant").agg((F.max("pos") + 1).alias("n"))
    known = rows.where("pos * 7 % 11 = 3 AND pos div 200 % 3 <> 1").withColumnRenamed("pos", "k").join(ends, "rx_ant")
    return LX.linear_interpolate(known, ["rx_ant", "n"], ["re"], F.col("n"), block=128).select(
        "rx_ant", F.col("k").alias("pos"), r(F.col("re")).alias("re"))
