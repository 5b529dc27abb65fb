"""Queries over points, links and propagation paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.functions import geometry as G
from channelspark.functions import grid
from channelspark.functions import paths as P
from channelspark.functions import power as PW
from channelspark.operators import links as L
from channelspark.operators import paths as PO
from channelspark.plans import bindings as B
from channelspark.plans.registry import query, r, sr

C0 = "299792458.0::DOUBLE"
P2 = "(a_re * a_re + a_im * a_im)"
LINK_SUMMARY = f"""ls AS (SELECT tx, rx, COUNT(DISTINCT path) AS path_count, BOOL_OR(flag = 'A') AS los_exists,
  BOOL_OR(flag <> 'A') AS nlos_exists,
  10 * LOG10(GREATEST(SUM({P2}) / 4.0::DOUBLE, 1e-30::DOUBLE)) AS power_db FROM fx_paths GROUP BY tx, rx)"""
LINKS = """pt AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY scene_id, role ORDER BY idx) - 1 AS loc,
  COUNT(*) OVER (PARTITION BY scene_id, role) AS n FROM fx_points),
  lk AS (SELECT t.scene_id, t.idx AS tx, q.idx AS rx, t.loc * q.n + q.loc AS link_index, t.x AS tx_x, t.y AS tx_y,
  t.z AS tx_z, q.x AS rx_x, q.y AS rx_y, q.z AS rx_z FROM pt t JOIN pt q ON t.scene_id = q.scene_id
  WHERE t.role = 'ue' AND q.role = 'bs')"""


@query("b2_dbm_to_mw", f"""SELECT ue, bs, {sr('POW(10, rssi_dbm / 10) * 1e6', 6)} AS nanowatt,
  {sr('10 * LOG10(GREATEST(POW(10, rssi_dbm / 10), 1e-30::DOUBLE))')} AS back_dbm FROM fx_rss""", ("fx_rss",))
def b2(spark, sf):
    mw = PW.dbm_to_mw(F.col("rssi_dbm"))
    return B.rss(spark, sf).select(
        "ue", "bs", r(mw * 1e6).alias("nanowatt"), r(PW.mw_to_dbm(mw)).alias("back_dbm")
    )


@query("b3_amplitude_scale_from_dbm",
       f"SELECT ue, bs, {sr('POW(10, (rssi_dbm + 40.0) / 20)', 9)} AS scale FROM fx_rss", ("fx_rss",))
def b3(spark, sf):
    return B.rss(spark, sf).select(
        "ue", "bs", r(PW.amplitude_scale_from_dbm(F.col("rssi_dbm"), -40.0), 9).alias("scale")
    )


@query("b4_thermal_noise_dbm", f"""SELECT source_scene_index,
  {sr('-173.975187 + 10 * LOG10((200.0 + bs_count) / 290.0) + 10 * LOG10(link_count * 1e4) + 7.0')} AS noise_dbm
  FROM fx_scenes""", ("fx_scenes",))
def b4(spark, sf):
    noise = PW.thermal_noise_dbm(
        F.col("link_count") * 1e4, F.lit(7.0), F.lit(200.0) + F.col("bs_count")
    )
    return B.scenes(spark, sf).select("source_scene_index", r(noise).alias("noise_dbm"))


@query("b5_noise_budget", f"""WITH m AS (SELECT ue, bs, valid, POW(10, rssi_dbm / 10) AS s FROM fx_rss),
  n AS (SELECT *, CASE WHEN valid THEN s / POW(10, 20.0 / 10) ELSE 1e-9::DOUBLE END AS noise FROM m)
  SELECT ue, bs, {sr('10 * LOG10(s / noise)')} AS snr_db, {sr('10 * LOG10(s)')} AS rssi_dbm,
  {sr('10 * LOG10(noise)')} AS noise_dbm FROM n""", ("fx_rss",))
def b5(spark, sf):
    signal = PW.dbm_to_mw(F.col("rssi_dbm"))
    mode = F.when(F.col("valid"), "relative_snr").otherwise("absolute_thermal")
    noise = PW.noise_variance(signal, mode, F.lit(20.0), F.lit(1e-9))
    return B.rss(spark, sf).select(
        "ue", "bs", r(PW.db(signal / noise)).alias("snr_db"),
        r(PW.mw_to_dbm(signal)).alias("rssi_dbm"), r(PW.mw_to_dbm(noise)).alias("noise_dbm"),
    )


@query("b6_uplink_power_control", f"""WITH {LINK_SUMMARY},
  s AS (SELECT tx, rx AS serving_rx, -power_db AS loss FROM
    (SELECT *, ROW_NUMBER() OVER (PARTITION BY tx ORDER BY ROUND(power_db, 9) DESC, rx) AS rn FROM ls) t WHERE rn = 1),
  p AS (SELECT *, -5.0 + 0.8::DOUBLE * loss + 0.5 AS req FROM s),
  c AS (SELECT *, LEAST(GREATEST(req, -40.0::DOUBLE), 23.0::DOUBLE) AS clip FROM p)
  SELECT tx, serving_rx, {sr('loss')} AS path_loss_db, {sr('clip')} AS tx_power_dbm, clip <> req AS clipped,
  {sr('POW(10, clip / 20)')} AS amplitude_scale FROM c""", ("fx_paths",))
def b6(spark, sf):
    summary = PO.link_summary(B.paths(spark, sf), 2, 2)
    out = PO.uplink_power_control(
        summary, p0_dbm=-5.0, alpha=0.8, closed_loop=True, tpc_offset_db=1.0, accumulation_db=-0.5
    )
    return out.select(
        "tx", "serving_rx", r(F.col("path_loss_db")).alias("path_loss_db"),
        r(F.col("tx_power_dbm")).alias("tx_power_dbm"), "clipped",
        r(F.col("amplitude_scale")).alias("amplitude_scale"),
    )


@query("b7_link_geometry", f"""WITH {LINKS} SELECT tx, rx,
  {sr('SQRT(POW(rx_x - tx_x, 2) + POW(rx_y - tx_y, 2) + POW(rx_z - tx_z, 2))')} AS distance_m,
  {sr('SQRT(POW(rx_x - tx_x, 2) + POW(rx_y - tx_y, 2))')} AS distance_2d_m,
  {sr('(tx_x + rx_x) / 2')} AS x_mid_m, {sr('(tx_y + rx_y) / 2')} AS y_mid_m,
  {sr('ATAN2(rx_y - tx_y, rx_x - tx_x)')} AS bearing_rad FROM lk""", ("fx_points",))
def b7(spark, sf):
    links = L.link_geometry(L.build_links(B.points(spark, sf)))
    names = ["distance_m", "distance_2d_m", "x_mid_m", "y_mid_m", "bearing_rad"]
    return links.select("tx", "rx", *[r(F.col(n)).alias(n) for n in names])


@query("b8_resolve_roles", f"SELECT bs AS tx, ue AS rx, {sr('rssi_dbm')} AS rssi_dbm FROM fx_rss", ("fx_rss",))
def b8(spark, sf):
    return L.resolve_roles(B.rss(spark, sf), "downlink").select(
        "tx", "rx", r(F.col("rssi_dbm")).alias("rssi_dbm")
    )


@query("b9_apply_reciprocity", """SELECT rx AS tx, tx AS rx, tx_ant AS rx_ant, rx_ant AS tx_ant, path
  FROM fx_paths""", ("fx_paths",))
def b9(spark, sf):
    return L.apply_reciprocity(B.paths(spark, sf)).select("tx", "rx", "rx_ant", "tx_ant", "path")


@query("b10_classify_path_type", """SELECT CASE flag WHEN 'A' THEN 'los' WHEN 'N' THEN 'reflection' ELSE 'mixed' END
  AS path_type, COUNT(*) AS n_paths FROM fx_paths GROUP BY 1""", ("fx_paths",))
def b10(spark, sf):
    kind = P.path_type(F.col("interactions")).alias("path_type")
    return B.paths(spark, sf).groupBy(kind).agg(F.count(F.lit(1)).alias("n_paths"))


@query("b11_path_depth", """SELECT tx, rx, SUM(LEN(interactions)) AS total_depth, MAX(LEN(interactions)) AS max_depth
  FROM fx_paths GROUP BY tx, rx""", ("fx_paths",))
def b11(spark, sf):
    depth = P.path_depth(F.col("interactions")).cast("bigint")
    return B.paths(spark, sf).groupBy("tx", "rx").agg(
        F.sum(depth).alias("total_depth"), F.max(depth).alias("max_depth")
    )


@query("b12_path_polyline", """SELECT tx, rx, path, LEN(interactions) + 2 AS vertex_count,
  CAST(tx AS VARCHAR) || CASE WHEN LEN(interactions) > 0 THEN ',' || (path + 1) ELSE '' END ||
  CASE WHEN LEN(interactions) > 1 THEN ',' || (path + 2) ELSE '' END || ',' || rx AS line_x
  FROM fx_paths""", ("fx_paths",))
def b12(spark, sf):
    def point(x, y, z):
        return F.struct(x.cast("bigint").alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))

    vertices = F.transform(  # padded to three slots; only the first ``depth`` are real
        F.sequence(F.lit(1), F.lit(3)), lambda i: point(F.col("path") + i, 0.0, 1.0)
    )
    line = P.path_polyline(point(F.col("tx"), 0.0, 1.5), vertices, point(F.col("rx"), 5.0, 3.0),
                           P.path_depth(F.col("interactions")))
    return B.paths(spark, sf).withColumn("line", line).select(
        "tx", "rx", "path", F.size("line").cast("bigint").alias("vertex_count"),
        F.concat_ws(",", F.transform("line", lambda p: p["x"].cast("string"))).alias("line_x"),
    )


@query("b13_path_gain_db", f"""SELECT tx, rx, path,
  {sr(f'20 * LOG10(GREATEST(SQRT{P2}, 1e-30::DOUBLE))')} AS gain_db FROM fx_paths""", ("fx_paths",))
def b13(spark, sf):
    gain = PW.path_gain_db(F.col("a_re"), F.col("a_im"))
    return B.paths(spark, sf).select("tx", "rx", "path", r(gain).alias("gain_db"))


@query("b14_nlos_paths", f"""SELECT tx, rx, rx_ant, tx_ant, path, {sr('tau_s * 1e9')} AS tau_ns, {sr('phi_r')} AS phi_r,
  {sr('theta_r')} AS theta_r, {sr('phi_t')} AS phi_t, {sr('theta_t')} AS theta_t,
  {sr(f'10 * LOG10(GREATEST({P2}, 1e-30::DOUBLE))')} AS power_db FROM fx_paths WHERE flag <> 'A'""", ("fx_paths",))
def b14(spark, sf):
    names = ["phi_r", "theta_r", "phi_t", "theta_t", "power_db"]
    return PO.nlos_paths(B.paths(spark, sf)).select(
        *PO.PAIR, "path", r(F.col("tau_s") * 1e9).alias("tau_ns"),
        *[r(F.col(n)).alias(n) for n in names],
    )


@query("b15_frequency_grid", f"""SELECT source_scene_index, k,
  {sr('3.5e9::DOUBLE + (k - (bs_count - 1) / 2.0) * (20e6 / bs_count)', 3)} AS f_hz
  FROM (SELECT *, UNNEST(RANGE(bs_count)) AS k FROM fx_scenes) t""", ("fx_scenes",))
def b15(spark, sf):
    freqs = grid.frequency_grid(F.lit(3.5e9), F.lit(20e6), F.col("bs_count"))
    return B.scenes(spark, sf).select(
        "source_scene_index", F.posexplode(freqs).alias("k", "f")
    ).select("source_scene_index", F.col("k").cast("bigint").alias("k"), r(F.col("f"), 3).alias("f_hz"))


@query("b20_position_key", f"""SELECT role, idx, {sr('ROUND_EVEN(x * 0.37, 1)', 3)} AS kx,
  {sr('ROUND_EVEN(y * 0.37, 1)', 3)} AS ky FROM fx_points""", ("fx_points",))
def b20(spark, sf):
    return B.points(spark, sf).select(
        "role", "idx", r(G.position_key(F.col("x") * 0.37, 1), 3).alias("kx"),
        r(G.position_key(F.col("y") * 0.37, 1), 3).alias("ky"),
    )


@query("b21_link_valid_mask", """WITH o AS (SELECT ue, bs, CASE WHEN rssi_dbm > -60 THEN TRUE
  WHEN rssi_dbm < -120 THEN FALSE END AS obs FROM fx_rss)
  SELECT r.ue, r.bs, r.valid AND COALESCE(o.obs, TRUE) AS valid FROM fx_rss r JOIN o ON o.ue = r.ue AND o.bs = r.bs""",
       ("fx_rss",))
def b21(spark, sf):
    observed = F.when(F.col("rssi_dbm") > -60, True).when(F.col("rssi_dbm") < -120, False)
    return B.rss(spark, sf).select(
        "ue", "bs", L.link_valid_mask(F.col("valid"), observed).alias("valid")
    )


@query("c1_build_links", f"WITH {LINKS} SELECT * FROM lk", ("fx_points",))
def c1(spark, sf):
    return L.build_links(B.points(spark, sf)).select(
        "scene_id", "tx", "rx", "link_index",
        *[f"{s}_{c}" for s in ("tx", "rx") for c in "xyz"],
    )


@query("c2_attach_global_indices", """SELECT ue // 128 AS shard_index, ue % 128 AS ue_local, bs,
  CASE WHEN ue <= (SELECT MAX(idx) FROM fx_points WHERE role = 'ue') THEN ue END AS global_ue FROM fx_rss""",
       ("fx_rss", "fx_points"))
def c2(spark, sf):
    from channelspark.operators import shards as S

    users = B.points(spark, sf).where("role = 'ue'").select(F.col("idx").alias("ue"))
    shards = S.shard_table(S.assign_by_index(users, 128))
    local = B.rss(spark, sf).select(
        F.expr("ue div 128").alias("shard_index"), (F.col("ue") % 128).cast("int").alias("ue_local"),
        "bs",
    )
    return L.attach_global_indices(local, shards).select(
        "shard_index", F.col("ue_local").cast("bigint").alias("ue_local"), "bs", "global_ue"
    )


@query("c4_match_by_position", """WITH u AS (SELECT * FROM fx_points WHERE role = 'ue'),
  f AS (SELECT scene_id, x, y, MIN(idx) AS right_idx FROM u GROUP BY scene_id, x, y)
  SELECT u.scene_id, u.idx AS left_idx, f.right_idx FROM u JOIN f USING (scene_id, x, y)""", ("fx_points",))
def c4(spark, sf):
    users = B.points(spark, sf).where("role = 'ue'")
    return L.match_by_position(users, users, ["scene_id"]).select(
        "scene_id", "left_idx", "right_idx"
    )


@query("c5_check_position_tolerance", f"""WITH u AS (SELECT idx, x, y FROM fx_points WHERE role = 'ue'),
  d AS (SELECT GREATEST(ABS(x * 0.001), ABS(y * 0.0005)) AS d FROM u)
  SELECT COUNT(*) AS pairs, {sr('MAX(d)')} AS max_delta_m, COUNT(*) FILTER (d > 0.0028) AS violations FROM d""",
       ("fx_points",))
def c5(spark, sf):
    left = B.points(spark, sf).where("role = 'ue'").select("idx", "x", "y", "z")
    right = left.select("idx", (F.col("x") * 1.001).alias("x"), (F.col("y") * 1.0005).alias("y"), "z")
    out = L.position_tolerance(left, right, ["idx"], 0.0028)
    return out.withColumn("max_delta_m", r(F.col("max_delta_m")))


@query("c6_align_bs_order", """WITH a AS (SELECT DISTINCT ue, bs FROM fx_rss), b AS (SELECT DISTINCT ue, bs FROM fx_rss
  WHERE valid), k AS (SELECT a.ue, COUNT(*) AS n_left, COUNT(b.bs) AS n_right FROM a LEFT JOIN b
  ON a.ue = b.ue AND a.bs = b.bs GROUP BY a.ue)
  SELECT ue, n_left, n_right, n_right AS n_common, n_left = n_right AS same_set FROM k""", ("fx_rss",))
def c6(spark, sf):
    rss = B.rss(spark, sf)
    return L.align_stations(rss, rss.where("valid"), ["ue"])


@query("c7_common_links", """SELECT tx, rx FROM (SELECT tx, rx, COUNT(DISTINCT flag) AS n FROM fx_paths GROUP BY tx, rx)
  t WHERE n = (SELECT COUNT(DISTINCT flag) FROM fx_paths)""", ("fx_paths",))
def c7(spark, sf):
    rows = B.paths(spark, sf).select(
        "tx", "rx", P.path_type(F.col("interactions")).alias("variant")
    )
    return L.common_links(rows, ["tx", "rx"])


@query("c8_pairwise_variants", f"""SELECT a.tx, a.rx, a.k, a.rx_ant AS reference, b.rx_ant AS candidate,
  {sr('a.re')} AS ref_re, {sr('b.re')} AS cand_re FROM fx_cfr a JOIN fx_cfr b
  ON a.tx = b.tx AND a.rx = b.rx AND a.k = b.k AND a.rx_ant <> b.rx_ant""", ("fx_cfr",))
def c8(spark, sf):
    rows = B.samples(B.cfr(spark, sf)).select("tx", "rx", "k", "rx_ant", "re")
    out = L.pairwise_variants(rows, ["tx", "rx", "k"], ["re"], "rx_ant")
    return out.select(
        "tx", "rx", F.col("k").cast("bigint").alias("k"), "reference", "candidate",
        r(F.col("ref_re")).alias("ref_re"), r(F.col("cand_re")).alias("cand_re"),
    )


@query("c14_require_subset", """WITH e AS (SELECT DISTINCT ue, bs FROM fx_rss),
  q AS (SELECT u.idx AS ue, b.idx AS bs FROM fx_points u JOIN fx_points b USING (scene_id)
  WHERE u.role = 'ue' AND b.role = 'bs') SELECT q.ue, q.bs FROM q ANTI JOIN e USING (ue, bs)""",
       ("fx_rss", "fx_points"))
def c14(spark, sf):
    wanted = L.resolve_roles(L.build_links(B.points(spark, sf)), "uplink", inverse=True)
    return L.missing_indices(wanted.select("ue", "bs"), B.rss(spark, sf), ["ue", "bs"])


_PICK_SQL = """{alias} AS (SELECT tx, rx, tau_s, {az} AS az, {ze} AS ze FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tx, rx
  ORDER BY {order}, rx_ant, tx_ant, path) AS rn FROM fx_paths {where}) t WHERE rn = 1)"""


def _labels_sql(az: str, ze: str) -> str:
    first = _PICK_SQL.format(alias="f", az=az, ze=ze, order="tau_s", where="")
    strong = _PICK_SQL.format(alias="s", az=az, ze=ze, order=f"{P2} DESC", where="")
    los = _PICK_SQL.format(alias="l", az=az, ze=ze, order="tau_s", where="WHERE flag = 'A'")
    return f"""WITH {first}, {strong}, {los} SELECT f.tx, f.rx, {sr('f.tau_s * 1e9')} AS first_delay_ns,
      {sr('f.az')} AS first_azimuth_rad, {sr('f.ze')} AS first_zenith_rad,
      {sr('s.tau_s * 1e9')} AS strongest_delay_ns, {sr('s.az')} AS strongest_azimuth_rad,
      {sr('s.ze')} AS strongest_zenith_rad, {sr(f'l.tau_s * {C0}')} AS los_distance_m,
      {sr('l.az')} AS los_azimuth_rad, {sr('l.ze')} AS los_zenith_rad
      FROM f JOIN s USING (tx, rx) LEFT JOIN l USING (tx, rx)"""


def _labels(spark, sf, source):
    out = PO.link_path_labels(B.paths(spark, sf), source)
    angles = [f"{p}_{a}_rad" for p in ("first", "strongest", "los") for a in ("azimuth", "zenith")]
    return out.select(
        "tx", "rx", r(F.col("first_delay_s") * 1e9).alias("first_delay_ns"),
        r(F.col("strongest_delay_s") * 1e9).alias("strongest_delay_ns"),
        r(F.col("los_distance_m")).alias("los_distance_m"),
        *[r(F.col(n)).alias(n) for n in angles],
    )


@query("d1_first_strongest_los_path", _labels_sql("phi_r", "theta_r"), ("fx_paths",))
def d1(spark, sf):
    return _labels(spark, sf, "aoa")


@query("d2_receiver_angle_source", _labels_sql("phi_t", "theta_t"), ("fx_paths",))
def d2(spark, sf):
    return _labels(spark, sf, PO.angle_source(True, "uplink"))


@query("d3_link_summary", f"""WITH {LINK_SUMMARY} SELECT tx, rx, path_count, los_exists, nlos_exists,
  {sr('power_db')} AS power_db FROM ls""", ("fx_paths",))
def d3(spark, sf):
    return PO.link_summary(B.paths(spark, sf), 2, 2).withColumn("power_db", r(F.col("power_db")))


@query("d4_serving_rx", f"""WITH {LINK_SUMMARY} SELECT tx, rx AS serving_rx, {sr('power_db')} AS serving_power_db FROM
  (SELECT *, ROW_NUMBER() OVER (PARTITION BY tx ORDER BY ROUND(power_db, 9) DESC, rx) AS rn FROM ls) t WHERE rn = 1""",
       ("fx_paths",))
def d4(spark, sf):
    out = PO.serving_rx(PO.link_summary(B.paths(spark, sf), 2, 2))
    return out.withColumn("serving_power_db", r(F.col("serving_power_db")))


_CIR = """cir AS (SELECT tx, rx, rx_ant, tx_ant, path, 0 AS snapshot, a_re, a_im, tau_s, flag <> 'R' AS valid FROM fx_paths
  UNION ALL SELECT tx, rx, rx_ant, tx_ant, path, 1, a_re * 2, a_im * 2, tau_s + 5e-9, flag = 'R' AND rx = 1 FROM fx_paths)"""


@query("d5_delay_labels_from_cir", f"""WITH {_CIR},
  v AS (SELECT tx, rx, rx_ant, tx_ant, path FROM cir GROUP BY ALL HAVING BOOL_OR(valid)),
  z AS (SELECT c.* FROM cir c JOIN v USING (tx, rx, rx_ant, tx_ant, path) WHERE snapshot = 0),
  o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tx, rx ORDER BY tau_s, rx_ant, tx_ant, path) AS a,
  ROW_NUMBER() OVER (PARTITION BY tx, rx ORDER BY {P2} DESC, rx_ant, tx_ant, path) AS b FROM z)
  SELECT tx, rx, {sr('MAX(tau_s) FILTER (a = 1) * 1e9')} AS first_delay_ns,
  {sr('MAX(tau_s) FILTER (b = 1) * 1e9')} AS strongest_delay_ns FROM o GROUP BY tx, rx""", ("fx_paths",))
def d5(spark, sf):
    paths = B.paths(spark, sf)
    keys = [*PO.PAIR, "path"]
    mixed = P.path_type(F.col("interactions")) == "mixed"
    zero = paths.select(*keys, F.lit(0).alias("snapshot"), "a_re", "a_im", "tau_s",
                        (~mixed).alias("valid"))
    one = paths.select(*keys, F.lit(1).alias("snapshot"), (F.col("a_re") * 2).alias("a_re"),
                       (F.col("a_im") * 2).alias("a_im"), (F.col("tau_s") + 5e-9).alias("tau_s"),
                       (mixed & (F.col("rx") == 1)).alias("valid"))
    out = PO.delay_labels_from_cir(zero.unionByName(one))
    return out.select("tx", "rx", r(F.col("first_delay_s") * 1e9).alias("first_delay_ns"),
                      r(F.col("strongest_delay_s") * 1e9).alias("strongest_delay_ns"))


@query("d32_cir_to_cfr", f"""WITH f AS (SELECT k, 3.5e9::DOUBLE + (k - 7.5) * (20e6::DOUBLE / 16) AS f_hz
  FROM (SELECT UNNEST(RANGE(16)) AS k) t),
  p AS (SELECT tx, rx, rx_ant, tx_ant, k, a_re, a_im, -2 * PI() * f_hz * tau_s AS ph FROM fx_paths, f)
  SELECT tx, rx, rx_ant, tx_ant, k, {sr('SUM(a_re * COS(ph) - a_im * SIN(ph))')} AS re,
  {sr('SUM(a_re * SIN(ph) + a_im * COS(ph))')} AS im FROM p GROUP BY ALL""", ("fx_paths",))
def d32(spark, sf):
    out = PO.cir_to_cfr(
        B.paths(spark, sf), grid.frequency_grid(F.lit(3.5e9), F.lit(20e6), F.lit(16))
    )
    return out.select(*PO.PAIR, F.col("k").cast("bigint").alias("k"), r(F.col("re")).alias("re"),
                      r(F.col("im")).alias("im"))


@query("d40_path_scatter", f"""WITH {LINK_SUMMARY}, c AS (SELECT tx, rx FROM ls WHERE los_exists AND nlos_exists)
  SELECT tx, rx, rx_ant, tx_ant, path, {sr('tau_s * 1e9')} AS tau_ns, {sr('doppler_hz')} AS doppler_hz,
  {sr(f'20 * LOG10(GREATEST(SQRT{P2}, 1e-30::DOUBLE))')} AS gain_db FROM fx_paths JOIN c USING (tx, rx)""",
       ("fx_paths",))
def d40(spark, sf):
    paths = B.paths(spark, sf)
    chosen = PO.link_summary(paths, 2, 2).where("los_exists AND nlos_exists")
    out = PO.path_scatter(paths, chosen)
    return out.select(*PO.PAIR, "path", r(F.col("tau_s") * 1e9).alias("tau_ns"),
                      r(F.col("doppler_hz")).alias("doppler_hz"),
                      r(F.col("gain_db")).alias("gain_db"))


@query("d40_aoa_histogram", """SELECT bin, COUNT(*) AS n_paths FROM (SELECT LEAST(CAST(FLOOR((phi_r + 3.2) / 6.4 * 36)
  AS BIGINT), 35) AS bin FROM fx_paths WHERE flag <> 'A') t GROUP BY bin""", ("fx_paths",))
def d40_histogram(spark, sf):
    bin_ = grid.histogram_bin(F.col("phi_r"), -3.2, 3.2, 36).alias("bin")
    return PO.nlos_paths(B.paths(spark, sf)).groupBy(bin_).agg(
        F.count(F.lit(1)).alias("n_paths")
    )


@query("d41_link_overview", """WITH p AS (SELECT tx, rx, COUNT(DISTINCT path) AS n, BOOL_OR(flag = 'A') AS los,
  BOOL_OR(flag <> 'A') AS nlos FROM fx_paths WHERE flag <> 'R' OR rx_ant = 0 GROUP BY tx, rx),
  l AS (SELECT DISTINCT tx, rx FROM fx_paths)
  SELECT tx, rx, n IS NOT NULL AS valid, COALESCE(los, FALSE) AS los, COALESCE(nlos, FALSE) AS nlos,
  COALESCE(n, 0) AS path_count FROM l LEFT JOIN p USING (tx, rx)""", ("fx_paths",))
def d41(spark, sf):
    paths = B.paths(spark, sf)
    kept = paths.where((P.path_type(F.col("interactions")) != "mixed") | (F.col("rx_ant") == 0))
    return PO.link_overview(PO.link_summary(kept, 2, 2), paths)


@query("f3_topn_paths", """SELECT tx, rx, rx_ant, tx_ant, path FROM (SELECT *, ROW_NUMBER() OVER
  (PARTITION BY tx, rx, rx_ant, tx_ant ORDER BY path) AS rn FROM fx_paths) t WHERE rn <= 2""", ("fx_paths",))
def f3(spark, sf):
    return PO.first_paths(B.paths(spark, sf), 2).select(*PO.PAIR, "path")


@query("f7_intersect_links", """SELECT tx, rx FROM fx_paths WHERE flag = 'A' INTERSECT
  SELECT tx, rx FROM fx_paths WHERE flag = 'N'""", ("fx_paths",))
def f7(spark, sf):
    kind = P.path_type(F.col("interactions"))
    paths = B.paths(spark, sf)
    return paths.where(kind == "los").select("tx", "rx").intersect(
        paths.where(kind == "reflection").select("tx", "rx")
    )


@query("b1_complex_ops", f"""SELECT vec_id, k, {sr('SQRT(re * re + im * im)')} AS magnitude, {sr('ATAN2(im, re)')} AS phase,
  {sr('re * ere + im * eim')} AS conj_re, {sr('im * ere - re * eim')} AS conj_im FROM fx_est""", ("fx_est",))
def b1(spark, sf):
    pair = B.cfr_est(spark, sf).select("vec_id", F.posexplode(F.arrays_zip("h", "est")).alias("k", "s"))
    h = F.col("s.h.re"), F.col("s.h.im")
    e = F.col("s.est.re"), F.col("s.est.im")
    cre, cim = C.conj_product(*h, *e)
    return pair.select(
        "vec_id", F.col("k").cast("bigint").alias("k"), r(C.magnitude(*h)).alias("magnitude"),
        r(C.angle(*h)).alias("phase"), r(cre).alias("conj_re"), r(cim).alias("conj_im"),
    )
