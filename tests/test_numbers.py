"""Numeric operators against closed forms and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from channelspark.functions import complex as C
from channelspark.functions import grid
from channelspark.functions import power as PW
from channelspark.operators import cfr as K
from channelspark.operators import ranging as RG
from channelspark.operators import sequences as Q
from channelspark.operators import spectrum as SP
from channelspark.operators import summaries as S
from channelspark.operators.quantiles import exact_quantiles

C0 = PW.SPEED_OF_LIGHT_MPS


def cfr_rows(spark, vectors):
    """{(tx, rx, rx_ant): complex vector} to array rows."""
    rows = [(*key, [(float(z.real), float(z.imag)) for z in h]) for key, h in vectors.items()]
    return spark.createDataFrame(
        rows, "tx bigint, rx bigint, rx_ant bigint, h array<struct<re:double,im:double>>")


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice([1, 2, 3], 3000, p=[.8, .15, .05]),
                        "v": np.round(rng.normal(0, 10, 3000) ** 3, 2)})
    pdf.loc[pdf.index[:900], "v"] = 3.25  # one value holds a third of all rows
    probs = {"a": 0.0, "b": 0.5, "c": 0.8, "d": 0.95, "e": 1.0}
    out = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).toPandas()
    for row in out.itertuples():
        expected = np.quantile(pdf.v[pdf.g == row.g], list(probs.values()))
        assert np.allclose([row.a, row.b, row.c, row.d, row.e], expected, rtol=1e-12)
        assert row.n == (pdf.g == row.g).sum()
    odd = spark.createDataFrame([(None, 1.0), (None, 2.0), (7, None)], "g int, v double")
    assert [tuple(r) for r in exact_quantiles(odd, ["g"], "v", {"m": 0.5}).collect()] == [(None, 2, 1.5)]
    assert exact_quantiles(odd, [], "v", {"m": 0.5}).first().m == 1.5


def test_unwrap_matches_numpy(spark):
    rng = np.random.default_rng(1)
    phase = rng.uniform(-np.pi, np.pi, 200)
    phase[10:12] = [-np.pi / 2, np.pi / 2]  # a step of exactly +pi stays
    df = spark.createDataFrame([(0, k, float(p)) for k, p in enumerate(phase)],
                               "v int, k int, phase double")
    got = [r.unwrapped for r in Q.unwrap_phase(df, ["v"], "phase").orderBy("k").collect()]
    assert np.allclose(got, np.unwrap(phase), atol=1e-9)


def grid64():
    return (np.arange(64) - 31.5) * 20e6 / 64


def test_single_path_ranging(spark):
    tau = 120e-9
    h = np.exp(-2j * np.pi * grid64() * tau)
    cfr = cfr_rows(spark, {(0, 0, 0): h, (1, 0, 0): h, (2, 0, 0): 0 * h,
                           (3, 0, 0): h, (3, 0, 1): h * np.nan})
    truth = spark.createDataFrame([(0, 0, tau), (1, 0, None), (2, 0, tau), (3, 0, tau)],
                                  "tx bigint, rx bigint, truth_delay_s double")
    options = RG.PdpOptions(20e6 / 64, 64, min_peak_snr_db=0.0)
    pdp = {r.tx: r for r in RG.pdp_peak_ranging(cfr, options, truth).collect()}
    slope = {r.tx: r for r in RG.phase_slope_ranging(cfr, 20e6 / 64, 64, truth).collect()}
    for result in (pdp, slope):
        assert abs(result[0].toa_s - tau) < 2e-9 and abs(result[0].error_m) < 0.7
        assert result[0].rtt_s == pytest.approx(2 * result[0].toa_s)
        assert not result[1].success and result[1].range_m is None  # no truth
        assert not result[2].success and result[2].toa_s is None  # no power
    assert pdp[2].delay_bin == -1
    assert not pdp[3].success  # one antenna without finite samples spoils the mean profile
    assert slope[3].success  # but only drops out of the slope medians
    with pytest.raises(ValueError):
        RG.run_ranging(cfr, truth, 1.0, 64, ["pdp_peak"], "phase_slope")


def test_earliest_peak_wins(spark):
    f = grid64()
    h = 0.7 * np.exp(-2j * np.pi * f * 100e-9) + np.exp(-2j * np.pi * f * 600e-9)
    truth = spark.createDataFrame([(0, 0, 100e-9)], "tx bigint, rx bigint, truth_delay_s double")
    options = RG.PdpOptions(20e6 / 64, 64, min_peak_snr_db=0.0)
    row = RG.pdp_peak_ranging(cfr_rows(spark, {(0, 0, 0): h}), options, truth).first()
    assert abs(row.toa_s - 100e-9) < 10e-9


def test_plane_wave_peaks_at_its_angle(spark):
    layout = SP.ArrayLayout(4, 4)
    angles = SP.AngleGrid((0.2, 2.8, 14), (-1.4, 1.4, 15))
    zen, azi = 1.2, 0.4
    direction = np.array([np.sin(zen) * np.cos(azi), np.sin(zen) * np.sin(azi), np.cos(zen)])
    wave = np.exp(2j * np.pi * layout.positions() @ direction)
    cfr = cfr_rows(spark, {(0, 0, a): np.full(3, wave[a]) for a in range(16)})
    silent = cfr_rows(spark, {(9, 0, a): np.zeros(3, complex) for a in range(16)})
    cov = SP.rx_covariance(cfr.unionByName(silent), ["tx", "rx"])
    spectra = SP.bartlett_spectrum(cov, ["tx", "rx"], layout, angles)
    rows = SP.spectrum_rows(spectra, ["tx", "rx"], angles).toPandas()
    assert set(rows.tx) == {0}  # a link without power has no spectrum
    best = rows.loc[rows.power.idxmax()]
    assert (best.zenith_idx, best.azimuth_idx) == (5, 9)
    assert best.power == 1.0


def test_similarity_edge_cases(spark):
    rows = [(1, 0., 0., 0., 0.), (2, 1., 1., 1., 1.), (3, 1., 0., -1., 0.),
            (4, None, 0., 1., 0.), (5, float("nan"), 0., 1., 0.)]
    df = spark.createDataFrame(rows, "g int, l_re double, l_im double, r_re double, r_im double")
    out = {r.g: r for r in K.similarity(df, ["g"]).collect()}
    assert out[1].magnitude == 1.0 and out[1].phase == 1.0  # both zero
    assert out[2].i == 1.0 and out[2].phase == pytest.approx(1.0)
    assert out[3].magnitude == 1.0 and out[3].i == 0.0 and out[3].phase == pytest.approx(0.0)
    assert out[4].magnitude is None and out[5].q is None  # no usable sample


def test_power_functions(spark):
    one = spark.range(1)
    noise = PW.thermal_noise_dbm(F.lit(20e6), F.lit(5.0), F.lit(290.0))
    assert one.select(noise).first()[0] == pytest.approx(-173.975187 + 73.0103 + 5, abs=1e-4)
    bad = one.select(PW.thermal_noise_dbm(F.lit(0.0), F.lit(5.0), F.lit(290.0)).alias("x"))
    with pytest.raises(Exception, match="positive"):
        bad.collect()
    assert one.select(PW.mw_to_dbm(F.lit(0.0))).first()[0] == -300.0
    assert one.select(C.wrap_phase(F.lit(float(np.pi)))).first()[0] == pytest.approx(-np.pi)


def test_sounding_grid(spark):
    prbs = grid.symbol_prbs(1, 768, bwp_num_prb=64)
    assert prbs == [(0, 64)]
    size = spark.range(1).select(F.size(grid.resource_subcarriers(
        *[F.lit(v) for v in (0, 64, 2, 0, 768)]))).first()[0]
    assert size == 384
    with pytest.raises(ValueError):
        grid.symbol_prbs(1, 768, bwp_start_prb=60, bwp_num_prb=8)
    assert grid.symbol_prbs(2, 768, bwp_num_prb=8, hopping_offsets=[0, 16], hopping_counts=[8, 4]
                            ) == [(0, 8), (16, 4)]


def test_interpolation_matches_numpy(spark):
    known = {3: 1.0, 7: 5.0, 8: -2.0}
    rows = [(0, k, v) for k, v in known.items()] + [(0, 7, 7.0), (1, 4, 9.0)]
    df = spark.createDataFrame(rows, "v int, k int, re double")
    out = Q.linear_interpolate(df, ["v"], ["re"], 12).toPandas().sort_values("k")
    expected = np.interp(np.arange(12), [3, 7, 8], [1.0, 6.0, -2.0])
    assert np.allclose(out.re[out.v == 0], expected)
    assert (out.re[out.v == 1] == 9.0).all() and (out.v == 1).sum() == 12


def test_weighted_median_and_line(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 5.0), (0, 9.0, 1.0)],
                               "g int, v double, w double")
    assert Q.weighted_median(df, ["g"], "v", "w").first().median == 2.0
    flat = spark.createDataFrame([(0, 4.0, 1.0, 1.0), (0, 4.0, 3.0, 1.0)],
                                 "g int, x double, y double, w double")
    row = Q.weighted_line_fit(flat, ["g"], "x", "y", "w").first()
    assert row.slope == 0.0 and row.intercept == 2.0


def test_normalisation_of_a_constant_range(spark):
    df = spark.createDataFrame([("c", "m", 2.0), ("c", "m", float("nan")), ("d", "m", 2.0)],
                               "comparison string, metric string, value double")
    for scope in S.SCOPES:
        got = sorted((r.normalized for r in S.normalize_minmax(df, scope).collect()), key=str)
        assert got == [1.0, 1.0, None]
