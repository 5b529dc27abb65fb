"""Antenna, snapshot and missing-key cases that the fixtures do not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelspark.operators import quality as QA
from channelspark.operators import ranging as RG
from channelspark.operators import spectrum as SP

CFR = "snapshot long, tx long, rx long, rx_ant long, tx_ant int, h array<struct<re:double,im:double>>"


def responses(spark, delays, n=32, spacing=1e6):
    """One exact path per snapshot and transmit antenna: {(snapshot, tx_ant): delay}."""
    f = (np.arange(n) - (n - 1) / 2) * spacing
    rows = []
    for (snapshot, tx_ant), delay in delays.items():
        h = np.exp(-2j * np.pi * f * delay) * (1 + tx_ant)
        for rx_ant in (0, 1):
            rows.append((snapshot, 1, 2, rx_ant, tx_ant, [(float(x.real), float(x.imag)) for x in h]))
    return spark.createDataFrame(rows, CFR)


def test_covariance_pairs_antennas_at_the_same_transmit_antenna(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 2, 8)) + 1j * rng.normal(size=(2, 2, 8))  # rx_ant, tx_ant, subcarrier
    rows = [(0, 1, 2, r, t, [(float(v.real), float(v.imag)) for v in x[r, t]]) for r in (0, 1) for t in (0, 1)]
    cfr = spark.createDataFrame(rows, CFR)
    got = {(r.i, r.j): complex(r.re, r.im) for r in SP.rx_covariance(cfr, ["snapshot", "tx", "rx"]).collect()}
    want = np.einsum("itk,jtk->ij", x, x.conj()) / 16
    assert all(abs(got[i, j] - want[i, j]) < 1e-12 for i in (0, 1) for j in (0, 1))
    with pytest.raises(ValueError):
        SP.rx_covariance(cfr, ["tx", "rx"])


def test_phase_slope_per_snapshot_and_transmit_antenna(spark):
    cfr = responses(spark, {(0, 0): 4e-8, (0, 1): 4e-8, (1, 0): 9e-8, (1, 1): 9e-8})
    truth = spark.createDataFrame([(1, 2, 4e-8)], "tx long, rx long, truth_delay_s double")
    got = {r.snapshot: r for r in RG.phase_slope_ranging(cfr, 1e6, 32, truth).collect()}
    assert got[0].toa_s == pytest.approx(4e-8) and got[1].toa_s == pytest.approx(9e-8)
    assert got[0].residual_rad == pytest.approx(0, abs=1e-9) and got[1].residual_rad == pytest.approx(0, abs=1e-9)


def test_delay_profile_per_snapshot(spark):
    cfr = responses(spark, {(0, 0): 1e-7, (0, 1): 1e-7, (1, 0): 3e-7, (1, 1): 3e-7})
    truth = spark.createDataFrame([(1, 2, 1e-7)], "tx long, rx long, truth_delay_s double")
    got = {r.snapshot: r.toa_s for r in RG.pdp_peak_ranging(cfr, RG.PdpOptions(1e6, 32), truth).collect()}
    assert got[0] == pytest.approx(1e-7, abs=4e-9) and got[1] == pytest.approx(3e-7, abs=4e-9)
    both = RG.run_ranging(cfr, truth, 1e6, 32)
    assert both.count() == 4 and "snapshot" in both.columns


def test_repeated_antenna_pair_is_an_error(spark):
    cfr = responses(spark, {(0, 0): 1e-7})
    truth = spark.createDataFrame([(1, 2, 1e-7)], "tx long, rx long, truth_delay_s double")
    with pytest.raises(Exception, match="occurs twice"):
        RG.phase_slope_ranging(cfr.union(cfr), 1e6, 32, truth).collect()


def details(df):
    return sorted((r.key, r.detail) for r in df.collect())


def test_shards_and_plans_without_each_other(spark):
    shards = spark.createDataFrame(
        [("a", 0, 2, [1, 2]), ("x", 77, 9, [1])], "run string, shard_index int, ue_count long, ue_indices array<long>")
    planned = spark.createDataFrame([("a", 1), ("b", 2)], "run string, shard_count int")
    users = spark.createDataFrame([("a", 0, 9), ("b", 0, 9), ("x", 0, 9)], "run string, first long, last long")
    assert details(QA.shard_indices(shards, ["run"], planned, users)) == [("b", "no shard"), ("x-77", "no plan")]


def test_fragments_and_totals_without_each_other(spark):
    fragments = spark.createDataFrame(
        [("a", 0, 0, 2), ("x", 0, 0, 0)], "run string, shard_index int, offset long, ue_count long")
    totals = spark.createDataFrame([("a", 2), ("b", 5)], "run string, total long")
    assert details(QA.bundle_offsets(fragments, ["run"], totals)) == [
        ("b", "no fragment"), ("x", "no total"), ("x-0", "count below 1")]


def test_absent_keys_and_unknown_scenes(spark):
    rows = spark.createDataFrame([(1,), (1,), (3,)], "link long")
    axis = spark.createDataFrame([(1,), (2,)], "link long")
    assert details(QA.rows_per_key(rows, "t", ["link"], 2, axis=axis)) == [("2", "0"), ("3", "1")]
    points = spark.createDataFrame([(1, "ue"), (1, "bs")], "scene_id long, role string")
    links = spark.createDataFrame([(1, 1.0), (9, 1.0)], "scene_id long, d double")
    assert details(QA.link_table(links, points, [])) == [("9", "1")]
    assert details(QA.link_table(links.limit(0), points.limit(0), ["d"])) == [("d", "unit missing")]


def test_samples_of_a_capture_are_finite(spark):
    schema = "id long, fft int, cp int, symbols int, sample_count int, samples array<struct<re:double,im:double>>"
    rows = spark.createDataFrame([(1, 2, 0, 1, 2, [(0.0, 1.0)] * 2), (2, 2, 0, 1, 2, [(0.0, 1.0), (float("nan"), 0.0)])], schema)
    assert details(QA.iq_layout(rows, ["id"])) == [("2", "not finite")]


def test_spectrum_of_a_link_without_all_antennas(spark):
    """Antennas that a link lacks count as zero, next to links that have them all."""
    layout, angles = SP.ArrayLayout(2, 2), SP.AngleGrid((0.2, 2.8, 5), (-1.4, 1.4, 6))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4, 8)) + 1j * rng.normal(size=(4, 8))
    held = {1: (0, 1, 2, 3), 2: (0, 3), 3: (2,)}
    rows = [(0, tx, 2, a, 0, [(float(v.real), float(v.imag)) for v in x[a]]) for tx, ants in held.items() for a in ants]
    link = ["snapshot", "tx", "rx"]
    spectra = SP.bartlett_spectrum(SP.rx_covariance(spark.createDataFrame(rows, CFR), link), link, layout, angles)
    got = {r.tx: r.spectrum for r in spectra.collect()}
    steering = np.exp(2j * np.pi * angles.directions() @ layout.positions().T)
    assert set(got) == set(held)
    for tx, ants in held.items():
        power = (abs(steering[:, ants].conj() @ x[list(ants)]) ** 2).sum(axis=1)
        np.testing.assert_allclose(got[tx], power / power.max(), atol=1e-12)
    with pytest.raises(Exception, match="outside the array"):
        SP.bartlett_spectrum(SP.rx_covariance(spark.createDataFrame(rows, CFR), link), link, SP.ArrayLayout(1, 2), angles).collect()


def test_delay_profiles_are_handed_on_in_slices():
    """A batch of any size leaves a Python worker in slices; its profiles are never held together."""
    import pandas as pd

    options, rng = RG.PdpOptions(1e6, 32), np.random.default_rng(6)
    h = rng.normal(size=(1000, 32)) + 1j * rng.normal(size=(1000, 32))
    batch = (pd.Series(list(h.real)), pd.Series(list(h.imag)))
    parts = list(RG.delay_power(options).func(iter([batch, (batch[0][:0], batch[1][:0])])))
    assert max(map(len, parts)) <= RG.ROW_SLICE
    want = abs(np.fft.ifft(h * np.hanning(32), n=256, axis=1)) ** 2
    np.testing.assert_allclose(np.stack([row for part in parts for row in part]), want)
