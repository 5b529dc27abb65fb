"""Array covariance and spatial spectra."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from channelspark.functions import complex as C
from channelspark.functions import grid


LINK_SLICE = 64  # links whose products with the steering matrix are held at once


@dataclass(frozen=True)
class ArrayLayout:
    """Planar receive array: element a = column * rows + row, spacing in wavelengths."""

    rows: int
    cols: int
    vertical_spacing: float = 0.5
    horizontal_spacing: float = 0.5

    @property
    def size(self) -> int:
        return self.rows * self.cols

    def positions(self) -> np.ndarray:
        """[element, xyz]; the array lies in the yz plane, first row on top."""
        index = np.arange(self.size)
        col, row = index // self.rows, index % self.rows
        y = (col - (self.cols - 1) / 2) * self.horizontal_spacing
        z = ((self.rows - 1) / 2 - row) * self.vertical_spacing
        return np.stack([np.zeros(self.size), y, z], axis=1)


@dataclass(frozen=True)
class AngleGrid:
    zenith: tuple[float, float, int]
    azimuth: tuple[float, float, int]

    def directions(self) -> np.ndarray:
        """Unit vectors [zenith * azimuth, xyz], azimuth fastest."""
        zen = np.array(grid.linspace(*self.zenith))[:, None]
        azi = np.array(grid.linspace(*self.azimuth))[None, :]
        x, y = np.sin(zen) * np.cos(azi), np.sin(zen) * np.sin(azi)
        z = np.broadcast_to(np.cos(zen), x.shape)
        return np.stack([x, y, z], axis=-1).reshape(-1, 3)


GRAM_TYPE = "array<struct<i: bigint, j: bigint, re: double, im: double, n: bigint>>"


def _gram(ants: np.ndarray, lengths: np.ndarray, x: np.ndarray) -> list[dict]:
    """Upper half of X X^H: sums over samples for every two antenna rows, with the samples that both have."""
    sums = x @ x.conj().T
    upper = [(a, b) for a in range(len(ants)) for b in range(len(ants)) if (ants[a], a) <= (ants[b], b)]
    return [{"i": int(ants[a]), "j": int(ants[b]), "re": float(sums[a, b].real), "im": float(sums[a, b].imag),
             "n": int(min(lengths[a], lengths[b]))} for a, b in upper]


def _finite(values: Sequence[float | None]) -> np.ndarray:
    """Missing and non-finite samples count as zero."""
    own = np.array(values, float)
    return np.where(np.isfinite(own), own, 0.0)


def _gram_blocks(rows: pd.Series) -> pd.Series:
    """One block per row; the row holds the antennas that share a transmit antenna."""
    out = []
    for ants in rows:
        lengths = np.array([0 if a["re"] is None else len(a["re"]) for a in ants])
        x = np.zeros((len(ants), lengths.max(initial=0)), complex)
        for at, (own, n) in enumerate(zip(ants, lengths)):
            if n:
                x[at, :n] = _finite(own["re"]) + 1j * _finite(own["im"])
        out.append(_gram(np.array([a["ant"] for a in ants]), lengths, x))
    return pd.Series(out, dtype=object)


def rx_covariance(cfr: DataFrame, link: Sequence[str]) -> DataFrame:
    """R[i, j] = mean of x_i * conj(x_j) over subcarriers and, where there are any, transmit antennas.

    The receive antennas of a link that share a transmit antenna form one block, whose Gram matrix is one product in
    the task; only the upper half of each block is summed over transmit antennas, and mirrored at the end. Links without any power are left
    out. Snapshots are never mixed: if the table has them, ``link`` must name them.
    """
    if "snapshot" in cfr.columns and "snapshot" not in link:
        raise ValueError("link must contain snapshot")
    meet = [*link, *(c for c in ("tx_ant",) if c in cfr.columns and c not in link)]
    rows = cfr.groupBy(*meet).agg(F.collect_list(F.struct(
        F.col("rx_ant").cast("bigint").alias("ant"), F.col("h.re").alias("re"), F.col("h.im").alias("im"))).alias("rows"))
    half = rows.select(*link, F.inline(pandas_udf(_gram_blocks, GRAM_TYPE)("rows")))
    summed = half.groupBy(*link, "i", "j").agg(
        F.try_divide(F.sum("re"), F.sum("n")).alias("re"), F.try_divide(F.sum("im"), F.sum("n")).alias("im"))
    active = summed.where((F.col("i") == F.col("j")) & (F.col("re") > 0)).select(*link).distinct()
    ij = F.struct("i", "j", "re", "im")
    ji = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "re", (-F.col("im")).alias("im"))
    both = F.when(F.col("i") == F.col("j"), F.array(ij)).otherwise(F.array(ij, ji))
    return summed.join(active, list(link), "left_semi").select(*link, F.inline(both))


def _rotation(angles: np.ndarray) -> np.ndarray:
    """Rz(alpha) @ Ry(beta) @ Rx(gamma)."""
    (a, b, c) = angles
    rz = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    ry = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    rx = np.array([[1, 0, 0], [0, np.cos(c), -np.sin(c)], [0, np.sin(c), np.cos(c)]])
    return rz @ ry @ rx


def bartlett_spectrum(
    covariance: DataFrame, link: Sequence[str], layout: ArrayLayout, angles: AngleGrid,
    orientation: DataFrame | None = None,
) -> DataFrame:
    """max(a^H R a, 0) on the angle grid, divided by the link's peak.

    One row per link is sent to numpy in Arrow batches; the steering matrix depends only on the
    array, the grid and the receiver rotation. ``orientation`` has rx, alpha, beta, gamma. Antennas
    that a link lacks count as zero; an antenna outside the layout is an error.
    """
    size = layout.size
    outside = F.when((F.least("i", "j") < 0) | (F.greatest("i", "j") >= size),
                     F.raise_error(F.lit("an antenna lies outside the array layout")).cast("bigint"))
    element = F.struct(F.coalesce(outside, F.col("i") * size + F.col("j")).alias("at"), "re", "im")
    packed = covariance.groupBy(*link).agg(F.sort_array(F.collect_list(element)).alias("r"))
    if orientation is not None:
        packed = packed.join(orientation, "rx", "left")
        turn = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ("alpha", "beta", "gamma")])
    else:
        turn = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    directions, positions = angles.directions(), layout.positions()

    @pandas_udf("array<double>")
    def spectrum(at: pd.Series, re: pd.Series, im: pd.Series, turns: pd.Series) -> pd.Series:
        if not len(re):
            return pd.Series([], dtype=object)
        cov = np.zeros((len(at), size * size), complex)
        for row, (places, real, imaginary) in enumerate(zip(at, re, im)):
            cov[row, places] = _finite(real) + 1j * _finite(imaginary)
        cov = cov.reshape(-1, size, size)
        all_turns = np.stack(turns.to_numpy())
        out = np.zeros((len(cov), len(directions)))
        for turned in np.unique(all_turns, axis=0):
            rows = np.all(all_turns == turned, axis=1)
            placed = positions @ _rotation(turned).T
            steering = np.exp(2j * np.pi * directions @ placed.T) / np.sqrt(size)
            for part in np.array_split(np.flatnonzero(rows), -(-rows.sum() // LINK_SLICE)):
                seen = steering.conj() @ cov[part]  # [link, direction, element]
                power = np.maximum((seen * steering).sum(axis=2).real, 0.0)
                peak = power.max(axis=1, keepdims=True)
                out[part] = np.divide(power, peak, out=np.zeros_like(power), where=peak > 0)
        return pd.Series(list(out))

    return packed.select(
        *link, spectrum(F.col("r.at"), F.col("r.re"), F.col("r.im"), turn).alias("spectrum")
    )


def spectrum_rows(spectra: DataFrame, link: Sequence[str], angles: AngleGrid) -> DataFrame:
    """One row per grid angle: zenith_idx, azimuth_idx, power."""
    n_azimuth = angles.azimuth[2]
    return spectra.select(*link, F.posexplode("spectrum").alias("at", "power")).select(
        *link, F.floor(F.col("at") / n_azimuth).alias("zenith_idx"),
        (F.col("at") % n_azimuth).cast("bigint").alias("azimuth_idx"), "power",
    )


def angle_label(labels: DataFrame, zenith: str, azimuth: str, angles: AngleGrid) -> DataFrame:
    """Nearest grid bin of a labelled angle: the single 1 of the one-hot heat map."""
    finite = C.is_finite(F.col(zenith)) & C.is_finite(F.col(azimuth))
    return labels.withColumns({
        "zenith_idx": F.when(finite, grid.nearest_bin(F.col(zenith), *angles.zenith)),
        "azimuth_idx": F.when(finite, grid.nearest_bin(F.col(azimuth), *angles.azimuth)),
    })


def row_limits(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Colour range per key; a constant or empty range gets a stable fallback."""
    v = C.nan_to_null(F.col(value))
    limits = values.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    spread = hi > lo
    return limits.select(
        *keys,
        F.when(spread, lo).when(hi > 0, F.lit(0.0)).when(lo < 0, lo).otherwise(F.lit(0.0))
        .alias("vmin"),
        F.when(spread, hi).when(hi > 0, hi).when(lo < 0, F.lit(0.0)).otherwise(F.lit(1.0))
        .alias("vmax"),
    )
