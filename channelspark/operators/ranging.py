"""Time-of-arrival ranging from estimated channel responses.

Input: array rows (tx, rx, rx_ant, h), with snapshot and tx_ant where there are any. Each snapshot of
a link is ranged by itself over all its antenna pairs. Both estimators shuffle these compact rows by link
once; unnesting, windows and reductions all reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from channelspark.functions import complex as C
from channelspark.functions import power as PW
from channelspark.operators import sequences as Q

LINK = ["tx", "rx"]
ROW_SLICE = 256  # rows whose oversampled profiles are held at once


def link_keys(cfr: DataFrame) -> list[str]:
    """What a range is estimated for: the link, per snapshot if the table has snapshots."""
    return [*(c for c in ("snapshot",) if c in cfr.columns), *LINK]


def pair_keys(cfr: DataFrame) -> list[str]:
    """What identifies one response: the link and its antennas."""
    return [*link_keys(cfr), "rx_ant", *(c for c in ("tx_ant",) if c in cfr.columns)]


@dataclass(frozen=True)
class PdpOptions:
    """Fixed defaults of the delay-profile estimator."""

    spacing_hz: float
    subcarriers: int
    oversampling: int = 8
    window: str = "hann"
    relative_threshold_db: float = -12.0
    min_peak_snr_db: float = 6.0
    interpolation: str = "parabolic_log_power"
    max_delay_s: float | None = None

    @property
    def n_fft(self) -> int:
        return self.subcarriers * self.oversampling

    @property
    def delay_step_s(self) -> float:
        return 1.0 / (self.spacing_hz * self.n_fft)

    @property
    def bins(self) -> int:
        if self.max_delay_s is None:
            return self.n_fft
        return max(1, min(self.n_fft, int(self.max_delay_s / self.delay_step_s) + 1))

    def weights(self) -> np.ndarray:
        if self.window == "hann":
            return np.hanning(self.subcarriers)
        if self.window == "rect":
            return np.ones(self.subcarriers)
        raise ValueError("window must be hann or rect")


def delay_power(options: PdpOptions) -> Callable[[Column, Column], Column]:
    """Arrow-batched inverse FFT: (re array, im array) -> power per delay bin.

    Profiles are handed on a slice of rows at a time, so a Python worker never holds a batch's profiles.
    """
    weights, n_fft, bins = options.weights(), options.n_fft, options.bins

    @pandas_udf("array<double>")
    def power(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for re, im in batches:
            for s in range(0, len(re), ROW_SLICE):
                h = np.stack(re.iloc[s : s + ROW_SLICE]) + 1j * np.stack(im.iloc[s : s + ROW_SLICE])
                yield pd.Series(list(np.abs(np.fft.ifft(h * weights, n=n_fft, axis=1)[:, :bins]) ** 2))

    return power


def power_delay_profile(cfr: DataFrame, options: PdpOptions) -> DataFrame:
    """Power per delay bin, averaged over the antenna pairs of each link.

    A pair with non-finite samples has no profile (NULLs), and then its link has none either.
    """
    link = link_keys(cfr)
    by_link = cfr.select(*link, "h").repartition(*link)
    power = delay_power(options)(F.col("h.re"), F.col("h.im"))
    complete = F.count("p") == F.count(F.lit(1))
    return (
        by_link.select(*link, F.posexplode(power).alias("bin", "p"))
        .groupBy(*link, "bin").agg(F.when(complete, F.avg("p")).alias("power"))
    )


def pdp_peak_ranging(cfr: DataFrame, options: PdpOptions, truth: DataFrame) -> DataFrame:
    """First detectable peak of the delay profile per link; ``truth`` has tx, rx, truth_delay_s.

    Links without a truth delay, without power or below the peak SNR fail: NULLs and bin -1.
    """
    link = link_keys(cfr)
    profile = power_delay_profile(cfr, options)
    whole = W.partitionBy(*link)
    near = Q.with_neighbours(profile, link).withColumns({
        "strongest": F.max("power").over(whole), "floor": F.median("power").over(whole),
    }).withColumn(
        "strongest_bin", F.min(F.when(F.col("power") == F.col("strongest"), F.col("bin"))).over(whole)
    )
    ratio = 10.0 ** (options.relative_threshold_db / 10.0)
    candidates = near.where(
        C.is_finite(F.col("strongest")) & (F.col("strongest") > 0)
        & Q.is_local_peak(F.col("power"), F.col("left"), F.col("right"))
        & (F.col("power") >= F.col("strongest") * ratio)
        & (F.col("bin") <= F.col("strongest_bin"))
    )
    picked = Q.first_peak_cluster(
        candidates, link, max(1, options.oversampling), ["left", "right", "strongest", "floor"]
    )
    snr = 10 * F.log10(F.greatest(
        F.col("strongest") / F.greatest(F.col("floor"), F.lit(Q.TINY)), F.lit(Q.TINY)))
    offset = F.lit(0.0)
    if options.interpolation == "parabolic_log_power":
        offset = Q.parabolic_offset(F.col("power"), F.col("left"), F.col("right"))
    detected = picked.withColumn("peak_snr_db", snr).where(
        F.col("peak_snr_db") >= options.min_peak_snr_db
    ).select(
        *link, F.col("bin").alias("delay_bin"), F.col("power").alias("peak_power"), "peak_snr_db",
        ((F.col("bin") + offset) * options.delay_step_s).alias("toa_s"),
    )
    return _with_truth(cfr, truth, detected).withColumn(
        "delay_bin", F.coalesce("delay_bin", F.lit(-1))
    )


def phase_slope_ranging(
    cfr: DataFrame, spacing_hz: float, subcarriers: int, truth: DataFrame,
    unwrap: bool = True, min_mean_power: float = 1e-12,
) -> DataFrame:
    """Delay from the phase slope of every antenna pair, combined by power-weighted medians."""
    link, pair = link_keys(cfr), pair_keys(cfr)
    samples = cfr.repartition(*link).select(*pair, F.posexplode("h").alias("k", "s"))
    re, im = F.col("s.re"), F.col("s.im")
    centred = (F.col("k") - (subcarriers - 1) / 2) * spacing_hz
    rows = samples.select(
        *pair, "k", centred.alias("f"), C.abs2(re, im).alias("w"), C.angle(re, im).alias("phase"),
        (C.is_finite(re) & C.is_finite(im)).alias("finite"),
    )
    phase = "phase"
    if unwrap:
        rows, phase = Q.unwrap_phase(rows, pair, "phase"), "unwrapped"
    over_pair = W.partitionBy(*pair)
    sums = Q.line_fit_sums(F.col("f"), F.col(phase), F.col("w"))
    rows = rows.withColumns({n: c.over(over_pair) for n, c in sums.items()})
    slope, intercept = Q.line_from_sums({n: F.col(n) for n in sums})
    rows = rows.withColumns({"slope": slope, "intercept": intercept})
    misfit = F.col(phase) - (F.col("slope") * F.col("f") + F.col("intercept"))
    once = F.when(F.count(F.lit(1)) > subcarriers, F.raise_error(F.lit("an antenna pair occurs twice")))
    pairs = rows.groupBy(*pair).agg(
        F.coalesce(once.cast("double"), F.avg("w")).alias("mean_power"), F.bool_and("finite").alias("finite"),
        F.first("slope").alias("slope"),
        F.sqrt(F.try_divide(F.sum(F.col("w") * misfit * misfit), F.sum("w"))).alias("residual"),
    ).withColumn("toa_s", -F.col("slope") / Q.TWO_PI)
    usable = pairs.where(
        F.col("finite") & (F.col("mean_power") >= min_mean_power) & (F.col("toa_s") >= 0)
    )
    medians = {"toa_s": "toa_s", "residual": "residual_rad"}
    return _with_truth(cfr, truth, Q.weighted_medians(usable, link, medians, "mean_power"))


def _with_truth(cfr: DataFrame, truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Every link of ``truth`` with derived range, round trip, error and success.

    A link without a finite truth delay matches no detection and therefore fails. A truth without
    snapshots holds for every snapshot of its link.
    """
    c = PW.SPEED_OF_LIGHT_MPS
    link = link_keys(cfr)
    if any(k not in truth.columns for k in link):
        truth = truth.join(cfr.select(*link).distinct(), LINK)
    known = truth.withColumn("_known", C.is_finite(F.col("truth_delay_s")))
    found = detected.withColumn("_known", F.lit(True))
    return known.join(found, [*link, "_known"], "left").withColumns({
        "range_m": F.col("toa_s") * c,
        "rtt_s": F.col("toa_s") * 2,
        "error_m": (F.col("toa_s") - F.col("truth_delay_s")) * c,
        "success": F.col("toa_s").isNotNull(),
    }).drop("truth_delay_s", "_known")


#: Registry of estimators: name -> f(cfr, truth, spacing_hz, subcarriers).
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "pdp_peak": lambda cfr, truth, spacing, n: pdp_peak_ranging(cfr, PdpOptions(spacing, n), truth),
    "phase_slope": lambda cfr, truth, spacing, n: phase_slope_ranging(cfr, spacing, n, truth),
}


def run_ranging(
    cfr: DataFrame, truth: DataFrame, spacing_hz: float, subcarriers: int,
    estimators: Sequence[str] = ("pdp_peak", "phase_slope"), default: str = "pdp_peak",
) -> DataFrame:
    """Union of the enabled estimators; ``is_default`` marks the default one."""
    unknown = sorted(set(estimators) - set(ESTIMATORS))
    if unknown:
        raise ValueError(f"unknown ranging estimators: {unknown}")
    if default not in estimators:
        raise ValueError("the default estimator must be enabled")
    common = ["toa_s", "range_m", "rtt_s", "error_m", "success"]
    tables = [
        ESTIMATORS[name](cfr, truth, spacing_hz, subcarriers).select(
            F.lit(name).alias("estimator"), *link_keys(cfr), *common, F.lit(name == default).alias("is_default")
        )
        for name in estimators
    ]
    result = tables[0]
    for other in tables[1:]:
        result = result.unionByName(other)
    return result
