"""Re-aimed augmentation and mixing of recorded channels and captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelspark.functions import complex as C

TWO_PI = 6.283185307179586


def augment_channel(
    cfr: DataFrame,
    *,
    phase_offset_rad: Column | float = 0.0,
    sfo_ppm: Column | float = 0.0,
    timing_offset_samples: Column | float = 0.0,
    agc_gain_db: Column | float = 0.0,
    fft_size: int,
    clipping_threshold: float | None = None,
    column: str = "h",
) -> DataFrame:
    """Phase offset, clock and timing ramps, gain and magnitude clipping of array rows.

    Stays inside the row: no shuffle. ``clipped`` tells whether any sample hit the threshold.
    """
    offset, ppm, timing, gain = (
        c if isinstance(c, Column) else F.lit(float(c))
        for c in (phase_offset_rad, sfo_ppm, timing_offset_samples, agc_gain_db)
    )
    scale = F.pow(F.lit(10.0), gain / 20)

    def impair(sample: Column, k: Column) -> Column:
        phase = offset + TWO_PI * k * ppm * 1e-6 + TWO_PI * k * timing / fft_size
        re, im = C.rotate(sample["re"], sample["im"], phase)
        return F.struct((re * scale).alias("re"), (im * scale).alias("im"))

    impaired = cfr.withColumn(column, F.transform(column, impair))
    if clipping_threshold is None:
        return impaired.withColumn("clipped", F.lit(False))
    limit = F.lit(float(clipping_threshold))

    def magnitude(sample: Column) -> Column:
        return C.magnitude(sample["re"], sample["im"])

    def clip(sample: Column) -> Column:
        factor = F.when(magnitude(sample) > limit, limit / magnitude(sample)).otherwise(F.lit(1.0))
        return F.struct((sample["re"] * factor).alias("re"), (sample["im"] * factor).alias("im"))

    return impaired.withColumn(
        "clipped", F.exists(column, lambda s: magnitude(s) > limit)
    ).withColumn(column, F.transform(column, clip))


def gaussian_pair(keys: Sequence[str | Column], seed: int) -> tuple[Column, Column]:
    """Two independent standard normals from a hash of the keys: same row, same noise."""
    def uniform(stream: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed), F.lit(stream)), 11)
        return (bits + F.lit(0.5)) / F.lit(float(2**53))

    radius = F.sqrt(-2 * F.log(uniform(1)))
    turn = TWO_PI * uniform(2)
    return radius * F.cos(turn), radius * F.sin(turn)


def add_awgn(samples: DataFrame, keys: Sequence[str], variance: Column, seed: int) -> DataFrame:
    """Add complex Gaussian noise of total ``variance`` to re, im; independent of partitioning."""
    n_re, n_im = gaussian_pair(list(keys), seed)
    sigma = F.sqrt(variance / 2)
    return samples.withColumns({
        "re": F.col("re") + sigma * n_re, "im": F.col("im") + sigma * n_im
    })


def mix_iq(samples: DataFrame, slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared signal: sum of the active transmitters' samples per frame, receiver and sample.

    ``slots`` maps tx to its frame; sums are combined before the shuffle.
    """
    return samples.join(slots.select("tx", "frame"), "tx").groupBy("frame", *keys).agg(
        F.sum("re").alias("re"), F.sum("im").alias("im"), F.count(F.lit(1)).alias("users")
    )
