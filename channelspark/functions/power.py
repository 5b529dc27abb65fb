"""Power, noise and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPEED_OF_LIGHT_MPS = 299_792_458.0
POWER_FLOOR = 1e-30
THERMAL_DENSITY_DBM_HZ = -173.975187
REFERENCE_TEMPERATURE_K = 290.0


def db(value: Column, floor: float = POWER_FLOOR) -> Column:
    """10*log10 of a power with a floor."""
    return 10 * F.log10(F.greatest(value, F.lit(floor)))


def amplitude_db(value: Column, floor: float = POWER_FLOOR) -> Column:
    return 20 * F.log10(F.greatest(value, F.lit(floor)))


def dbm_to_mw(dbm: Column) -> Column:
    return F.pow(F.lit(10.0), dbm / 10)


def mw_to_dbm(mw: Column, floor: float = POWER_FLOOR) -> Column:
    return db(mw, floor)


def amplitude_scale_from_dbm(power_dbm: Column, reference_dbm: float = 0.0) -> Column:
    return F.pow(F.lit(10.0), (power_dbm - reference_dbm) / 20)


def thermal_noise_dbm(
    bandwidth_hz: Column, noise_figure_db: Column, temperature_k: Column
) -> Column:
    """kTB noise power; a non-positive bandwidth or temperature is an error."""
    noise = (
        F.lit(THERMAL_DENSITY_DBM_HZ)
        + 10 * F.log10(temperature_k / REFERENCE_TEMPERATURE_K)
        + 10 * F.log10(bandwidth_hz)
        + noise_figure_db
    )
    bad = (bandwidth_hz <= 0) | (temperature_k <= 0)
    message = F.lit("bandwidth and temperature must be positive")
    return F.when(bad, F.raise_error(message).cast("double")).otherwise(noise)


def noise_variance(
    signal_mw: Column, mode: Column, snr_db: Column, thermal_noise_mw: Column
) -> Column:
    """Noise power: follows the signal in ``relative_snr`` mode, fixed in ``absolute_thermal``."""
    relative = signal_mw / F.pow(F.lit(10.0), snr_db / 10)
    unknown = F.raise_error(F.concat(F.lit("unknown noise mode "), mode)).cast("double")
    return (
        F.when(mode == "relative_snr", relative)
        .when(mode == "absolute_thermal", thermal_noise_mw)
        .otherwise(unknown)
    )


def path_gain_db(re: Column, im: Column) -> Column:
    return amplitude_db(F.sqrt(re * re + im * im))
