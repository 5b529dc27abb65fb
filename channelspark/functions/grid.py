"""Regular grids: frequencies, timestamps, angles, histogram bins, sounding resources."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

PRB_SUBCARRIERS = 12


def frequency_grid(center_hz: Column, bandwidth_hz: Column, count: Column) -> Column:
    """fc + (k - (n-1)/2) * bw/n as an array."""
    step = bandwidth_hz / count
    return F.transform(
        F.sequence(F.lit(0), count.cast("int") - 1),
        lambda k: center_hz + (k - (count - 1) / 2) * step,
    )


def timestamps(count: Column, rate_hz: Column) -> Column:
    """Snapshot times: id / rate."""
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: i / rate_hz)


def linspace(lo: float, hi: float, count: int) -> list[float]:
    if count == 1:
        return [lo]
    return [lo + (hi - lo) * i / (count - 1) for i in range(count)]


def nearest_bin(value: Column, lo: float, hi: float, count: int) -> Column:
    """Index of the nearest point of a regular grid, the lower one on a tie."""
    if count == 1:
        return F.when(value.isNotNull(), F.lit(0).cast("bigint"))
    step = (hi - lo) / (count - 1)
    raw = F.ceil((value - lo) / step - 0.5)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(count - 1)).cast("bigint")


def histogram_bin(value: Column, lo: float | Column, hi: float | Column, count: int) -> Column:
    """Fixed-width bin 0..count-1; the last bin is closed; outside values give NULL."""
    lo, hi = (b if isinstance(b, Column) else F.lit(b) for b in (lo, hi))
    position = F.floor((value - lo) / (hi - lo) * count)
    return F.when(value.between(lo, hi), F.least(position, F.lit(count - 1))).cast("bigint")


def symbol_prbs(
    symbol_count: int,
    carrier_subcarriers: int,
    bwp_start_prb: int = 0,
    bwp_num_prb: int | None = None,
    hopping_offsets: Sequence[int] | None = None,
    hopping_counts: Sequence[int] | None = None,
) -> list[tuple[int, int]]:
    """(first PRB, PRB count) of each sounding symbol; an allocation off the carrier is an error."""
    carrier = max(1, ceil(carrier_subcarriers / PRB_SUBCARRIERS))
    result = []
    for symbol in range(symbol_count):
        start = bwp_start_prb + (hopping_offsets[symbol] if hopping_offsets else 0)
        count = hopping_counts[symbol] if hopping_counts else (bwp_num_prb or carrier)
        if start < 0 or count < 1 or start >= carrier:
            raise ValueError("sounding allocation is outside the carrier")
        if carrier_subcarriers >= PRB_SUBCARRIERS and (
            (start + count) * PRB_SUBCARRIERS > carrier_subcarriers
        ):
            raise ValueError("sounding allocation is outside the carrier")
        result.append((start, count))
    return result


def resource_subcarriers(
    start_prb: Column, prb_count: Column, comb_size: Column, comb_offset: Column, total: Column
) -> Column:
    """Subcarriers of one symbol: start*12 + offset, then every comb_size-th up to the end."""
    first = start_prb * PRB_SUBCARRIERS + comb_offset
    last = F.least((start_prb + prb_count) * PRB_SUBCARRIERS, total) - 1
    empty = F.array().cast("array<int>")
    return F.when(
        first <= last, F.sequence(first.cast("int"), last.cast("int"), comb_size.cast("int"))
    ).otherwise(empty)


def is_scheduled(trigger: Column, slot: Column, offset: Column, period: Column) -> Column:
    """Aperiodic: exactly the offset slot; periodic: every period from the offset on."""
    periodic = (slot >= offset) & (F.pmod(slot - offset, period) == 0)
    return F.when(trigger == "aperiodic", slot == offset).otherwise(periodic)


def prb_split(total: Column, parts: Column, slot: Column) -> Column:
    """Contiguous block of one slot; the remainder goes to the first slots."""
    base = F.floor(total / parts)
    rest = total % parts
    return F.struct(
        (slot * base + F.least(slot, rest)).cast("bigint").alias("start"),
        (base + F.when(slot < rest, 1).otherwise(0)).cast("bigint").alias("count"),
    )
