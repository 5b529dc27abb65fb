"""Point and link geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_3d(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = bx - ax, by - ay, bz - az
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def distance_2d(ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    return F.sqrt(dx * dx + dy * dy)


def bearing(ax, ay, bx, by) -> Column:
    """Direction from a to b in the xy plane."""
    return F.atan2(by - ay, bx - ax)


def position_key(value: Column, decimals: int = 3) -> Column:
    """Coordinate rounded half-to-even, usable as a join key (-0.0 folded into 0.0)."""
    return F.bround(value, decimals) + F.lit(0.0)


def inside_rect(x: Column, y: Column, xmin, xmax, ymin, ymax) -> Column:
    """Inclusive rectangle."""
    return x.between(xmin, xmax) & y.between(ymin, ymax)
