"""Complex arithmetic on (re, im) column pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abs2(re: Column, im: Column) -> Column:
    return re * re + im * im


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(abs2(re, im))


def angle(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def conj_product(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> tuple[Column, Column]:
    """a * conj(b)."""
    return a_re * b_re + a_im * b_im, a_im * b_re - a_re * b_im


def product(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> tuple[Column, Column]:
    return a_re * b_re - a_im * b_im, a_re * b_im + a_im * b_re


def rotate(re: Column, im: Column, phase: Column) -> tuple[Column, Column]:
    """Multiply by exp(j*phase)."""
    return product(re, im, F.cos(phase), F.sin(phase))


def is_finite(value: Column) -> Column:
    """True for an ordinary number; false for NULL, NaN and both infinities."""
    inf = F.lit(float("inf"))
    return F.coalesce(~F.isnan(value) & (F.abs(value) < inf), F.lit(False))


def nan_to_null(value: Column) -> Column:
    """NaN and infinities mean "no measurement": NULL inside Spark."""
    return F.when(is_finite(value), value)


def nan_to_zero(value: Column) -> Column:
    return F.when(is_finite(value), value).otherwise(F.lit(0.0))


def wrap_phase(phase: Column) -> Column:
    """Phase in [-pi, pi)."""
    return F.pmod(phase + F.pi(), 2 * F.pi()) - F.pi()
