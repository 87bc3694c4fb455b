"""Harmonic design columns and curves of fitted segments."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 365.2425


def design(t: Column) -> list[Column]:
    """[t, cos wt, sin wt, cos 2wt, sin 2wt, cos 3wt, sin 3wt]."""
    w = 2 * pi * t / YEAR
    return [t.cast("double"), *[f(k * w) for k in (1, 2, 3) for f in (F.cos, F.sin)]]


def predicted(t: Column, intercept: Column, coefficients: Column) -> Column:
    value = intercept
    for i, c in enumerate(design(t)):
        value = value + c * F.coalesce(F.get(coefficients, i), F.lit(0.0))
    return value
