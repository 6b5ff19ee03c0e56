"""Kernel and robust weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import div


def gaussian(x: Column, sigma: float) -> Column:
    return F.exp(-(x * x) / F.lit(2.0 * sigma * sigma)) / F.lit(2.0 * math.pi * sigma * sigma)


def gaussian_taps(diameter: int, sigma: float) -> list[tuple[int, float]]:
    """Unnormalised 1-D taps; the lattice runs from -diameter to -1."""
    return [(i - diameter, math.exp(-((i - diameter) ** 2) / (2 * sigma * sigma)))
            for i in range(diameter)]


def gaussian_taps_2d(diameter: int, sigma: float) -> list[tuple[int, int, float]]:
    one = gaussian_taps(diameter, sigma)
    return [(i, j, a * b) for i, a in one for j, b in one]


def neighbour_weight(dist: Column, radius: float, exponential: bool, nearest: Column) -> Column:
    """exp(-d^2/r^2), or r * nearest / d."""
    if exponential:
        return F.exp(-(dist * dist) / F.lit(radius * radius))
    return div(nearest * F.lit(radius), dist)


def robust(kind: str, e: Column, k: float) -> Column:
    a = F.abs(e)
    if kind == "huber":
        return F.when(a > k, div(k, a)).otherwise(F.lit(1.0))
    if kind == "tukey":
        t = 1.0 - (e / F.lit(k)) * (e / F.lit(k))
        return F.when(a > k, F.lit(0.0)).otherwise(t * t)
    if kind == "l1":
        return F.coalesce(div(1.0, a), F.lit(0.0))
    return F.lit(1.0)
