"""Pinhole camera, colour and validity expressions on pixel rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Sensor
from .vec import V3, div, round_away


def back_project(s: Sensor, depth: Column, scale: int = 1, u: Column | None = None,
                 v: Column | None = None) -> V3:
    u = F.col("u") if u is None else u
    v = F.col("v") if v is None else v
    return V3((u - F.lit(s.cx)) * depth / F.lit(s.fx / scale),
              (v - F.lit(s.cy)) * depth / F.lit(s.fy / scale), depth)


def project_raw(s: Sensor, p: V3, scale: int = 1) -> tuple[Column, Column]:
    """Unrounded pixel position of a camera-space point; NULL on the camera plane."""
    return (div(F.lit(s.fx / scale) * p.x, p.z) + F.lit(s.cx),
            div(F.lit(s.fy / scale) * p.y, p.z) + F.lit(s.cy))


def project(s: Sensor, p: V3, scale: int = 1) -> tuple[Column, Column]:
    """Pixel (u, v) of a camera-space point; NULL on the camera plane."""
    u, v = project_raw(s, p, scale)
    return round_away(u), round_away(v)


def in_image(s: Sensor, u: Column, v: Column) -> Column:
    return (u >= 0) & (u < s.cols) & (v >= 0) & (v < s.rows)


def rounds_into_image(s: Sensor, u: Column, v: Column) -> Column:
    """``in_image`` of the rounded position, tested on the unrounded one."""
    return (u > -0.5) & (u < s.cols - 0.5) & (v > -0.5) & (v < s.rows - 0.5)


def valid_depth(lo: float, hi: float, depth: str | Column = "depth") -> Column:
    d = F.col(depth) if isinstance(depth, str) else depth
    return d.between(lo, hi)


def color_to_float(c: Column) -> Column:
    return c / F.lit(255.0)


def intensity(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(0.2126) + g * F.lit(0.7152) + b * F.lit(0.0722)
