"""Per-pixel projections and filters, and the image stencils.

Stencils read a neighbour at a fixed linear offset. They use one window per frame with RANGE
frames on the pixel index, so a missing pixel yields NULL instead of shifting its row. A frame
never holds more rows than the sensor has pixels, so the window partitions are bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Sensor
from ..functions import camera, weights
from ..functions.mat import Mat
from ..functions.quat import Quat
from ..functions.vec import V3, div

def neighbour(value: Column | str, offset: int, keys: str | list[str] = "frame_id") -> Column:
    """Value at linear index idx+offset of the same frame; NULL where there is none."""
    w = Window.partitionBy(keys).orderBy("idx").rangeBetween(offset, offset)
    return F.first(value).over(w)


# -- projections -------------------------------------------------------------------------
def with_uv(df: DataFrame, s: Sensor) -> DataFrame:
    return df.withColumns({"u": F.col("idx") % s.cols,
                           "v": F.expr(f"idx div {s.cols}")})


def back_project(df: DataFrame, s: Sensor, scale: int = 1) -> DataFrame:
    return df.withColumns(camera.back_project(s, F.col("depth"), scale).as_map())


def point_cloud(df: DataFrame, s: Sensor, scale: int = 1, dense: bool = True) -> DataFrame:
    """Camera-space points. ``dense`` keeps pixels without depth as zeros, else drops them."""
    p = camera.back_project(s, F.col("depth"), scale)
    if not dense:
        return df.filter(F.col("depth") > 0).withColumns(p.as_map())
    has = F.col("depth") > 0
    return df.withColumns({n: F.when(has, c).otherwise(F.lit(0.0)) for n, c in p.as_map().items()})


def project(df: DataFrame, s: Sensor, p: V3, u: str = "pu", v: str = "pv") -> DataFrame:
    pu, pv = camera.project(s, p)
    return df.withColumns({u: pu, v: pv})


def pose_matrix() -> Mat:
    """Camera-to-world matrix from tx..tz and unit-quaternion qx..qw columns."""
    return Mat.rigid(Quat.of("q").matrix(), V3.of("t"))


def pose_columns(poses: DataFrame) -> DataFrame:
    """frame_id and the twelve entries m00..m23 of each pose, computed once per frame."""
    unit = poses.select("frame_id", "tx", "ty", "tz", *Quat.of("q").normalize().named("q"))
    return unit.select("frame_id", *Mat(pose_matrix().rows[:3]).named("m"))


def joined_pose() -> Mat:
    return Mat.cols([f"m{i}{j}" for i in range(3) for j in range(4)], 4)


def transform_points(df: DataFrame, poses: DataFrame) -> DataFrame:
    """Move x,y,z by the pose of their frame."""
    j = df.join(pose_columns(poses), "frame_id")
    p = joined_pose().apply(V3.of())
    names = [f"m{i}{k}" for i in range(3) for k in range(4)]
    return j.withColumns(p.as_map()).drop(*names)


def depth_filter(df: DataFrame, lo: float = 0.15, hi: float = 2.0) -> DataFrame:
    return df.filter(camera.valid_depth(lo, hi))


def frustum_filter(df: DataFrame, s: Sensor, p: V3) -> DataFrame:
    u, v = camera.project(s, p)
    return df.filter((p.z >= 0) & camera.in_image(s, u, v))


def angle_filter(df: DataFrame, a: V3, b: V3, angle: float = math.pi / 10) -> DataFrame:
    """Keep rows whose directions (of any length) differ by less than ``angle``, either way."""
    return df.filter(F.abs(a.dot(b)) > F.lit(math.cos(angle)) * a.length() * b.length())


def color_float(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}f": camera.color_to_float(F.col(c)) for c in "rgb"})


def intensity(df: DataFrame) -> DataFrame:
    return df.withColumn("luma", camera.intensity(F.col("r"), F.col("g"), F.col("b")))


# -- stencils ----------------------------------------------------------------------------
def normals_from_points(df: DataFrame, s: Sensor, unit: bool = True) -> DataFrame:
    """Cross product of the horizontal (+-2) and vertical (+-1 row) differences; off the
    ends the pixel itself stands in. The upward step also rejects index 0."""
    here = F.struct("x", "y", "z")
    up = F.when(F.col("idx") - s.cols > 0, neighbour(here, -s.cols))
    steps = {"_l": neighbour(here, -2), "_r": neighbour(here, 2), "_u": up,
             "_d": neighbour(here, s.cols)}
    df = df.withColumns({n: F.coalesce(c, here) for n, c in steps.items()})
    n = (V3.field("_r") - V3.field("_l")).cross(V3.field("_d") - V3.field("_u"))
    if not unit:
        return df.withColumns(n.as_map("n")).drop("_l", "_r", "_u", "_d")
    # The raw normal is materialised as columns first so that its length is computed once.
    df = df.withColumns(n.as_map("_n")).drop("_l", "_r", "_u", "_d")
    return df.withColumns(V3.of("_n").normalize().as_map("n")).drop("_nx", "_ny", "_nz")


def normals_from_depth(df: DataFrame, s: Sensor, unit: bool = True) -> DataFrame:
    """normalize(-dz/dx, -dz/dy, 1) from depth differences two pixels either side."""
    def at(off):
        return F.coalesce(neighbour("depth", off), F.col("depth"))
    k = F.lit(s.depth_scale / 2.0)
    df = df.withColumns({"_dx": (at(2) - at(-2)) * k, "_dy": (at(2 * s.cols) - at(-2 * s.cols)) * k})
    n = V3(-F.col("_dx"), -F.col("_dy"), F.lit(1.0))
    return df.withColumns((n.normalize() if unit else n).as_map("n")).drop("_dx", "_dy")


# 5x5 binomial weights; fixed values (they sum to 256)
BINOMIAL5 = (1, 4, 6, 4, 1)


def convolve5(df: DataFrame, s: Sensor, kind: str = "box") -> DataFrame:
    """5x5 mean (``box``) or binomial blur of depth over linear offsets, into ``blurred``.
    Indexes before the first pixel read pixel 0; taps past the end are skipped."""
    first = F.first("depth").over(Window.partitionBy("frame_id").orderBy("idx").rowsBetween(
        Window.unboundedPreceding, 0))
    total = F.lit(0.0)
    norm = F.lit(0.0)
    for i in range(-2, 3):
        for j in range(-2, 3):
            off = i * s.cols + j
            w = 1.0 if kind == "box" else float(BINOMIAL5[i + 2] * BINOMIAL5[j + 2])
            tap = neighbour("depth", off) if off else F.col("depth")
            if off < 0:
                tap = F.when(F.col("idx") + off < 0, first).otherwise(tap)
            total = total + F.coalesce(tap, F.lit(0.0)) * F.lit(w)
            norm = norm + F.when(tap.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    divisor = F.lit(25.0) if kind == "box" else norm
    return df.withColumn("blurred", div(total, divisor))


def bilateral(df: DataFrame, s: Sensor, radius: int = 2, sigma_i: float = 50.0,
              sigma_s: float = 3.0) -> DataFrame:
    """Edge-preserving smoothing of depth into ``smoothed``; the window spans -radius to
    radius-1 and taps outside the image are dropped."""
    total, norm = F.lit(0.0), F.lit(0.0)
    for i in range(-radius, radius):
        for j in range(-radius, radius):
            tap = neighbour("depth", i * s.cols + j) if (i or j) else F.col("depth")
            inside = (F.col("u") + j).between(0, s.cols - 1) & (F.col("v") + i).between(0, s.rows - 1)
            gs = math.exp(-(i * i + j * j) / (2 * sigma_s ** 2)) / (2 * math.pi * sigma_s ** 2)
            w = weights.gaussian(tap - F.col("depth"), sigma_i) * F.lit(gs)
            ok = inside & tap.isNotNull()
            total = total + F.when(ok, tap * w).otherwise(F.lit(0.0))
            norm = norm + F.when(ok, w).otherwise(F.lit(0.0))
    return df.withColumn("smoothed", div(total, norm))


def filter_taps(df: DataFrame, s: Sensor, taps: list[tuple[int, int, float]]) -> DataFrame:
    """Normalised weighted mean of depth over explicit (row, column, weight) taps."""
    total, norm = F.lit(0.0), F.lit(0.0)
    for i, j, w in taps:
        tap = neighbour("depth", i * s.cols + j) if (i or j) else F.col("depth")
        ok = ((F.col("u") + j).between(0, s.cols - 1) & (F.col("v") + i).between(0, s.rows - 1)
              & tap.isNotNull())
        total = total + F.when(ok, tap * F.lit(w)).otherwise(F.lit(0.0))
        norm = norm + F.when(ok, F.lit(w)).otherwise(F.lit(0.0))
    return df.withColumn("filtered", div(total, norm))


def color_gradient(df: DataFrame, s: Sensor) -> DataFrame:
    """Half backward differences of luma along the row and the column."""
    df = intensity(df)
    return df.withColumns({"gx": (F.col("luma") - neighbour("luma", -1)) / 2.0,
                           "gy": (F.col("luma") - neighbour("luma", -s.cols)) / 2.0})


def replicate(s: Sensor, value: str, du: int) -> Column:
    """Value ``du`` columns away in the same row, the border column repeated outside."""
    row = ["frame_id", "v"]
    edge = 0 if du < 0 else s.cols - 1
    border = F.max(F.when(F.col("u") == edge, F.col(value))).over(Window.partitionBy(row))
    inside = (F.col("u") + du).between(0, s.cols - 1)
    return F.when(inside, neighbour(value, du, row)).otherwise(border)


# -- pyramid -----------------------------------------------------------------------------
def pyramid_offset(extent: int, scale: int) -> int:
    """Margin that centres the reduced image on the full-size canvas."""
    return 0 if scale == 1 else (extent - extent // scale) // 2


def pyramid(df: DataFrame, s: Sensor, scale: int, values: tuple[str, ...] = ("depth",)) -> DataFrame:
    """Decimate by ``scale`` onto a full-size canvas. Among the pixels of one cell the last
    (highest index) wins. Scale 1 is a copy. The aggregate combines map-side."""
    if scale == 1:
        return df.select("frame_id", "idx", "u", "v", *values)
    u = F.expr(f"u div {scale}") + pyramid_offset(s.cols, scale)
    v = F.expr(f"v div {scale}") + pyramid_offset(s.rows, scale)
    packed = F.max_by(F.struct(*values), "idx").alias("_s")
    out = df.groupBy("frame_id", u.alias("u"), v.alias("v")).agg(packed)
    return out.select("frame_id", (F.col("v") * s.cols + F.col("u")).alias("idx"), "u", "v", "_s.*")
