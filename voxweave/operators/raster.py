"""Ray casting and rasterising of triangles from one camera.

The rays of an image are a fixed function of the pixel, so no ray table is joined: a triangle
lists the pixels of its projected bounds, each pair is tested, and the nearest hit per pixel is
a grouped minimum that combines map-side.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Sensor
from ..functions.mat import Mat, pose_literal
from ..functions.vec import V3, div
from ..runtime import computed

FOV = 58.0
MISS = 1e5
INCH_TO_MM = 25.4


def intersect(o: V3, d: V3, v0: V3, v1: V3, v2: V3) -> dict[str, Column]:
    """Moeller-Trumbore terms of a ray and a triangle: det, u, v, t (NULL when parallel)."""
    e1, e2 = v1 - v0, v2 - v0
    p = d.cross(e2)
    det, s = e1.dot(p), o - v0
    q = s.cross(e1)
    inv = F.when(F.abs(det) >= 1e-8, div(1.0, det))
    return {"u": s.dot(p) * inv, "v": d.dot(q) * inv, "t": e2.dot(q) * inv}


def is_hit(u: Column, v: Column) -> Column:
    return u.between(0.0, 1.0) & (v >= 0) & (u + v <= 1.0)


def pixel_ray(s: Sensor, pose: np.ndarray, u: Column, v: Column) -> V3:
    """Unit world direction through pixel (u, v) for a fixed vertical field of view."""
    k = math.tan(math.radians(FOV / 2))
    x = (2.0 * ((u + 1) / F.lit(float(s.cols))) - 1.0) * F.lit(s.cols / s.rows * k)
    y = (1.0 - 2.0 * ((v + 1) / F.lit(float(s.rows)))) * F.lit(k)
    return pose_literal(pose).apply(V3(x, y, F.lit(-1.0)), w=0.0)


def _pixel_bounds(tri: DataFrame, s: Sensor, pose: np.ndarray) -> DataFrame:
    """Pixel range whose lines can meet the triangle. A line is the same in front of and behind
    the camera, as is the projection. Across the camera plane the range is the whole image, and rows narrow it."""
    inv = pose_literal(np.linalg.inv(pose))
    cam = {}
    for k in range(3):
        cam.update(inv.apply(V3.of(f"p{k}")).as_map(f"_c{k}"))
    tri = computed(tri, cam)
    tan = math.tan(math.radians(FOV / 2))
    z = [F.col(f"_c{k}z") for k in range(3)]
    split = ~((F.greatest(*z) < -1e-9) | (F.least(*z) > 1e-9))
    px = [(div(F.col(f"_c{k}x"), -z[k]) / F.lit(s.cols / s.rows * tan) + 1.0) / 2.0 * s.cols - 1.0 for k in range(3)]
    py = [(1.0 - div(F.col(f"_c{k}y"), -z[k]) / F.lit(tan)) / 2.0 * s.rows - 1.0 for k in range(3)]

    def lo(p):
        return F.when(split, 0).otherwise(F.greatest(F.floor(F.least(*p) - 1e-6), F.lit(0)))

    def hi(p, n):
        return F.when(split, n - 1).otherwise(F.least(F.ceil(F.greatest(*p) + 1e-6), F.lit(n - 1)))
    tri = computed(tri, {"_u0": lo(px), "_u1": hi(px, s.cols), "_v0": lo(py), "_v1": hi(py, s.rows)})
    return tri.filter("_u0 <= _u1 and _v0 <= _v1")


def _row_spans(df: DataFrame, s: Sensor, keep: list[str]) -> DataFrame:
    """``keep`` with the column ranges _lo.._hi in which row _v can meet its triangle.

    The plane of eye and row cuts two sides of the triangle. If both cuts lie on one side of the camera plane, the row
    meets what is between their projections; if they lie on either side, all but what is between. The range of the
    bounds stands where a cut is on the camera plane or the row only touches a corner.
    """
    tan = math.tan(math.radians(FOV / 2))
    y = (1.0 - 2.0 * ((F.col("_v") + 1) / F.lit(float(s.rows)))) * F.lit(tan)
    df = computed(df, {f"_f{k}": F.col(f"_c{k}y") + F.col(f"_c{k}z") * y for k in range(3)})
    cuts = {}
    for i, j in ((0, 1), (1, 2), (2, 0)):
        a, b = F.col(f"_f{i}"), F.col(f"_f{j}")
        share = F.when((F.signum(a) * F.signum(b) <= 0) & (a != b), div(a, a - b))
        cuts.update({f"_s{i}{c}": F.col(f"_c{i}{c}") + share * (F.col(f"_c{j}{c}") - F.col(f"_c{i}{c}")) for c in "xz"})
    size = F.greatest(*[F.abs(F.col(f"_c{k}{c}")) for k in range(3) for c in "yz"])
    touch = F.least(*[F.abs(F.col(f"_f{k}")) for k in range(3)]) <= 1e-9 * size
    df = computed(df, {**cuts, "_size": size, "_touch": touch}, [*keep, "_u0", "_u1"])
    zs = [F.col(f"_s{k}z") for k in range(3)]
    at = [(div(F.col(f"_s{k}x"), -z) / F.lit(s.cols / s.rows * tan) + 1.0) / 2.0 * s.cols - 1.0 for k, z in enumerate(zs)]
    front, rear = ([F.when(z < 0, u) for z, u in zip(zs, at)], [F.when(z > 0, u) for z, u in zip(zs, at)])
    ends = {n: f(*side) for n, f, side in (("_a0", F.least, front), ("_a1", F.greatest, front), ("_b0", F.least, rear), ("_b1", F.greatest, rear))}
    flat = F.coalesce(F.least(*map(F.abs, zs)) <= 1e-9 * F.col("_size"), F.lit(False))
    df = computed(df, {**ends, "_flat": flat}, [*keep, "_u0", "_u1", "_touch"])
    a0, a1, b0, b1 = (F.col(c) for c in ("_a0", "_a1", "_b0", "_b1"))
    inside = lambda c: F.greatest(F.least(c, F.lit(float(s.cols))), F.lit(-1.0))
    down, up = (lambda c: F.floor(inside(c) - 1e-4)), (lambda c: F.ceil(inside(c) + 1e-4))
    span = lambda lo, hi: F.struct(F.greatest(F.col("_u0"), lo).cast("long").alias("_lo"), F.least(F.col("_u1"), hi).cast("long").alias("_hi"))
    whole = span(F.col("_u0"), F.col("_u1"))
    left = up(F.least(a1, b1))
    spans = (F.when(F.col("_flat"), F.array(whole)).when(a0.isNull() & b0.isNull(), F.when(F.col("_touch"), F.array(whole)))
             .when(b0.isNull(), F.array(span(down(a0), up(a1)))).when(a0.isNull(), F.array(span(down(b0), up(b1))))
             .otherwise(F.array(span(F.col("_u0"), left), span(F.greatest(down(F.greatest(a0, b0)), left + 1), F.col("_u1")))))
    return df.select(*keep, F.inline(spans)).filter("_lo <= _hi")


def candidates(triangles: DataFrame, s: Sensor, pose) -> DataFrame:
    """(fid, p0x..p2z, _u, _v): the pixels of the rows' spans of each triangle."""
    df = _pixel_bounds(triangles, s, np.asarray(pose, dtype=float))
    keep = ["fid", *[f"p{k}{a}" for k in range(3) for a in "xyz"], "_v"]
    df = _row_spans(df.withColumn("_v", F.explode(F.sequence("_v0", "_v1"))), s, keep)
    return df.select(*keep, F.explode(F.sequence("_lo", "_hi")).alias("_u"))


def ray_hits(triangles: DataFrame, s: Sensor, pose) -> DataFrame:
    """(idx, fid, t, u, v) of each pixel ray that meets a triangle (fid, p0x..p2z); t may be
    negative, as a hit behind the camera counts."""
    pose = np.asarray(pose, dtype=float)
    df = candidates(triangles, s, pose)
    corners = [f"p{k}{a}" for k in range(3) for a in "xyz"]
    df = computed(df, pixel_ray(s, pose, F.col("_u"), F.col("_v")).as_map("_r"), ["fid", *corners, "_u", "_v"])
    df = computed(df, V3.of("_r").normalize().as_map("_d"), ["fid", *corners, "_u", "_v"])
    eye = V3.lit(*pose[:3, 3])
    terms = intersect(eye, V3.of("_d"), *[V3.of(f"p{k}") for k in range(3)])
    idx = (F.col("_v") * s.cols + F.col("_u")).alias("idx")
    return computed(df, terms, [idx, "fid"]).filter(is_hit(F.col("u"), F.col("v")))


def nearest_hits(triangles: DataFrame, s: Sensor, pose) -> DataFrame:
    """(idx, fid, t): the hit of least t per pixel, lower face id on ties."""
    h = ray_hits(triangles, s, pose)
    best = h.groupBy("idx").agg(F.min(F.struct("t", "fid")).alias("_m"))
    return best.select("idx", F.col("_m.fid").alias("fid"), F.col("_m.t").alias("t"))


def ray_depth(triangles: DataFrame, s: Sensor, pose) -> DataFrame:
    """(idx, depth) for every pixel: nearest t, a fixed far value on a miss, 0.2 for zero."""
    pixels = triangles.sparkSession.range(s.rows * s.cols).withColumnRenamed("id", "idx")
    j = pixels.join(nearest_hits(triangles, s, pose), "idx", "left")
    depth = F.coalesce("t", F.lit(MISS))
    return j.select("idx", F.when(depth == 0, 0.2).otherwise(depth).alias("depth"))


def hit_normals(triangles: DataFrame, s: Sensor, pose) -> DataFrame:
    """(idx, fid, nx, ny, nz): unit face normal at the nearest hit."""
    a, b, c = (V3.of(f"p{k}") for k in range(3))
    n = computed(triangles, (b - a).cross(c - a).as_map("_n"), ["fid"])
    n = n.select("fid", *V3.of("_n").normalize().named("n"))
    return nearest_hits(triangles, s, pose).join(n, "fid").select("idx", "fid", "nx", "ny", "nz")


# -- rasteriser --------------------------------------------------------------------------
def screen_window(aperture_w: float, aperture_h: float, width: int, height: int, near: float,
                  focal: float, fit: str = "overscan") -> tuple[float, float, float, float]:
    """(left, right, bottom, top) on the near plane for a film gate and an image size."""
    top = aperture_h * INCH_TO_MM / 2 / focal * near
    right = aperture_w * INCH_TO_MM / 2 / focal * near
    film, device = aperture_w / aperture_h, width / height
    wider = film > device
    if fit == "fill":
        right, top = (right * device / film, top) if wider else (right, top * film / device)
    else:
        right, top = (right, top * film / device) if wider else (right * device / film, top)
    return -right, right, -top, top


def to_raster(p: V3, world_to_camera: Mat, window, near: float, width: int, height: int) -> V3:
    """Raster x, y (y down) and the positive camera depth."""
    left, right, bottom, top = window
    c = world_to_camera.apply(p)
    sx, sy = div(F.lit(near) * c.x, -c.z), div(F.lit(near) * c.y, -c.z)
    nx = 2.0 * sx / (right - left) - (right + left) / (right - left)
    ny = 2.0 * sy / (top - bottom) - (top + bottom) / (top - bottom)
    return V3((nx + 1.0) / 2.0 * width, (1.0 - ny) / 2.0 * height, -c.z)


def edge_function(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a-b-c, positive when c is to the right of a-b (y down)."""
    return (cx - ax) * (by - ay) - (cy - ay) * (bx - ax)


def raster_triangles(triangles: DataFrame, world_to_camera, window, near: float, width: int,
                     height: int) -> DataFrame:
    """fid and raster corners r0x..r2z."""
    m = pose_literal(world_to_camera)
    cols = {}
    for k in range(3):
        cols.update(to_raster(V3.of(f"p{k}"), m, window, near, width, height).as_map(f"r{k}"))
    return computed(triangles, cols, ["fid"])


def z_buffer(raster: DataFrame, width: int, height: int, far: float) -> DataFrame:
    """(x, y, fid, z, w0, w1, w2) of the nearest triangle at each pixel centre. The depth is
    interpolated as 1/z; back faces, triangles reaching behind the camera and points beyond
    ``far`` are left out."""
    r = {f"{k}{a}": F.col(f"r{k}{a}") for k in range(3) for a in "xyz"}
    ok = (r["0z"] > 0) & (r["1z"] > 0) & (r["2z"] > 0)
    df = raster.filter(ok)
    xs, ys = [r[f"{k}x"] for k in range(3)], [r[f"{k}y"] for k in range(3)]
    df = df.withColumns({
        "_x0": F.greatest(F.lit(0), F.floor(F.least(*xs))), "_x1": F.least(F.lit(width - 1), F.floor(F.greatest(*xs))),
        "_y0": F.greatest(F.lit(0), F.floor(F.least(*ys))), "_y1": F.least(F.lit(height - 1), F.floor(F.greatest(*ys)))})
    df = df.filter("_x0 <= _x1 and _y0 <= _y1")
    df = df.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).withColumn("x", F.explode(F.sequence("_x0", "_x1")))
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    w = {"_w0": edge_function(r["1x"], r["1y"], r["2x"], r["2y"], px, py),
         "_w1": edge_function(r["2x"], r["2y"], r["0x"], r["0y"], px, py),
         "_w2": edge_function(r["0x"], r["0y"], r["1x"], r["1y"], px, py),
         "_area": edge_function(r["0x"], r["0y"], r["1x"], r["1y"], r["2x"], r["2y"])}
    df = computed(df, w, ["fid", "x", "y", "r0z", "r1z", "r2z"])
    df = df.filter("_w0 >= 0 and _w1 >= 0 and _w2 >= 0")
    ws = [div(F.col(f"_w{k}"), F.col("_area")) for k in range(3)]
    df = computed(df, {f"w{k}": c for k, c in enumerate(ws)}, ["fid", "x", "y", "r0z", "r1z", "r2z"])
    inv = sum((div(F.col(f"w{k}"), F.col(f"r{k}z")) for k in (1, 2)), div(F.col("w0"), F.col("r0z")))
    df = df.withColumn("z", div(1.0, inv)).filter(F.col("z") < far)
    best = df.groupBy("x", "y").agg(F.min(F.struct("z", "fid", "w0", "w1", "w2")).alias("_m"))
    return best.select("x", "y", "_m.*")


def facing(hits: DataFrame, triangles: DataFrame, world_to_camera) -> DataFrame:
    """Shade each z-buffer row by the cosine between face normal and view."""
    m = pose_literal(world_to_camera)
    cam = {}
    for k in range(3):
        cam.update(m.apply(V3.of(f"p{k}")).as_map(f"c{k}"))
    t = computed(triangles, cam, ["fid"])
    a, b, c = (V3.of(f"c{k}") for k in range(3))
    t = computed(t, {**(b - a).cross(c - a).as_map("_n"), **{
        f"_q{k}{ax}": div(F.col(f"c{k}{ax}"), -F.col(f"c{k}z")) for k in range(3) for ax in "xy"}}, ["fid"])
    j = hits.join(t, "fid")

    def mix(ax):
        return sum((F.col(f"_q{k}{ax}") * F.col(f"w{k}") for k in (1, 2)), F.col("_q0" + ax) * F.col("w0")) * F.col("z")
    j = computed(j, {"_px": mix("x"), "_py": mix("y")})
    view = V3(-F.col("_px"), -F.col("_py"), F.col("z"))
    cos = F.greatest(F.lit(0.0), div(V3.of("_n").dot(view), V3.of("_n").length() * view.length()))
    return j.select("x", "y", "fid", cos.alias("shade"))
