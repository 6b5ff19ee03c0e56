"""Ray-casting and rasteriser queries (RAY, RAS) over the point triangles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..config import Sensor
from ..functions.vec import V3, clean
from ..operators import mesh, raster
from . import tables as t
from .registry import query
from .surface import FACE_POS, FACE_N, POS

S = Sensor(rows=48, cols=64)
EYE = (0.05, -0.03, 1.5)
POSE = [[1.0, 0.0, 0.0, EYE[0]], [0.0, 1.0, 0.0, EYE[1]], [0.0, 0.0, 1.0, EYE[2]], [0.0, 0.0, 0.0, 1.0]]
W2C = [[1.0, 0.0, 0.0, -EYE[0]], [0.0, 1.0, 0.0, -EYE[1]], [0.0, 0.0, 1.0, -EYE[2]], [0.0, 0.0, 0.0, 1.0]]
BASE = f"{t.points_sql()}, {t.vertices_sql()}, {t.triangles_sql()}, {FACE_POS}"
_K = math.tan(math.radians(29.0))


def _triangles(spark, sf):
    return mesh.face_positions(t.triangles(spark, sf), t.vertices(spark, sf))


def _mt_sql(src):
    """Moeller-Trumbore over src(ox..oz, dx..dz, p0x..p2z), as CTEs ending in mt."""
    e = {k: [f"(p{k}{a} - p0{a})" for a in "xyz"] for k in (1, 2)}

    def cr(a, b):
        return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]

    def dot(a, b):
        return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"
    d, o = ["dx", "dy", "dz"], [f"(o{a} - p0{a})" for a in "xyz"]
    p, q = ["hx", "hy", "hz"], ["kx", "ky", "kz"]
    return f"""m1 AS (SELECT *, {', '.join(f'{c} AS {n}' for c, n in zip(cr(d, e[2]), p))}, {', '.join(f'{c} AS {n}' for c, n in zip(cr(o, e[1]), q))} FROM {src}),
      m2 AS (SELECT *, {dot(e[1], p)} AS det FROM m1),
      mt AS (SELECT *, {dot(o, p)} * (1.0::DOUBLE / det) AS tu, {dot(d, q)} * (1.0::DOUBLE / det) AS tv, {dot(e[2], q)} * (1.0::DOUBLE / det) AS t
        FROM m2 WHERE abs(det) >= 1e-8)"""


_HIT = "tu BETWEEN 0 AND 1 AND tv >= 0 AND tu + tv <= 1"


@query("ray1_intersect", f"""WITH {BASE}, r AS (SELECT *, 0.0::DOUBLE AS ox, 0.0::DOUBLE AS oy, 1.5::DOUBLE AS oz,
  (p0x + p1x + p2x) / 3.0 AS dx, (p0y + p1y + p2y) / 3.0 + 0.02::DOUBLE AS dy, (p0z + p1z + p2z) / 3.0 - 1.5::DOUBLE AS dz FROM fp), {_mt_sql('r')}
SELECT fid, {t.r6('tu')} AS u, {t.r6('tv')} AS v, {t.r6('t')} AS t, CASE WHEN {_HIT} THEN 1 ELSE 0 END AS hit FROM mt""")
def ray1(spark, sf):
    p = [V3.of(f"p{k}") for k in range(3)]
    o = V3.lit(0.0, 0.0, 1.5)
    mid = V3(*[(a + b + c) / 3.0 for a, b, c in zip(*p)])
    d = V3(mid.x, mid.y + 0.02, mid.z - 1.5)
    terms = raster.intersect(o, d, *p)
    df = _triangles(spark, sf).withColumns(terms).filter("t is not null")
    hit = F.when(raster.is_hit(F.col("u"), F.col("v")), 1).otherwise(0)
    return df.select("fid", *[clean(F.col(c)).alias(c) for c in ("u", "v", "t")], hit.alias("hit"))


_RAYS = f"""ray0 AS (SELECT i AS idx, (2 * ((i % {S.cols} + 1) / {float(S.cols)}::DOUBLE) - 1) * {S.cols / S.rows * _K!r}::DOUBLE AS x,
  (1 - 2 * ((i // {S.cols} + 1) / {float(S.rows)}::DOUBLE)) * {_K!r}::DOUBLE AS y FROM range({S.rows * S.cols}) q(i)),
  rr AS (SELECT idx, x / sqrt(x*x + y*y + 1) AS dx, y / sqrt(x*x + y*y + 1) AS dy, -1.0::DOUBLE / sqrt(x*x + y*y + 1) AS dz,
    {EYE[0]}::DOUBLE AS ox, {EYE[1]}::DOUBLE AS oy, {EYE[2]}::DOUBLE AS oz FROM ray0),
  pr AS (SELECT * FROM rr, fp), {_mt_sql('pr')},
  near AS (SELECT idx, min(t) AS t, arg_min(fid, t) AS fid FROM mt WHERE {_HIT} GROUP BY idx)"""


@query("ray2_nearest_triangle", f"WITH {BASE}, {_RAYS} SELECT idx, fid, {t.r6('t')} AS t FROM near")
def ray2(spark, sf):
    h = raster.nearest_hits(_triangles(spark, sf), S, POSE)
    return h.select("idx", "fid", clean(F.col("t")).alias("t"))


@query("ray4_hit_normals", f"""WITH {BASE}, {FACE_N}, {_RAYS} SELECT idx, fid, {', '.join(t.r6(f'n{a} / sqrt(nx*nx + ny*ny + nz*nz)') + f' AS n{a}' for a in 'xyz')}
FROM near JOIN fn USING (fid)""")
def ray4(spark, sf):
    h = raster.hit_normals(_triangles(spark, sf), S, POSE)
    return h.select("idx", "fid", *[clean(F.col(f"n{a}")).alias(f"n{a}") for a in "xyz"])


@query("ray5_generate_depth", f"WITH {BASE}, {_RAYS} SELECT q.i AS idx, {t.r6('coalesce(t, 100000)')} AS depth FROM range({S.rows * S.cols}) q(i) LEFT JOIN near ON near.idx = q.i")
def ray5(spark, sf):
    d = raster.ray_depth(_triangles(spark, sf), S, POSE)
    return d.select("idx", clean(F.col("depth")).alias("depth"))


W, H, NEAR, FAR = 64, 48, 1.0, 1000.0
WINDOW = raster.screen_window(0.980, 0.735, W, H, NEAR, 20.0)


def _raster_sql():
    left, right, bottom, top = WINDOW
    cols = []
    for k in range(3):
        x, y, z = (f"(p{k}{a} - {e}::DOUBLE)" for a, e in zip("xyz", EYE))
        sx, sy = f"({NEAR}::DOUBLE * {x} / nullif(-{z}, 0))", f"({NEAR}::DOUBLE * {y} / nullif(-{z}, 0))"
        nx = f"(2 * {sx} / {right - left!r}::DOUBLE - {(right + left) / (right - left)!r}::DOUBLE)"
        ny = f"(2 * {sy} / {top - bottom!r}::DOUBLE - {(top + bottom) / (top - bottom)!r}::DOUBLE)"
        cols += [f"({nx} + 1) / 2 * {W} AS r{k}x", f"(1 - {ny}) / 2 * {H} AS r{k}y", f"-{z} AS r{k}z"]
    return f"rs AS (SELECT fid, {', '.join(cols)} FROM fp)"


_R = [f"r{k}{a}" for k in range(3) for a in "xyz"]


def _rastered(spark, sf):
    return raster.raster_triangles(_triangles(spark, sf), W2C, WINDOW, NEAR, W, H)


@query("ras2_to_raster", f"WITH {BASE}, {_raster_sql()} SELECT fid, {', '.join(t.r6(c) + f' AS {c}' for c in _R)} FROM rs")
def ras2(spark, sf):
    return _rastered(spark, sf).select("fid", *[clean(F.col(c)).alias(c) for c in _R])


def _edge_sql(a, b, cx, cy):
    return f"(({cx} - r{a}x) * (r{b}y - r{a}y) - ({cy} - r{a}y) * (r{b}x - r{a}x))"


@query("ras3_signed_area", f"WITH {BASE}, {_raster_sql()} SELECT fid, {t.r6(_edge_sql(0, 1, 'r2x', 'r2y'))} AS area, {t.r6('least(r0x, r1x, r2x)')} AS xmin, {t.r6('greatest(r0x, r1x, r2x)')} AS xmax FROM rs")
def ras3(spark, sf):
    c = F.col
    area = raster.edge_function(c("r0x"), c("r0y"), c("r1x"), c("r1y"), c("r2x"), c("r2y"))
    xs = [c(f"r{k}x") for k in range(3)]
    return _rastered(spark, sf).select("fid", clean(area).alias("area"), clean(F.least(*xs)).alias("xmin"), clean(F.greatest(*xs)).alias("xmax"))


_ZB = f"""{BASE}, {_raster_sql()}, px AS (SELECT x, y FROM range({W}) a(x), range({H}) b(y)),
  cv AS (SELECT *, {_edge_sql(1, 2, '(x + 0.5)', '(y + 0.5)')} AS w0, {_edge_sql(2, 0, '(x + 0.5)', '(y + 0.5)')} AS w1,
    {_edge_sql(0, 1, '(x + 0.5)', '(y + 0.5)')} AS w2, {_edge_sql(0, 1, 'r2x', 'r2y')} AS area FROM rs, px WHERE r0z > 0 AND r1z > 0 AND r2z > 0),
  cz AS (SELECT *, 1 / (w0 / area / r0z + w1 / area / r1z + w2 / area / r2z) AS z FROM cv WHERE w0 >= 0 AND w1 >= 0 AND w2 >= 0 AND area <> 0),
  zb AS (SELECT x, y, arg_min(fid, z) AS fid, min(z) AS z FROM cz WHERE z < {FAR} GROUP BY x, y)"""


def _zb(spark, sf):
    return raster.z_buffer(_rastered(spark, sf), W, H, FAR)


@query("ras4_z_buffer", f"WITH {_ZB} SELECT x, y, fid, {t.r6('z')} AS z FROM zb")
def ras4(spark, sf):
    return _zb(spark, sf).select("x", "y", "fid", clean(F.col("z")).alias("z"))


_FN = FACE_N
_CAM = {a: f"(p{{k}}{a} - {e}::DOUBLE)" for a, e in zip("xyz", EYE)}


def _mix(a):
    return " + ".join(f"({_CAM[a].format(k=k)} / -{_CAM['z'].format(k=k)}) * (c.w{k} / c.area)" for k in range(3))


@query("ras5_facing_ratio", f"""WITH {_ZB}, {_FN}, sh AS (SELECT zb.x, zb.y, zb.fid, zb.z, nx, ny, nz, ({_mix('x')}) * zb.z AS px_, ({_mix('y')}) * zb.z AS py_
FROM zb JOIN cz c ON c.x = zb.x AND c.y = zb.y AND c.fid = zb.fid JOIN fn ON fn.fid = zb.fid)
SELECT x, y, fid, {t.r6('greatest(0, (-nx*px_ - ny*py_ + nz*z) / (sqrt(nx*nx + ny*ny + nz*nz) * sqrt(px_*px_ + py_*py_ + z*z)))')} AS shade FROM sh""")
def ras5(spark, sf):
    s = raster.facing(_zb(spark, sf), _triangles(spark, sf), W2C)
    return s.select("x", "y", "fid", clean(F.col("shade")).alias("shade"))
