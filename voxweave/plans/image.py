"""Pixel and image queries (PIX, IMG)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..config import Sensor
from ..functions import camera, weights
from ..functions.vec import V3, clean
from ..operators import pixels as px
from . import tables as t
from .registry import query

S = t.BIG
X, Y, Z = t.xyz_sql(S)
PIX = t.pixels_sql()


def _cleaned(*names):
    return [clean(F.col(n)).alias(n) for n in names]


def _r(*names):
    return ", ".join(f"{t.r6(n)} AS {n}" for n in names)


@query("pix1_back_project", f"WITH {PIX} SELECT frame_id, idx, {t.r6(X)} AS x, {t.r6(Y)} AS y, {t.r6(Z)} AS z FROM pixels")
def pix1(spark, sf):
    return px.back_project(t.pixels(spark, sf), S).select("frame_id", "idx", *_cleaned("x", "y", "z"))


def _proj_sql(x, y, z, s=S):
    def axis(f, c, a):
        e = f"({f}::DOUBLE * ({a}) / nullif(({z}), 0) + {c}::DOUBLE)"
        return f"(floor(abs({e}) + 0.5) * sign({e}))::BIGINT"
    return axis(s.fx, s.cx, x), axis(s.fy, s.cy, y)


_SHIFT = (0.05, -0.02, 0.1)
_PX = [f"({a} + {d}::DOUBLE)" for a, d in zip((X, Y, Z), _SHIFT)]
_U, _V = _proj_sql(*_PX)


@query("pix2_project", f"""WITH {PIX}, q AS (SELECT frame_id, idx, {_U} AS pu, {_V} AS pv FROM pixels)
SELECT *, CASE WHEN pu >= 0 AND pu < {S.cols} AND pv >= 0 AND pv < {S.rows} THEN 1 ELSE 0 END AS inside FROM q""")
def pix2(spark, sf):
    p = camera.back_project(S, F.col("depth")) + V3.lit(*_SHIFT)
    df = px.project(t.pixels(spark, sf), S, p)
    inside = F.when(camera.in_image(S, F.col("pu"), F.col("pv")), 1).otherwise(0)
    return df.select("frame_id", "idx", "pu", "pv", inside.alias("inside"))


@query("pix3_point_cloud", f"""WITH {PIX} SELECT frame_id, idx,
 CASE WHEN depth > 0 THEN {t.r6(X)} ELSE 0.0 END AS x, CASE WHEN depth > 0 THEN {t.r6(Y)} ELSE 0.0 END AS y,
 CASE WHEN depth > 0 THEN {t.r6(Z)} ELSE 0.0 END AS z FROM pixels""")
def pix3(spark, sf):
    return px.point_cloud(t.pixels(spark, sf), S).select("frame_id", "idx", *_cleaned("x", "y", "z"))


def _apply_sql(x, y, z):
    return [f"(m{i}0 * {x} + m{i}1 * {y} + m{i}2 * {z} + m{i}3)" for i in range(3)]


_W = _apply_sql(X, Y, Z)


@query("pix4_rigid_transform", f"""WITH {PIX}, {t.poses_sql()}, {t.pose_rows_sql()}
SELECT frame_id, idx, {t.r6(_W[0])} AS x, {t.r6(_W[1])} AS y, {t.r6(_W[2])} AS z
FROM pixels JOIN pm USING (frame_id)""")
def pix4(spark, sf):
    pts = px.back_project(t.pixels(spark, sf), S)
    return px.transform_points(pts, t.poses(spark, sf)).select("frame_id", "idx", *_cleaned("x", "y", "z"))


@query("pix5_valid_depth", f"WITH {PIX} SELECT frame_id, idx, {_r('depth')} FROM pixels WHERE depth BETWEEN 0.15 AND 2.0")
def pix5(spark, sf):
    return px.depth_filter(t.pixels(spark, sf)).select("frame_id", "idx", *_cleaned("depth"))


@query("pix6_frustum", f"""WITH {PIX} SELECT frame_id, idx, {_r('depth')} FROM pixels
WHERE {_PX[2]} >= 0 AND {_U} BETWEEN 0 AND {S.cols - 1} AND {_V} BETWEEN 0 AND {S.rows - 1}""")
def pix6(spark, sf):
    p = camera.back_project(S, F.col("depth")) + V3.lit(*_SHIFT)
    return px.frustum_filter(t.pixels(spark, sf), S, p).select("frame_id", "idx", *_cleaned("depth"))


def normals_sql(s=S, src="pixels"):
    """CTEs pts (valid points) and normals over a pixel CTE."""
    x, y, z = t.xyz_sql(s)
    w = "WINDOW w AS (PARTITION BY frame_id ORDER BY idx)"

    def nb(c, off):
        return (f"first_value({c}) OVER (PARTITION BY frame_id ORDER BY idx "
                f"RANGE BETWEEN {abs(off)} {'PRECEDING' if off < 0 else 'FOLLOWING'} AND "
                f"{abs(off)} {'PRECEDING' if off < 0 else 'FOLLOWING'})")
    steps = []
    for c in "xyz":
        steps += [f"coalesce({nb(c, -2)}, {c}) AS l{c}", f"coalesce({nb(c, 2)}, {c}) AS r{c}",
                  f"coalesce(CASE WHEN idx - {s.cols} > 0 THEN {nb(c, -s.cols)} END, {c}) AS u{c}",
                  f"coalesce({nb(c, s.cols)}, {c}) AS d{c}"]
    a = {c: f"(r{c} - l{c})" for c in "xyz"}
    b = {c: f"(d{c} - u{c})" for c in "xyz"}
    return f"""pts AS (SELECT frame_id, idx, u, v, depth, r, g, b, {x} AS x, {y} AS y, {z} AS z
      FROM {src} WHERE depth BETWEEN 0.15 AND 2.0),
    st AS (SELECT *, {', '.join(steps)} FROM pts),
    cr AS (SELECT *, {a['y']}*{b['z']} - {a['z']}*{b['y']} AS cx, {a['z']}*{b['x']} - {a['x']}*{b['z']} AS cy,
      {a['x']}*{b['y']} - {a['y']}*{b['x']} AS cz FROM st),
    normals AS (SELECT frame_id, idx, u, v, depth, r, g, b, x, y, z,
      cx / nullif(sqrt(cx*cx + cy*cy + cz*cz), 0) AS nx, cy / nullif(sqrt(cx*cx + cy*cy + cz*cz), 0) AS ny,
      cz / nullif(sqrt(cx*cx + cy*cy + cz*cz), 0) AS nz FROM cr)"""


def normals(spark, sf, s: Sensor = S):
    pts = px.back_project(px.depth_filter(t.pixels(spark, sf, s)), s)
    return px.normals_from_points(pts, s)


@query("img1_normals_from_points", f"WITH {PIX}, {normals_sql()} SELECT frame_id, idx, {_r('x', 'y', 'z', 'nx', 'ny', 'nz')} FROM normals")
def img1(spark, sf):
    return normals(spark, sf).select("frame_id", "idx", *_cleaned("x", "y", "z", "nx", "ny", "nz"))


def _nb(c, off):
    way = "PRECEDING" if off < 0 else "FOLLOWING"
    return (f"first_value({c}) OVER (PARTITION BY frame_id ORDER BY idx "
            f"RANGE BETWEEN {abs(off)} {way} AND {abs(off)} {way})")


_ND = f"""dn AS (SELECT frame_id, idx,
  (coalesce({_nb('depth', 2)}, depth) - coalesce({_nb('depth', -2)}, depth)) * {S.depth_scale / 2}::DOUBLE AS gx,
  (coalesce({_nb('depth', 2 * S.cols)}, depth) - coalesce({_nb('depth', -2 * S.cols)}, depth)) * {S.depth_scale / 2}::DOUBLE AS gy
  FROM pixels), dnn AS (SELECT frame_id, idx, -gx / sqrt(gx*gx + gy*gy + 1) AS nx,
  -gy / sqrt(gx*gx + gy*gy + 1) AS ny, 1.0::DOUBLE / sqrt(gx*gx + gy*gy + 1) AS nz FROM dn)"""


@query("img2_normals_from_depth", f"WITH {PIX}, {_ND} SELECT frame_id, idx, {_r('nx', 'ny', 'nz')} FROM dnn")
def img2(spark, sf):
    return px.normals_from_depth(t.pixels(spark, sf), S).select("frame_id", "idx", *_cleaned("nx", "ny", "nz"))


@query("pix7_normal_angle", f"""WITH {PIX}, {normals_sql()}, {_ND}
SELECT p.frame_id, p.idx FROM normals p JOIN dnn d USING (frame_id, idx)
WHERE abs(p.nx*d.nx + p.ny*d.ny + p.nz*d.nz) > {math.cos(math.pi / 10)!r}""")
def pix7(spark, sf):
    # Both normals come from one pass over the frame windows, so no join is needed.
    base = px.normals_from_depth(t.pixels(spark, sf), S, unit=False).withColumnsRenamed(
        {"nx": "mx", "ny": "my", "nz": "mz"})
    pts = px.normals_from_points(px.back_project(px.depth_filter(base), S), S, unit=False)
    return px.angle_filter(pts, V3.of("n"), V3.of("m")).select("frame_id", "idx")


@query("pix8_color_to_float", f"WITH {PIX} SELECT frame_id, idx, {t.r6('r / 255.0::DOUBLE')} AS rf, {t.r6('g / 255.0::DOUBLE')} AS gf, {t.r6('b / 255.0::DOUBLE')} AS bf FROM pixels")
def pix8(spark, sf):
    return px.color_float(t.pixels(spark, sf)).select("frame_id", "idx", *_cleaned("rf", "gf", "bf"))


_LUMA = "(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE)"


@query("pix9_intensity", f"""WITH {PIX}, l AS (SELECT *, {_LUMA} AS luma FROM pixels),
d AS (SELECT *, luma - {_nb('luma', -1)} AS diff FROM l) SELECT frame_id, idx, {_r('luma', 'diff')} FROM d""")
def pix9(spark, sf):
    df = px.intensity(t.pixels(spark, sf))
    df = df.withColumn("diff", F.col("luma") - px.neighbour("luma", -1))
    return df.select("frame_id", "idx", *_cleaned("luma", "diff"))


_HALF = S.resized(50, 50)
_HX, _HY, _ = t.xyz_sql(_HALF, "depth", "(u // 2)", "(v // 2)")


@query("pix10_virtual_sensor", f"WITH {PIX} SELECT frame_id, idx, {t.r6(_HX)} AS x, {t.r6(_HY)} AS y, {_r('depth')} FROM pixels")
def pix10(spark, sf):
    p = camera.back_project(_HALF, F.col("depth"), u=F.expr("u div 2"), v=F.expr("v div 2"))
    df = t.pixels(spark, sf).withColumns({"x": p.x, "y": p.y})
    return df.select("frame_id", "idx", *_cleaned("x", "y", "depth"))


def _conv_sql(kind):
    taps, norm = [], []
    for i in range(-2, 3):
        for j in range(-2, 3):
            off = i * S.cols + j
            w = 1 if kind == "box" else px.BINOMIAL5[i + 2] * px.BINOMIAL5[j + 2]
            v = "depth" if off == 0 else _nb("depth", off)
            if off < 0:
                v = f"CASE WHEN idx + ({off}) < 0 THEN first_value(depth) OVER (PARTITION BY frame_id ORDER BY idx) ELSE {v} END"
            taps.append(f"coalesce({v}, 0) * {w}")
            norm.append(f"CASE WHEN ({v}) IS NULL THEN 0 ELSE {w} END")
    den = "25" if kind == "box" else f"({' + '.join(norm)})"
    return f"WITH {PIX}, c AS (SELECT frame_id, idx, ({' + '.join(taps)}) / {den} AS blurred FROM pixels) SELECT frame_id, idx, {_r('blurred')} FROM c"


@query("img3_box5", _conv_sql("box"))
def img3_box(spark, sf):
    return px.convolve5(t.pixels(spark, sf), S, "box").select("frame_id", "idx", *_cleaned("blurred"))


@query("img3_binomial5", _conv_sql("binomial"))
def img3_binomial(spark, sf):
    return px.convolve5(t.pixels(spark, sf), S, "binomial").select("frame_id", "idx", *_cleaned("blurred"))


def _pyr_sql(scale, cols):
    ou, ov = px.pyramid_offset(S.cols, scale), px.pyramid_offset(S.rows, scale)
    sel = ", ".join(f"max_by({c}, idx) AS {c}" for c in cols)
    out = ", ".join(_r(c) if c == "depth" else c for c in cols)
    return f"""WITH {PIX}, c AS (SELECT frame_id, u // {scale} + {ou} AS pu, v // {scale} + {ov} AS pv, {sel}
      FROM pixels GROUP BY 1, 2, 3) SELECT frame_id, pv * {S.cols} + pu AS idx, pu AS u, pv AS v, {out} FROM c"""


@query("img4_pyramid_depth", _pyr_sql(2, ["depth"]))
def img4(spark, sf):
    return px.pyramid(t.pixels(spark, sf), S, 2).select("frame_id", "idx", "u", "v", *_cleaned("depth"))


@query("img5_pyramid_rgb", _pyr_sql(4, ["r", "g", "b"]))
def img5_rgb(spark, sf):
    return px.pyramid(t.pixels(spark, sf), S, 4, ("r", "g", "b")).select("frame_id", "idx", "u", "v", "r", "g", "b")


@query("img5_pyramid_both", _pyr_sql(4, ["depth", "r", "g", "b"]))
def img5_both(spark, sf):
    df = px.pyramid(t.pixels(spark, sf), S, 4, ("depth", "r", "g", "b"))
    return df.select("frame_id", "idx", "u", "v", *_cleaned("depth"), "r", "g", "b")


def _tap_sql(alias, taps, weight):
    """Sum of in-image taps over the sum of their weights."""
    tot, norm = [], []
    for i, j in taps:
        off = i * S.cols + j
        v = "depth" if off == 0 else _nb("depth", off)
        ok = f"u + ({j}) BETWEEN 0 AND {S.cols - 1} AND v + ({i}) BETWEEN 0 AND {S.rows - 1} AND ({v}) IS NOT NULL"
        w = weight(i, j, v)
        tot.append(f"CASE WHEN {ok} THEN ({v}) * {w} ELSE 0 END")
        norm.append(f"CASE WHEN {ok} THEN {w} ELSE 0 END")
    return f"""WITH {PIX}, c AS (SELECT frame_id, idx, ({' + '.join(tot)}) / nullif({' + '.join(norm)}, 0) AS {alias} FROM pixels)
      SELECT frame_id, idx, {_r(alias)} FROM c"""


def _g_sql(x, s):
    return f"(exp(-({x})*({x}) / {2.0 * s * s}::DOUBLE) / {2 * math.pi * s * s!r}::DOUBLE)"


@query("img7_bilateral", _tap_sql("smoothed", [(i, j) for i in range(-2, 2) for j in range(-2, 2)],
       lambda i, j, v: f"({_g_sql(f'({v}) - depth', 0.5)} * {_g_sql(f'sqrt({i * i + j * j}::DOUBLE)', 3.0)})"))
def img7(spark, sf):
    return px.bilateral(t.pixels(spark, sf), S, 2, 0.5, 3.0).select("frame_id", "idx", *_cleaned("smoothed"))


@query("img8_gaussian", f"WITH {PIX} SELECT frame_id, idx, {t.r6(_g_sql('depth - 1', 0.5))} AS g FROM pixels")
def img8(spark, sf):
    return t.pixels(spark, sf).select("frame_id", "idx", clean(weights.gaussian(F.col("depth") - 1.0, 0.5)).alias("g"))


@query("img9_pixel_distance", f"WITH {PIX} SELECT frame_id, idx, {t.r6(f'sqrt((u - {S.cx}::DOUBLE)**2 + (v - {S.cy}::DOUBLE)**2)')} AS dist FROM pixels")
def img9(spark, sf):
    d = F.hypot(F.col("u") - S.cx, F.col("v") - S.cy)
    return t.pixels(spark, sf).select("frame_id", "idx", clean(d).alias("dist"))


_TAPS = weights.gaussian_taps_2d(3, 1.5)
_TAPW = {(i, j): w for i, j, w in _TAPS}


@query("img10_gaussian_taps", _tap_sql("filtered", list(_TAPW), lambda i, j, v: f"{_TAPW[i, j]!r}::DOUBLE"))
def img10(spark, sf):
    return px.filter_taps(t.pixels(spark, sf), S, _TAPS).select("frame_id", "idx", *_cleaned("filtered"))


_LO, _HI = "least(greatest(u - 3, 0), 99)", "least(greatest(u + 3, 0), 99)"


@query("img11_replicate_padding", f"""WITH {PIX} SELECT a.frame_id, a.idx, {t.r6('l.depth')} AS left_depth, {t.r6('h.depth')} AS right_depth
FROM (SELECT frame_id, idx, v * 100 + {_LO} AS li, v * 100 + {_HI} AS hi FROM pixels) a
LEFT JOIN pixels l ON l.frame_id = a.frame_id AND l.idx = a.li LEFT JOIN pixels h ON h.frame_id = a.frame_id AND h.idx = a.hi""")
def img11(spark, sf):
    """Neighbours three columns away with the border pixel repeated outside the row."""
    lo, hi = px.replicate(S, "depth", -3), px.replicate(S, "depth", 3)
    return t.pixels(spark, sf).select("frame_id", "idx", clean(lo).alias("left_depth"),
                                      clean(hi).alias("right_depth"))


@query("img12_color_gradient", f"""WITH {PIX}, l AS (SELECT *, {_LUMA} AS luma FROM pixels),
d AS (SELECT *, (luma - {_nb('luma', -1)}) / 2 AS gx, (luma - {_nb('luma', -S.cols)}) / 2 AS gy FROM l)
SELECT frame_id, idx, {_r('gx', 'gy')} FROM d""")
def img12(spark, sf):
    return px.color_gradient(t.pixels(spark, sf), S).select("frame_id", "idx", *_cleaned("gx", "gy"))
