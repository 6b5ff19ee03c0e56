"""Rigid registration queries (SOL1-7, STR2): each small frame against the one before it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..config import Rigid
from ..functions import weights
from ..functions.vec import clean
from ..operators import pixels as px
from ..operators import rigid
from ..operators import voxels as vx
from ..streaming import tracking
from . import tables as t
from .image import normals_sql
from .registry import query

S, C = t.SMALL, t.COARSE
_B = f"{t.pixels_sql(S)}, {normals_sql(S)}, nn AS (SELECT * FROM normals WHERE nx IS NOT NULL)"
# A fixed small twist, so that the projection is not the identity.
XI = (0.01, -0.02, 0.015, 0.02, 0.01, -0.01)
M = rigid.se3_exp([XI])[0].tolist()


def _moved(a):
    i = "xyz".index(a)
    return f"({M[i][0]!r}::DOUBLE * x + {M[i][1]!r}::DOUBLE * y + {M[i][2]!r}::DOUBLE * z + {M[i][3]!r}::DOUBLE)"


def _pix(f, c, a):
    e = f"({f}::DOUBLE * {a} / nullif(pz, 0) + {c}::DOUBLE)"
    return f"(floor(abs({e}) + 0.5) * sign({e}))::BIGINT"


TERMS = f"""{_B}, mv AS (SELECT frame_id, nx, ny, nz, {', '.join(f'{_moved(a)} AS p{a}' for a in 'xyz')} FROM nn),
  pj AS (SELECT *, {_pix(S.fx, S.cx, 'px')} AS pu, {_pix(S.fy, S.cy, 'py')} AS pv FROM mv),
  mt AS (SELECT s.frame_id, px, py, pz, q.x AS qx, q.y AS qy, q.z AS qz, q.nx AS tx, q.ny AS ty, q.nz AS tz FROM pj s
    JOIN nn q ON q.frame_id + 1 = s.frame_id AND q.idx = pv * {S.cols} + pu WHERE pu BETWEEN 0 AND {S.cols - 1} AND pv BETWEEN 0 AND {S.rows - 1}
    AND abs(s.nx*q.nx + s.ny*q.ny + s.nz*q.nz) > {math.cos(math.pi / 10)!r}),
  jr AS (SELECT frame_id, py*tz - pz*ty AS c0, pz*tx - px*tz AS c1, px*ty - py*tx AS c2, tx AS c3, ty AS c4, tz AS c5,
    (px-qx)*tx + (py-qy)*ty + (pz-qz)*tz AS e FROM mt)"""


def _terms(spark, sf, cfg=Rigid()):
    pix = t.pixels(spark, sf, S)
    pts = rigid.prepared(pix, S, cfg)
    target = pts.withColumn("frame_id", F.col("frame_id") + 1)
    state = rigid.initial_state(pix.select("frame_id").distinct())
    fixed = {f"m{i}{j}": F.lit(M[i][j]) for i in range(3) for j in range(4)}
    return rigid.terms(pts, target, state.withColumns(fixed), S, cfg)


_SUMS = ", ".join([f"{t.r6(f'sum(c{i}*c{j})')} AS a{i}{j}" for i in range(6) for j in range(i, 6)]
                  + [f"{t.r6(f'sum(-c{i}*e)')} AS b{i}" for i in range(6)])


@query("sol1_normal_equations", f"WITH {TERMS} SELECT frame_id, count(*) AS matches, {_SUMS} FROM jr GROUP BY frame_id")
def sol1(spark, sf):
    s = rigid.normal_sums(_terms(spark, sf))
    return s.select("frame_id", "matches", *[clean(F.col(c)).alias(c) for c in rigid.A_COLS + rigid.B_COLS])


_HUBER = "CASE WHEN abs(e) > 0.05 THEN 0.05 / abs(e) ELSE 1 END"
_TUKEY = "CASE WHEN abs(e) > 0.05 THEN 0 ELSE (1 - (e/0.05)*(e/0.05)) * (1 - (e/0.05)*(e/0.05)) END"


@query("sol6_robust_weights", f"""WITH {TERMS} SELECT frame_id, {t.r6(f'sum({_HUBER})')} AS huber, {t.r6(f'sum({_TUKEY})')} AS tukey,
{t.r6('sum(1 / greatest(abs(e), 0.001))')} AS l1, {t.r6(f'sum({_HUBER} * c5 * c5)')} AS weighted FROM jr GROUP BY frame_id""")
def sol6(spark, sf):
    e = F.col("e")
    h = weights.robust("huber", e, 0.05)
    bounded = weights.robust("l1", F.greatest(F.abs(e), F.lit(0.001)), 0.0)
    r = _terms(spark, sf).groupBy("frame_id").agg(
        F.sum(h).alias("huber"), F.sum(weights.robust("tukey", e, 0.05)).alias("tukey"), F.sum(bounded).alias("l1"),
        F.sum(h * F.col("c5") * F.col("c5")).alias("weighted"))
    return r.select("frame_id", *[clean(F.col(c)).alias(c) for c in ("huber", "tukey", "l1", "weighted")])


@query("sol7_photometric_terms", f"""WITH {t.pixels_sql(S)}, l AS (SELECT frame_id, idx, u, v, depth, (r*0.2126::DOUBLE + g*0.7152::DOUBLE + b*0.0722::DOUBLE) / 2550 AS luma FROM pixels),
d AS (SELECT *, (luma - lag(luma) OVER (PARTITION BY frame_id ORDER BY idx)) / 2 AS gx, (luma - lag(luma, {S.cols}) OVER (PARTITION BY frame_id ORDER BY idx)) / 2 AS gy FROM l)
SELECT a.frame_id, {t.r6(f'sum(0.5 * (a.gx * {S.fx} / a.depth) * (a.gx * {S.fx} / a.depth))')} AS a33, {t.r6(f'sum(0.5 * (a.gy * {S.fy} / a.depth) * (a.gy * {S.fy} / a.depth))')} AS a44,
{t.r6(f'sum(-0.5 * (a.gx * {S.fx} / a.depth) * (a.luma - p.luma))')} AS b3
FROM d a JOIN l p ON p.frame_id + 1 = a.frame_id AND p.idx = a.idx WHERE a.gx IS NOT NULL AND a.gy IS NOT NULL AND a.depth BETWEEN 0.15 AND 2.0 GROUP BY a.frame_id""")
def sol7(spark, sf):
    """Translation columns of the colour term between same-index pixels of two frames."""
    tenth = {c: F.col(c) / 2550.0 for c in "rgb"}
    pix = t.pixels(spark, sf, S).withColumns(tenth)
    g = px.color_gradient(pix, S)
    prev = px.intensity(pix).select((F.col("frame_id") + 1).alias("frame_id"), "idx", F.col("luma").alias("pl"))
    j = px.depth_filter(g.filter("gx is not null and gy is not null")).join(prev, ["frame_id", "idx"])
    zero = F.lit(0.0)
    fx, fy = F.try_divide(F.lit(S.fx), "depth"), F.try_divide(F.lit(S.fy), "depth")
    cols = {f"j{a}{i}": zero for a in "xy" for i in range(6)}
    cols.update({"jx3": fx, "jy4": fy, "ec": F.col("luma") - F.col("pl")})
    s = rigid.normal_sums(rigid.photometric_terms(j.withColumns(cols), 0.5))
    return s.select("frame_id", *[clean(F.col(c)).alias(c) for c in ("a33", "a44", "b3")])


FEW = Rigid(iterations=(0, 0, 4))


def _relative(spark, sf):
    pix = t.pixels(spark, sf, S)
    target = pix.withColumn("frame_id", F.col("frame_id") + 1)
    return rigid.register(pix, target, S, FEW, pix.select("frame_id").distinct())


@query("sol2_register_frames")
def sol2(spark, sf):
    r = _relative(spark, sf)
    return r.select("frame_id", *[clean(F.col(c)).alias(c) for c in rigid.XI + rigid.POSE], "iteration")


@query("str2_track_and_fuse")
def str2(spark, sf):
    """Frame-to-frame tracking, chained to world poses, then fused."""
    pix = t.pixels(spark, sf, S)
    poses = rigid.poses_of(rigid.chain(_relative(spark, sf)))
    return vx.fuse(pix, poses, S, C).withColumn("sdf", clean(F.col("sdf")))


SEQUENCE = 3  # frames of a sequence


@query("str2_track_to_model")
def str2_model(spark, sf):
    """Poses of sequences of consecutive frames, each tracked against the map of the frames before it."""
    pix = t.pixels(spark, sf, S)
    pix = pix.withColumns({"seq": F.expr(f"frame_id div {SEQUENCE}"), "step": F.col("frame_id") % SEQUENCE}).drop("frame_id")
    poses, _ = tracking.track_to_model(pix, S, FEW, C)
    return poses.select("seq", "step", *[clean(F.col(c)).alias(c) for c in rigid.POSE])
