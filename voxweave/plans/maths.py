"""Scalar function queries (MTH): vectors, matrices, quaternions over the embedding columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dualquat import DualQuat
from ..functions.mat import Mat, idx2c, idx2f, sum_rows
from ..functions.quat import Quat, euler_from_matrix
from ..functions.vec import V3, clean, clamp, lerp
from ..sources.text import numbers, words
from . import dqsql as q
from . import tables as t
from .registry import query

# e1..e16 are the first sixteen embedding dimensions.
E_SQL = f"e AS (SELECT vec_id AS id, {', '.join(f'embedding[{i}]::DOUBLE AS e{i}' for i in range(1, 17))} FROM embeddings)"


def _e(spark, sf):
    return t.read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), *[F.col("embedding")[i - 1].cast("double").alias(f"e{i}") for i in range(1, 17)])


def _c(*i):
    return [F.col(f"e{k}") for k in i]


def _v(a):
    return V3(*_c(a, a + 1, a + 2))


def _out(df, vals):
    return df.select("id", *[clean(c).alias(n) for n, c in vals.items()])


def _sql(vals, ctes="", src="e"):
    return f"WITH {E_SQL}{ctes} SELECT id, {', '.join(f'{t.r6(x)} AS {n}' for n, x in vals.items())} FROM {src}"


_A, _B = ["e1", "e2", "e3"], ["e4", "e5", "e6"]
_AXB = q.cross(_A, _B)
_LA, _LB = "sqrt(e1*e1 + e2*e2 + e3*e3)", "sqrt(e4*e4 + e5*e5 + e6*e6)"


@query("mth1_vectors", _sql({
    "dot": q.dot(_A, _B), "cx": _AXB[0], "cy": _AXB[1], "cz": _AXB[2], "len": _LA, "ux": f"e1 / {_LA}",
    "lo": "least(e1, e4)", "hi": "greatest(e2, e5)", "lx": "e1 + (e4 - e1) * 0.25", "cl": "least(greatest(e3, -0.1), 0.1)",
    "fl": "floor(e1 * 10)", "ab": "abs(e2)", "rx": f"e1 - (e4 / {_LB}) * 2 * (e1*e4 + e2*e5 + e3*e6) / {_LB}",
    "dist": "sqrt((e1-e4)**2 + (e2-e5)**2 + (e3-e6)**2)", "less": "CASE WHEN e1 < e4 AND e2 < e5 AND e3 < e6 THEN 1 ELSE 0 END",
    "s": "sign(e1)", "total": "e1 + e2 + e3"}))
def mth1(spark, sf):
    a, b = _v(1), _v(4)
    x = a.cross(b)
    return _out(_e(spark, sf), {
        "dot": a.dot(b), "cx": x.x, "cy": x.y, "cz": x.z, "len": a.length(), "ux": a.normalize().x, "lo": a.min(b).x,
        "hi": a.max(b).y, "lx": lerp(a.x, b.x, 0.25), "cl": clamp(a.z, -0.1, 0.1), "fl": (a * 10.0).floor().x.cast("double"),
        "ab": a.abs().y, "rx": a.reflect(b.normalize()).x, "dist": a.distance(b),
        "less": F.when(a.less(b), 1.0).otherwise(0.0), "s": F.signum(a.x), "total": sum_rows(a)})


@query("mth4_matrix2", _sql({
    "det": "e1*e4 - e2*e3", "i00": "e4 / (e1*e4 - e2*e3)", "i01": "-e2 / (e1*e4 - e2*e3)", "t01": "e3",
    "p00": "e1*e5 + e2*e8", "p12": "e3*e7 + e4*e10"}))
def mth4(spark, sf):
    m = Mat.cols(["e1", "e2", "e3", "e4"], 2)
    n = Mat.cols([f"e{i}" for i in range(5, 11)], 3)
    p, inv = m @ n, m.inverse()
    return _out(_e(spark, sf), {"det": m.det(), "i00": inv[0, 0], "i01": inv[0, 1], "t01": m.T[0, 1],
                                "p00": p[0, 0], "p12": p[1, 2]})


_D3 = "(e1*(e5*e9 - e6*e8) - e2*(e4*e9 - e6*e7) + e3*(e4*e8 - e5*e7))"


@query("mth5_matrix3", _sql({
    "det": f"1000 * {_D3}", "i00": f"(e5*e9 - e6*e8) / {_D3}", "i21": f"-(e1*e8 - e2*e7) / {_D3}", "tr": "e1 + e5 + e9",
    "fro": "sqrt(e1*e1+e2*e2+e3*e3+e4*e4+e5*e5+e6*e6+e7*e7+e8*e8+e9*e9)", "ox": "e1*e12", "vy": "e4*e10 + e5*e11 + e6*e12",
    "sum12": "e6 + e9", "n1": "greatest(abs(e1)+abs(e4)+abs(e7), abs(e2)+abs(e5)+abs(e8), abs(e3)+abs(e6)+abs(e9))"}))
def mth5(spark, sf):
    m = Mat.cols([f"e{i}" for i in range(1, 10)], 3)
    inv, v = m.inverse(), V3(*_c(10, 11, 12))
    return _out(_e(spark, sf), {
        "det": m.det() * 1000.0, "i00": inv[0, 0], "i21": inv[2, 1], "tr": m.trace(), "fro": m.norm(),
        "ox": Mat.outer(tuple(_v(1)), tuple(v))[0, 2], "vy": (m @ v).y,
        "sum12": (m + Mat.build([[0.0] * 3, [0.0, 0.0, m[2, 2]], [0.0] * 3]))[1, 2], "n1": m.norm("1")})


_Q = [f"(e{i} / sqrt(e1*e1 + e2*e2 + e3*e3 + e4*e4))" for i in (1, 2, 3, 4)]
_UQ = f", u AS (SELECT *, {', '.join(f'{c} AS q{a}' for c, a in zip(_Q, 'wxyz'))} FROM e)"
_R = [["1 - 2*(qy*qy + qz*qz)", "2*(qx*qy - qw*qz)", "2*(qx*qz + qw*qy)"], ["2*(qx*qy + qw*qz)", "1 - 2*(qx*qx + qz*qz)", "2*(qy*qz - qw*qx)"],
      ["2*(qx*qz - qw*qy)", "2*(qy*qz + qw*qx)", "1 - 2*(qx*qx + qy*qy)"]]


def _with_q(df):
    return df.withColumns(dict(zip(("qw", "qx", "qy", "qz"), Quat(*_c(1, 2, 3, 4)).normalize())))


def _apply_r(v):
    return ["(" + " + ".join(f"({r[k]}) * {v[k]}" for k in range(3)) + ")" for r in _R]


_MV = _apply_r(["e8", "e9", "e10"])
_IV = ["(" + " + ".join(f"({_R[k][c]}) * ({v} - {w})" for k, (v, w) in enumerate(zip(("e8", "e9", "e10"), ("e5", "e6", "e7")))) + ")" for c in range(3)]


@query("mth7_rigid_matrix", _sql({"x": f"{_MV[0]} + e5", "y": f"{_MV[1]} + e6", "z": f"{_MV[2]} + e7", "ix": _IV[0], "iy": _IV[1],
                                  "iz": _IV[2], "bx": "e8", "by_": "e9", "det": "1.0"}, _UQ, "u"))
def mth7(spark, sf):
    df = _with_q(_e(spark, sf))
    m = Mat.rigid(Quat.of().matrix(), _v(5))
    df = df.select("id", "e8", "e9", "e10", *m.named("m"))
    m = Mat.cols([f"m{i}{j}" for i in range(4) for j in range(4)], 4)
    v = V3(*_c(8, 9, 10))
    p, b = m @ v, m.rigid_inverse() @ v
    df = df.withColumns({**p.as_map("p"), **b.as_map("i"), "det": m.det()})
    back = m.rigid_inverse() @ V3.of("p")
    return _out(df, {**V3.of("p").as_map(), **V3.of("i").as_map("i"), "bx": back.x, "by_": back.y, "det": F.col("det")})


@query("mth8_full_inverse", _sql({**{f"d{i}": "1.0" for i in range(4)}, "o01": "0.0", "o32": "0.0", "ok": "1"}))
def mth8(spark, sf):
    """A well conditioned general 4x4 times its inverse is the identity."""
    m = Mat.cols([f"e{i}" for i in range(1, 17)], 4) + Mat.identity(4).scale(2.0)
    df = _e(spark, sf).select("id", *m.named("m"))
    m = Mat.cols([f"m{i}{j}" for i in range(4) for j in range(4)], 4)
    df = df.select("id", *m.named("m"), *m.inverse().named("n"))
    n = Mat.cols([f"n{i}{j}" for i in range(4) for j in range(4)], 4)
    p = m @ n
    vals = {f"d{i}": p[i, i] for i in range(4)}
    return _out(df, {**vals, "o01": p[0, 1], "o32": p[3, 2], "ok": F.when(n.finite(), 1.0).otherwise(0.0)})


_QQ = q.hamilton(["e1", "e2", "e3", "e4"], ["e5", "e6", "e7", "e8"])


@query("mth10_quaternion_algebra", _sql({
    "w": _QQ[0], "x": _QQ[1], "y": _QQ[2], "z": _QQ[3], "norm": "sqrt(e1*e1+e2*e2+e3*e3+e4*e4)", "dot": "e1*e5+e2*e6+e3*e7+e4*e8",
    "iw": "e1 / (e1*e1+e2*e2+e3*e3+e4*e4)", "ix": "-e2 / (e1*e1+e2*e2+e3*e3+e4*e4)", "one": "1.0", "cx": "e3*e8 - e4*e7", "sw": "e1 + e5", "dz": "e4 - e8"}))
def mth10(spark, sf):
    a, b = Quat(*_c(1, 2, 3, 4)), Quat(*_c(5, 6, 7, 8))
    p, i = a * b, a.inverse()
    return _out(_e(spark, sf), {"w": p.w, "x": p.x, "y": p.y, "z": p.z, "norm": a.norm(), "dot": a.dot(b), "iw": i.w, "ix": i.x,
                                "one": (a / a).w, "cx": a.cross(b).x, "sw": (a + b).w, "dz": (a - b).z})


_ROT = q.rotate(["qw", "qx", "qy", "qz"], ["e5", "e6", "e7"])
_SP = "2*(qw*qy - qz*qx)"


@query("mth11_rotations", _sql({
    "x": _ROT[0], "y": _ROT[1], "z": _ROT[2], "r01": _R[0][1], "r22": _R[2][2], "roll": "atan2(2*(qw*qx + qy*qz), 1 - 2*(qx*qx + qy*qy))",
    "pitch": f"CASE WHEN abs({_SP}) >= 1 THEN sign({_SP}) * pi() / 2 ELSE asin(greatest(least({_SP}, 1), -1)) END",
    "yaw": "atan2(2*(qw*qz + qx*qy), 1 - 2*(qy*qy + qz*qz))", "angle": "2 * atan2(sqrt(qx*qx+qy*qy+qz*qz), qw)",
    "axis": "qx / sqrt(qx*qx+qy*qy+qz*qz)"}, _UQ, "u"))
def mth11(spark, sf):
    r, m = Quat.of(), Quat.of().matrix()
    v, e = r.rotate(_v(5)), r.euler()
    axis, angle = r.axis_angle()
    return _out(_with_q(_e(spark, sf)), {**v.as_map(), "r01": m[0, 1], "r22": m[2, 2], "roll": e.x, "pitch": e.y, "yaw": e.z,
                                         "angle": angle, "axis": axis.x})


@query("mth9_constructors", _sql({"w": "abs(qw)", "x": "sign(qw) * qx", "y": "sign(qw) * qy", "z": "sign(qw) * qz",
                                  "ew": "sign(qw) * qw", "ex": "sign(qw) * qx", "aw": "cos(e9)", "ax": f"sin(e9) * e1 / {_LA}"}, _UQ, "u"))
def mth9(spark, sf):
    """Rotation matrix, Euler and axis-angle constructors; q and -q are the same rotation."""
    df = _with_q(_e(spark, sf))
    r = Quat.of()
    df = df.withColumns(dict(zip(("mw", "mx", "my", "mz"), Quat.from_matrix(r.matrix())))).withColumns(r.euler().as_map("a"))
    m = Quat.of("m")
    e = Quat.from_euler(*V3.of("a"))
    df = df.withColumns({"sm": F.signum("mw"), "gw": e.w, "gx": e.x})
    aa = Quat.from_axis_angle(_v(1), F.col("e9") * 2.0)
    return _out(df, {**{a: F.col("sm") * c for a, c in zip("wxyz", m)}, "ew": F.signum("gw") * F.col("gw"),
                     "ex": F.signum("gw") * F.col("gx"), "aw": aa.w, "ax": aa.x})


_DUAL = q.hamilton(["0", "e5", "e6", "e7"], ["qw", "qx", "qy", "qz"])


@query("mth12_dual_quaternions", _sql({
    "dw": f"0.5 * {_DUAL[0]}", "dx": f"0.5 * {_DUAL[1]}", "tx": "e5", "ty": "e6", "tz": "e7", "px": f"{q.rotate(['qw', 'qx', 'qy', 'qz'], ['e8', 'e9', 'e10'])[0]} + e5",
    "py": f"{q.rotate(['qw', 'qx', 'qy', 'qz'], ['e8', 'e9', 'e10'])[1]} + e6", "nz": q.rotate(["qw", "qx", "qy", "qz"], ["e8", "e9", "e10"])[2],
    "back": "e8", "moved": "e6 + e11", "same": "1"}, _UQ, "u"))
def mth12(spark, sf):
    df = _with_q(_e(spark, sf))
    d = DualQuat.rigid(Quat.of(), _v(5))
    df = df.select("id", *[f"e{i}" for i in range(1, 17)], *d.named())
    d, v = DualQuat.of(), V3(*_c(8, 9, 10))
    p, n, tr = d.transform_position(v), d.transform_normal(v), d.translation()
    df = df.withColumns({**p.as_map("p"), **d.inverse().as_map("i")})
    back = DualQuat.of("i").transform_position(V3.of("p"))
    one = d * DualQuat.of("i")
    return _out(df, {"dw": d.dual.w, "dx": d.dual.x, **tr.as_map("t"), "px": F.col("px"), "py": F.col("py"), "nz": n.z, "back": back.x,
                     "moved": d.add_translation(V3(*_c(10, 11, 12))).translation().y, "same": one.real.w})


@query("mth13_compose", _sql({"x": f"{_ROT[0]} + e9", "y": f"{_ROT[1]} + e10", "z": f"{_ROT[2]} + e11", "w": "1.0", "m03": "e9", "m12": _R[1][2], "roll": "atan2(2*(qw*qx + qy*qz), 1 - 2*(qx*qx + qy*qy))"}, _UQ, "u"))
def mth13(spark, sf):
    """Translation first, rotation after it, then a shift: the product maps the origin."""
    df = _with_q(_e(spark, sf))
    first = DualQuat.rigid(Quat.lit(1, 0, 0, 0), _v(5))
    d = first.add_rotation(Quat.of()).add_translation(_v(9))
    df = df.select("id", *d.named()).withColumns(DualQuat.of().translation().as_map())
    pure = DualQuat.rigid(Quat.of(), _v(9))
    src = _with_q(_e(spark, sf)).select("id", *[c.alias(f"k{n}") for n, c in pure.as_map().items()])
    j = df.join(src, "id")
    m = DualQuat.of("k").matrix()
    return _out(j, {**V3.of().as_map(), "w": DualQuat.of().real.norm(), "m03": m[0, 3], "m12": m[1, 2], "roll": DualQuat.of("k").euler().x})


@query("mth14_euler_from_matrix", _sql({
    "roll": f"atan2({_R[2][1]}, {_R[2][2]})", "pitch": f"atan2(-({_R[2][0]}), sqrt(({_R[2][1]})*({_R[2][1]}) + ({_R[2][2]})*({_R[2][2]})))",
    "yaw": f"atan2({_R[1][0]}, {_R[0][0]})", "deg": f"degrees(atan2({_R[1][0]}, {_R[0][0]}))"}, _UQ, "u"))
def mth14(spark, sf):
    e = euler_from_matrix(Quat.of().matrix())
    return _out(_with_q(_e(spark, sf)), {"roll": e.x, "pitch": e.y, "yaw": e.z, "deg": F.degrees(e.z)})


@query("mth15_split_line", """WITH l AS (SELECT event_id AS id, event_id || ' ' || user_id || ' ' || printf('%.2f', value) AS line FROM events)
SELECT id, len(string_split(line, ' ')) AS n, round(list_sum(list_transform(string_split(line, ' '), lambda x: x::DOUBLE)), 4) + 0.0 AS total, string_split(line, ' ')[2] AS word FROM l""")
def mth15(spark, sf):
    line = F.format_string("%d %d %.2f", "event_id", "user_id", "value")
    df = t.read(spark, sf, "events").select(F.col("event_id").alias("id"), line.alias("line"))
    total = F.aggregate(numbers(F.col("line")), F.lit(0.0), lambda a, x: a + x)
    return df.select("id", F.size(words(F.col("line"))).cast("long").alias("n"), clean(total, 4).alias("total"),
                     F.get(words(F.col("line")), 1).alias("word"))


@query("mth16_linear_index", "SELECT vec_id AS id, (vec_id % 7) * 10 + vec_id % 10 AS c, (vec_id % 7) * 10 + vec_id % 10 AS f FROM embeddings")
def mth16(spark, sf):
    i, j = F.col("vec_id") % 10, F.col("vec_id") % 7
    return t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), idx2c(i, j, 10).alias("c"),
                                                  idx2f(i + 1, j + 1, 10).alias("f"))
