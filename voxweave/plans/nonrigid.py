"""Non-rigid solver, sparse algebra and plane-fit queries (SOL8-16, PLN)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..config import NonRigid, Rigid
from ..functions.dualquat import PARTS
from ..functions.plane import Plane
from ..functions.vec import V3, clean
from ..operators import knn, linalg, mesh, nonrigid, planefit, rigid
from ..runtime import cut
from . import dqsql as q
from . import tables as t
from .image import normals_sql
from .neighbours import BASE, CFG, VERTEX_EDGES, edges_sql, vertex_edges
from .registry import query
from .surface import FACE_N, FACE_POS

EPS = 1e-6


def _dim(i):
    return F.col("embedding")[i].cast("double")


def observations(spark, sf):
    """Points to be moved a little, with a unit normal from three further dimensions."""
    e = t.read(spark, sf, "embeddings")
    n = V3(_dim(3), _dim(4), _dim(5)).normalize()
    return e.select(F.col("vec_id").alias("obs_id"), _dim(0).alias("x"), _dim(1).alias("y"), _dim(2).alias("z"),
                    (_dim(0) + 0.01).alias("tx"), (_dim(1) - 0.02).alias("ty"), (_dim(2) + 0.015).alias("tz"),
                    *n.named("n"))


_NL = "sqrt(e4*e4 + e5*e5 + e6*e6)"
OBS = f"""o AS (SELECT vec_id AS qid, e1 AS x, e2 AS y, e3 AS z, e1 + 0.01::DOUBLE AS tx, e2 - 0.02::DOUBLE AS ty, e3 + 0.015::DOUBLE AS tz,
  e4 / {_NL} AS nx, e5 / {_NL} AS ny, e6 / {_NL} AS nz FROM
  (SELECT vec_id, {', '.join(f'embedding[{i}]::DOUBLE AS e{i}' for i in range(1, 7))} FROM embeddings))"""
_W = q.position(list(PARTS), ["x", "y", "z"])
RES = f"""{BASE}, {VERTEX_EDGES}, {OBS}, {q.sums_cte()}, {q.unit_cte('bs', 'bu')},
  res AS (SELECT qid AS i, {q.dot(['nx', 'ny', 'nz'], [f'(t{a} - {c})' for a, c in zip('xyz', _W)])} AS val FROM o JOIN bu USING (qid))"""


@query("sol8_data_residual", f"WITH {RES} SELECT i, {t.r6('val')} AS val FROM res")
def sol8_residual(spark, sf):
    r = nonrigid.residuals(observations(spark, sf), t.nodes(spark, sf), vertex_edges(spark, sf))
    return r.select("i", clean(F.col("val")).alias("val"))


def _jac_sql():
    ax = [f"(CASE WHEN p % 3 = {k} THEN weight * 0.5 ELSE 0 END)" for k in range(3)]
    unit = ["0.0::DOUBLE", *ax]
    real = q.hamilton(unit, [f"n.r{a}" for a in "wxyz"])
    dual = q.hamilton(unit, [f"(CASE WHEN p < 3 THEN n.d{a} ELSE n.r{a} END)" for a in "wxyz"])
    d = [f"CASE WHEN p < 3 THEN {c} ELSE 0 END AS d{i}" for i, c in enumerate(real)] + [f"{c} AS d{i + 4}" for i, c in enumerate(dual)]
    base = ", ".join(f"b.{p} AS b{i}" for i, p in enumerate(PARTS))
    end = {s: q.position([f"{s}{i}" for i in range(8)], ["x", "y", "z"]) for s in "ef"}

    def side(s, sign):
        num = [f"(b{i} {sign} d{i} * {EPS}::DOUBLE)" for i in range(8)]
        n = f"sqrt({num[0]}*{num[0]} + {num[1]}*{num[1]} + {num[2]}*{num[2]} + {num[3]}*{num[3]})"
        return ", ".join(f"{c} / {n} AS {s}{i}" for i, c in enumerate(num))
    slope = q.dot(["nx", "ny", "nz"], [f"({a} - {b})" for a, b in zip(end["e"], end["f"])])
    return f"""j0 AS (SELECT e.qid, e.node_id, p, o.*, {base}, {', '.join(d)} FROM edges e JOIN nodes n USING (node_id)
        JOIN (SELECT qid AS oq, x, y, z, nx, ny, nz FROM o) o ON o.oq = e.qid JOIN bs b ON b.qid = e.qid, range(6) g(p)),
      j1 AS (SELECT *, {side('e', '+')}, {side('f', '-')} FROM j0),
      j2 AS (SELECT qid AS i, node_id * 6 + p AS j, -{slope} / {2 * EPS!r}::DOUBLE AS g FROM j1),
      jac AS (SELECT i, j, CASE WHEN g IS NULL OR abs(g) > 100 THEN 0 ELSE g END AS val FROM j2)"""


JAC = _jac_sql()


def _jacobian(spark, sf, edges=None):
    return nonrigid.data_jacobian(observations(spark, sf), t.nodes(spark, sf), edges or vertex_edges(spark, sf), EPS)


@query("sol9_data_jacobian", f"WITH {RES}, {JAC} SELECT i, j, {t.r6('val')} AS val FROM jac")
def sol9(spark, sf):
    return _jacobian(spark, sf).select("i", "j", clean(F.col("val")).alias("val"))


_NE = edges_sql("nodes", "node_id", True, 1e-4, name="ne")
_TI = q.position([f"a.{p}" for p in PARTS], ["c.x", "c.y", "c.z"])
_TJ = q.position([f"c.{p}" for p in PARTS], ["c.x", "c.y", "c.z"])
LINKS = f"""{BASE}, {_NE}, lk AS (SELECT e.qid AS node_id, e.node_id AS nbr_id, greatest(e.weight, coalesce(b.weight, e.weight)) AS weight
    FROM ne e LEFT JOIN ne b ON b.qid = e.node_id AND b.node_id = e.qid),
  lp AS (SELECT l.*, {', '.join(f'{x} AS a{k}' for k, x in zip('xyz', _TI))}, {', '.join(f'{x} AS b{k}' for k, x in zip('xyz', _TJ))}
    FROM lk l JOIN nodes a ON a.node_id = l.node_id JOIN nodes c ON c.node_id = l.nbr_id)"""
SMOOTH = " UNION ALL ".join(f"SELECT node_id * 3 + {k} AS i, sum(weight * (a{a} - b{a})) AS val FROM lp GROUP BY node_id" for k, a in enumerate("xyz"))


def _node_edges(spark, sf):
    return knn.node_edges(t.nodes(spark, sf), CFG)


@query("sol11_smooth_residual", f"WITH {LINKS}, sr AS ({SMOOTH}) SELECT i, {t.r6('val')} AS val FROM sr")
def sol11_residual(spark, sf):
    r = nonrigid.smooth_residuals(t.nodes(spark, sf), _node_edges(spark, sf))
    return r.select("i", clean(F.col("val")).alias("val"))


def _blocks_sql():
    def rows(p, node, sign):
        m = [["0", f"{p}z", f"-{p}y", "1", "0", "0"], [f"-{p}z", "0", f"{p}x", "0", "1", "0"], [f"{p}y", f"-{p}x", "0", "0", "0", "1"]]
        return [f"SELECT node_id * 3 + {r} AS i, {node} * 6 + {c} AS j, {sign} * weight * ({m[r][c]}) AS val FROM lp" for r in range(3) for c in range(6)]
    return " UNION ALL ".join(rows("a", "node_id", "1") + rows("b", "nbr_id", "-1"))


@query("sol11_smooth_jacobian", f"WITH {LINKS}, sj AS ({_blocks_sql()}) SELECT i, j, {t.r6('sum(val)')} AS val FROM sj GROUP BY i, j")
def sol11_jacobian(spark, sf):
    j = nonrigid.smooth_jacobian(t.nodes(spark, sf), _node_edges(spark, sf))
    return j.select("i", "j", clean(F.col("val")).alias("val"))


@query("sol12_normal_matrix", f"WITH {RES}, {JAC} SELECT a.j AS i, b.j AS j, round(sum(a.val * b.val), 5) + 0.0 AS val FROM jac a JOIN jac b ON a.i = b.i GROUP BY a.j, b.j")
def sol12(spark, sf):
    return linalg.gram(cut(_jacobian(spark, sf))).select("i", "j", clean(F.col("val"), 5).alias("val"))


@query("sol12_gradient", f"WITH {RES}, {JAC} SELECT jac.j AS i, round(-sum(jac.val * res.val), 5) + 0.0 AS val FROM jac JOIN res USING (i) GROUP BY jac.j")
def sol12_gradient(spark, sf):
    edges = cut(vertex_edges(spark, sf))
    r = nonrigid.residuals(observations(spark, sf), t.nodes(spark, sf), edges)
    return linalg.gradient(_jacobian(spark, sf, edges), r).select("i", clean(F.col("val"), 5).alias("val"))


# -- dense rows as sparse matrices -------------------------------------------------------
def _coo(spark, sf):
    e = t.read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("i"), F.posexplode(F.slice("embedding", 1, 6)).alias("j", "val")).select(
        "i", F.col("j").cast("long").alias("j"), F.col("val").cast("double").alias("val"))


COO = "m AS (SELECT vec_id AS i, j, embedding[j + 1]::DOUBLE AS val FROM embeddings, range(6) g(j))"


def _val(df):
    return df.select(*[c for c in df.columns if c != "val"], clean(F.col("val")).alias("val"))


@query("sol14_matmul", f"WITH {COO} SELECT a.j AS i, b.j AS j, {t.r6('sum(a.val * b.val)')} AS val FROM m a JOIN m b USING (i) GROUP BY a.j, b.j")
def sol14_matmul(spark, sf):
    m = _coo(spark, sf)
    return _val(linalg.matmul(linalg.transpose(m), m))


@query("sol14_transpose", f"WITH {COO} SELECT j AS i, i AS j, {t.r6('val')} AS val FROM m")
def sol14_transpose(spark, sf):
    return _val(linalg.transpose(_coo(spark, sf)))


@query("sol14_add", f"""WITH {COO}, d AS (SELECT DISTINCT i FROM m) SELECT i, j, {t.r6('sum(val)')} AS val
FROM (SELECT i, j, 2 * val AS val FROM m UNION ALL SELECT i, i, -1.0 FROM d) GROUP BY i, j""")
def sol14_add(spark, sf):
    m = _coo(spark, sf)
    return _val(linalg.add(m, linalg.identity(m.select("i").distinct()), 2.0, -1.0))


@query("sol14_matvec", f"WITH {COO} SELECT m.i, {t.r6('sum(m.val * (m.j + 1))')} AS val FROM m GROUP BY m.i")
def sol14_matvec(spark, sf):
    m = _coo(spark, sf)
    x = m.select(F.col("j").alias("i")).distinct().withColumn("val", (F.col("i") + 1).cast("double"))
    return _val(linalg.matvec(m, x))


@query("sol14_vector_sum", f"""WITH v AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS p, embedding[2]::DOUBLE AS q FROM embeddings)
SELECT i, {t.r6('p + 0.5 * q')} AS val FROM v""")
def sol14_vector_sum(spark, sf):
    e = t.read(spark, sf, "embeddings")
    a, b = (e.select(F.col("vec_id").alias("i"), _dim(k).alias("val")) for k in (0, 1))
    return _val(linalg.add_vectors(a, b, 1.0, 0.5))


def _least_squares(spark, sf):
    m = _coo(spark, sf)
    rhs = t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), (-_dim(6)).alias("val"))
    a = linalg.matmul(linalg.transpose(m), m)
    return a, linalg.gradient(m, rhs)


def _eliminated(damping):
    """The normal equations as one row, and a CTE per unknown that is eliminated."""
    n = range(6)
    start = [f"sum(e{p} * e{q}) + {damping if p == q else 0.0}::DOUBLE AS a{p}{q}" for p in n for q in n] + [f"sum(e{p} * e6) AS b{p}" for p in n]
    raw = ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(7))
    ctes = [f"s0 AS (SELECT {', '.join(start)} FROM (SELECT {raw} FROM embeddings))"]
    for k in n:
        cells = []
        for p in n:
            for c, by in [(f"a{p}{q}", f"a{k}{q}") for q in n if q > k] + [(f"b{p}", f"b{k}")]:
                cells.append(f"{c} / a{k}{k} AS {c}" if p == k else f"{c} - a{p}{k} * {by} / a{k}{k} AS {c}")
        ctes.append(f"s{k + 1} AS (SELECT {', '.join(cells)} FROM s{k})")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {p}::BIGINT AS i, {t.r6(f'b{p}')} AS val FROM s6" for p in n)


@query("sol13_solve_dense", _eliminated(0.0))
def sol13_dense(spark, sf):
    """The normal equations of all vectors by gradients."""
    return _val(linalg.solve(*_least_squares(spark, sf)))


@query("sol13_solve_gradients", _eliminated(0.5))
def sol13_cg(spark, sf):
    """The same with damping."""
    return _val(linalg.solve(*_least_squares(spark, sf), 0.5))


@query("sol13_solve_fronts", f"WITH {RES}, {JAC}, g AS (SELECT j AS i, -sum(jac.val * res.val) AS val FROM jac JOIN res USING (i) GROUP BY j), "
       f"u AS (SELECT node_id * 6 + p AS i FROM nodes, range(6) r(p)) SELECT i, round(coalesce(val, 0), 5) + 0.0 AS val FROM u LEFT JOIN g USING (i)")
def sol13_fronts(spark, sf):
    """The non-rigid step of all nodes by elimination, put back into the equations: (A + damping I) x must be the gradient."""
    cfg = NonRigid(damping=1e-3)
    a, _, x = nonrigid.step(observations(spark, sf), t.nodes(spark, sf), cut(vertex_edges(spark, sf)), cfg=cfg)
    back = linalg.add_vectors(linalg.matvec(a, x), x, 1.0, cfg.damping)
    return back.select("i", clean(F.col("val"), 5).alias("val"))


@query("sol15_register_mesh")
def sol15(spark, sf):
    """Node transforms after the solver; the points are to move by a fixed small shift."""
    cfg = NonRigid(iterations=2, damping=1e-3)
    nodes, _ = nonrigid.solve(observations(spark, sf), t.nodes(spark, sf), vertex_edges(spark, sf), None, cfg)
    return nodes.select("node_id", *[clean(F.col(p)).alias(p) for p in PARTS])


# -- onto depth images -------------------------------------------------------------------
_FRAME = t.SMALL
_LINKED = NonRigid(iterations=1, damping=1e-3, regularization=0.5)


def _image_sql():
    """Pixels of each small frame as vertices, warped by the graph and matched with the frame after it."""
    cam = f"cam AS (SELECT (frame_id + 1) * {_FRAME.rows * _FRAME.cols} + idx AS id, frame_id + 1 AS frame_id, x, y, z, nx, ny, nz FROM nn)"
    at = q.position(list(PARTS), ["x", "y", "z"])
    turned = q.rotate([f"r{a}" for a in "wxyz"], ["nx", "ny", "nz"])
    pix = lambda f, c, a: f"({f}::DOUBLE * {a} / nullif(wz, 0) + {c}::DOUBLE)"
    near = lambda e: f"(floor(abs({e}) + 0.5) * sign({e}))::BIGINT"
    gap = " + ".join(f"(w{a} - l.{a}) * (w{a} - l.{a})" for a in "xyz")
    return f"""{t.pixels_sql(_FRAME)}, {normals_sql(_FRAME)}, nn AS (SELECT * FROM normals WHERE nx IS NOT NULL), {cam},
  {BASE}, {edges_sql('cam', 'id', False, 1e-5)}, {q.sums_cte()}, {q.unit_cte('bs', 'bu')},
  wp AS (SELECT c.*, {', '.join(f'{e} AS w{a}' for a, e in zip('xyz', at))}, {', '.join(f'{e} AS m{a}' for a, e in zip('xyz', turned))} FROM cam c JOIN bu ON bu.qid = c.id),
  pj AS (SELECT *, {near(pix(_FRAME.fx, _FRAME.cx, 'wx'))} AS pu, {near(pix(_FRAME.fy, _FRAME.cy, 'wy'))} AS pv FROM wp WHERE wz > 0),
  o AS (SELECT pj.id AS qid, pj.x, pj.y, pj.z, l.x AS tx, l.y AS ty, l.z AS tz, l.nx, l.ny, l.nz FROM pj JOIN nn l ON l.frame_id = pj.frame_id
    AND l.idx = pv * {_FRAME.cols} + pu AND pu BETWEEN 0 AND {_FRAME.cols - 1} AND pv BETWEEN 0 AND {_FRAME.rows - 1}
    WHERE abs(mx*l.nx + my*l.ny + mz*l.nz) > {math.cos(math.pi / 10)!r} AND sqrt({gap}) <= 0.1),
  res AS (SELECT qid AS i, {q.dot(['nx', 'ny', 'nz'], [f'(t{a} - {c})' for a, c in zip('xyz', _W)])} AS val FROM o JOIN bu USING (qid))"""


IMAGE = _image_sql()


def _image(spark, sf):
    """(vertices, live, nodes, edges): each frame's points are to be carried onto the frame after it."""
    live = cut(rigid.prepared(t.pixels(spark, sf, _FRAME), _FRAME, Rigid()))
    then = F.col("frame_id") + 1
    vertices = live.withColumn("obs_id", then * _FRAME.rows * _FRAME.cols + F.col("idx")).withColumn("frame_id", then).drop("idx")
    nodes = t.nodes(spark, sf)
    return vertices, live, nodes, cut(knn.observation_edges(vertices, nodes, CFG))


@query("sol8_image_residual", f"WITH {IMAGE} SELECT i, {t.r6('val')} AS val FROM res")
def sol8_image(spark, sf):
    vertices, live, nodes, edges = _image(spark, sf)
    obs = nonrigid.associate(vertices, live, nodes, edges, _FRAME)
    return nonrigid.residuals(obs, nodes, edges).select("i", clean(F.col("val")).alias("val"))


@query("sol15_image_step", f"""WITH {IMAGE}, {JAC}, {LINKS.removeprefix(BASE + ', ')}, sr AS ({SMOOTH}), sj AS (SELECT i, j, sum(val) AS val FROM ({_blocks_sql()}) GROUP BY i, j),
  g AS (SELECT jac.j AS i, -sum(jac.val * res.val) AS val FROM jac JOIN res USING (i) GROUP BY jac.j UNION ALL
    SELECT sj.j, -{_LINKED.regularization}::DOUBLE * sum(sj.val * sr.val) FROM sj JOIN sr USING (i) GROUP BY sj.j),
  gs AS (SELECT i, sum(val) AS val FROM g GROUP BY i), un AS (SELECT node_id * 6 + p AS i FROM nodes, range(6) r(p))
SELECT i, round(coalesce(val, 0), 5) + 0.0 AS val FROM un LEFT JOIN gs USING (i)""")
def sol15_image_step(spark, sf):
    """One step onto images with smoothness, put back into its equations: (A + damping I) x must be the gradient."""
    vertices, live, nodes, edges = _image(spark, sf)
    obs = cut(nonrigid.associate(vertices, live, nodes, edges, _FRAME, _LINKED))
    a, _, x = nonrigid.image_step(obs, nodes, edges, cut(_node_edges(spark, sf)), _LINKED)
    back = linalg.add_vectors(linalg.matvec(a, x), x, 1.0, _LINKED.damping)
    return back.select("i", clean(F.col("val"), 5).alias("val"))


@query("sol15_register_image")
def sol15_image(spark, sf):
    """Node transforms after steps onto the images, with smoothness between linked nodes."""
    vertices, live, nodes, edges = _image(spark, sf)
    found, _ = nonrigid.solve_image(vertices, live, nodes, edges, _FRAME, _node_edges(spark, sf), _LINKED)
    return found.select("node_id", *[clean(F.col(p)).alias(p) for p in PARTS])


@query("sol16_error", f"WITH {RES} SELECT {t.r6('sum(val * val)')} AS error, count(*) AS n FROM res")
def sol16(spark, sf):
    e = nonrigid.error(observations(spark, sf), t.nodes(spark, sf), vertex_edges(spark, sf))
    return e.select(clean(F.col("error")).alias("error"), "n")


# -- planes ------------------------------------------------------------------------------
_TRI = ["p0", "p1", "p2"]


def _planes(spark, sf):
    return mesh.face_positions(t.triangles(spark, sf), t.vertices(spark, sf))


@query("pln2_scatter", f"""WITH p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT label::BIGINT AS label, {', '.join(t.r6(f'sum({a}*{b}) - count(*) * avg({a}) * avg({b})') + f' AS v{a}{b}' for i, a in enumerate('xyz') for b in 'xyz'[i:])} FROM p GROUP BY label""")
def pln2(spark, sf):
    s = planefit.scatter(planefit.moments(_labelled(spark, sf), ["label"]), ["label"])
    return s.select("label", *[clean(F.col(f"v{a}{b}")).alias(f"v{a}{b}") for i, a in enumerate("xyz") for b in "xyz"[i:]])


def _labelled(spark, sf):
    return t.read(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"),
                                                  *[_dim(i).alias(a) for i, a in enumerate("xyz")])


def _fit_sql():
    """Least eigenvalue by the angle form for symmetric 3x3 matrices, its vector as the longest product of two rows."""
    at = lambda i, j: f"v{min(i, j)}{max(i, j)}"
    rows = [[f"({at(a, b)} - low)" if a == b else at(a, b) for b in "xyz"] for a in "xyz"]
    cross = lambda u, v: [f"{u[1]} * {v[2]} - {u[2]} * {v[1]}", f"{u[2]} * {v[0]} - {u[0]} * {v[2]}", f"{u[0]} * {v[1]} - {u[1]} * {v[0]}"]
    options = " UNION ALL ".join(f"SELECT label, cx, cy, cz, {', '.join(f'{c} AS u{a}' for a, c in zip('xyz', cross(rows[i], rows[j])))} FROM e2" for i, j in ((0, 1), (0, 2), (1, 2)))
    n, s = "sqrt(ux*ux + uy*uy + uz*uz)", "CASE WHEN uz < 0 THEN -1 ELSE 1 END"
    return f"""WITH p AS (SELECT label::BIGINT AS label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
m AS (SELECT label, {', '.join(f'avg({a}) AS c{a}' for a in 'xyz')}, {', '.join(f'covar_pop({a}, {b}) AS v{a}{b}' for i, a in enumerate('xyz') for b in 'xyz'[i:])} FROM p GROUP BY label),
e0 AS (SELECT *, (vxx + vyy + vzz) / 3 AS mid FROM m),
e1 AS (SELECT *, sqrt(((vxx-mid)**2 + (vyy-mid)**2 + (vzz-mid)**2 + 2 * (vxy*vxy + vxz*vxz + vyz*vyz)) / 6) AS wide FROM e0),
e2 AS (SELECT *, mid + 2 * wide * cos(acos(greatest(-1, least(1, ((vxx-mid) * ((vyy-mid)*(vzz-mid) - vyz*vyz) - vxy * (vxy*(vzz-mid) - vyz*vxz)
  + vxz * (vxy*vyz - (vyy-mid)*vxz)) / (2 * wide**3)))) / 3 + 2 * pi() / 3) AS low FROM e1),
o AS ({options}), l AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {n} DESC) AS k FROM o),
f AS (SELECT label, cx, cy, cz, {', '.join(f'{s} * u{a} / {n} AS n{a}' for a in 'xyz')} FROM l WHERE k = 1),
g AS (SELECT label, nx, ny, nz, -(nx*cx + ny*cy + nz*cz) AS d FROM f),
r AS (SELECT label, avg(abs(nx*x + ny*y + nz*z + d)) AS residual FROM p JOIN g USING (label) GROUP BY label)
SELECT label, {', '.join(f'{t.r6(c)} AS {c}' for c in ('nx', 'ny', 'nz', 'd', 'residual'))} FROM g JOIN r USING (label)"""


@query("pln2_fit", _fit_sql())
def pln2_fit(spark, sf):
    p = _labelled(spark, sf)
    planes = planefit.fit(p, "label")
    out = planefit.mean_residual(p, planes, "label").join(planes, "label")
    return out.select("label", *[clean(F.col(c)).alias(c) for c in ("nx", "ny", "nz", "d", "residual")])


_L = "sqrt(nx*nx + ny*ny + nz*nz)"


@query("pln1_plane_algebra", f"""WITH {t.points_sql()}, {t.vertices_sql()}, {t.triangles_sql()}, {FACE_POS}, {FACE_N},
u AS (SELECT fid, nx / {_L} AS ux, ny / {_L} AS uy, nz / {_L} AS uz, p0x, p0y, p0z FROM fn WHERE {_L} > 0),
d AS (SELECT *, -(ux*p0x + uy*p0y + uz*p0z) AS pd FROM u), s AS (SELECT *, ux*0.1 + uy*0.2 + uz*0.3 + pd AS sd FROM d)
SELECT fid, {t.r6('sd')} AS dist, {t.r6('0.1 - ux*sd')} AS cx, {t.r6('0.2 - uy*sd')} AS cy, {t.r6('0.3 - uz*sd')} AS cz, {t.r6('-pd / uz')} AS lz,
{t.r6('-uy / sqrt(ux*ux + uy*uy)')} AS dx_, {t.r6('ux / sqrt(ux*ux + uy*uy)')} AS dy_,
{t.r6('-pd * ux / (ux*ux + uy*uy)')} AS qx, {t.r6('-pd * uy / (ux*ux + uy*uy)')} AS qy FROM s""")
def pln1(spark, sf):
    """Per face: signed distance and closest point of (.1,.2,.3), where the z axis meets the
    plane, and its line in common with the plane z = 0 (direction and nearest point)."""
    a, b, c = (V3.of(p) for p in _TRI)
    pl = Plane.from_points(a, b, c)
    df = _planes(spark, sf).withColumns({**pl.n.as_map("u"), "pd": pl.d}).filter("ux is not null")
    pl = Plane(V3.of("u"), F.col("pd"))
    p = V3.lit(0.1, 0.2, 0.3)
    near = pl.closest_point(p)
    axis = pl.intersect_line(V3.lit(0, 0, 0), V3.lit(0, 0, 1))
    # z = 0 has normal +z; the common line of the two planes
    point, direction = Plane(V3.lit(0, 0, 1), F.lit(0.0)).intersect_plane(pl)
    vals = {"dist": pl.signed_distance(p), "cx": near.x, "cy": near.y, "cz": near.z, "lz": axis.z,
            "dx_": direction.x, "dy_": direction.y, "qx": point.x, "qy": point.y}
    return df.select("fid", *[clean(v).alias(n) for n, v in vals.items()])
