"""Nearest-neighbour and deformation-graph queries (KNN, GRF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Graph
from ..functions.vec import clean
from ..operators import graph, knn
from ..operators import pixels as px
from . import tables as t
from .registry import query

CFG = Graph(k=4, radius=t.RADIUS)
LINEAR = Graph(k=4, radius=t.RADIUS, exp_weight=False)
S = t.BIG
BASE = f"{t.points_sql()}, {t.nodes_sql()}"


def edges_sql(q, qid, exclude, floor, k=4, exp=True, name="edges", nodes="nodes"):
    """CTE name(qid, rank, node_id, dist, weight): every pair, ranked."""
    d = "sqrt((q.x-n.x)*(q.x-n.x) + (q.y-n.y)*(q.y-n.y) + (q.z-n.z)*(q.z-n.z))"
    w = f"exp(-(dist*dist) / {t.RADIUS ** 2}::DOUBLE)" if exp else \
        f"first_value(dist) OVER (PARTITION BY qid ORDER BY rank) * {t.RADIUS}::DOUBLE / dist"
    on = f"q.{qid} <> n.node_id" if exclude else "TRUE"
    return f"""p_{name} AS (SELECT q.{qid} AS qid, n.node_id, greatest({d}, {floor}::DOUBLE) AS dist FROM {q} q JOIN {nodes} n ON {on}),
      r_{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, node_id)::INT AS rank FROM p_{name}),
      {name} AS (SELECT qid, rank, node_id, dist, {w} AS weight FROM r_{name} WHERE rank <= {k})"""


def _edges(df, *ids):
    return df.select(*ids, clean(F.col("dist")).alias("dist"), clean(F.col("weight")).alias("weight"))


_NODE = edges_sql("nodes", "node_id", True, 1e-4)
_OUT = f"{t.r6('dist')} AS dist, {t.r6('weight')} AS weight"


@query("knn2_node_neighbours", f"WITH {BASE}, {_NODE} SELECT qid, rank, node_id, {t.r6('dist')} AS dist FROM edges")
def knn2(spark, sf):
    n = t.nodes(spark, sf)
    q = n.select(F.col("node_id").alias("qid"), "x", "y", "z")
    out = knn.knn(q, n, 4, exclude_self=True, floor=1e-4)
    return out.select("qid", "rank", "node_id", clean(F.col("dist")).alias("dist"))


@query("knn3_linear_weights", f"WITH {BASE}, {edges_sql('nodes', 'node_id', True, 1e-4, exp=False)} SELECT qid AS node_id, rank, node_id AS nbr_id, {_OUT} FROM edges")
def knn3(spark, sf):
    return _edges(knn.node_edges(t.nodes(spark, sf), LINEAR), "node_id", "rank", "nbr_id")


@query("knn4_node_edges", f"WITH {BASE}, {_NODE} SELECT qid AS node_id, rank, node_id AS nbr_id, {_OUT} FROM edges")
def knn4(spark, sf):
    return _edges(knn.node_edges(t.nodes(spark, sf), CFG), "node_id", "rank", "nbr_id")


def vertex_edges(spark, sf):
    obs = t.points(spark, sf).withColumnRenamed("idx", "obs_id")
    return knn.observation_edges(obs, t.nodes(spark, sf), CFG, exclude_self=True)


VERTEX_EDGES = edges_sql("points", "idx", True, 1e-5)


@query("knn8_vertex_edges", f"WITH {BASE}, {VERTEX_EDGES} SELECT qid AS obs_id, rank, node_id, {_OUT} FROM edges")
def knn8(spark, sf):
    return _edges(vertex_edges(spark, sf), "obs_id", "rank", "node_id")


_PX, _PY, _PZ = t.xyz_sql(S)
_PIXQ = f"""{t.pixels_sql()}, cam AS (SELECT frame_id * 10000 + idx AS id, {_PX} AS x, {_PY} AS y, {_PZ} AS z FROM pixels
  WHERE depth BETWEEN 0.15 AND 2.0)"""


@query("knn6_pixel_edges", f"WITH {_PIXQ}, {BASE}, {edges_sql('cam', 'id', False, 1e-5)} SELECT qid AS obs_id, rank, node_id, {_OUT} FROM edges")
def knn6(spark, sf):
    p = px.back_project(px.depth_filter(t.pixels(spark, sf)), S)
    obs = p.select((F.col("frame_id") * 10000 + F.col("idx")).alias("obs_id"), "x", "y", "z")
    return _edges(knn.observation_edges(obs, t.nodes(spark, sf), CFG), "obs_id", "rank", "node_id")


@query("knn10_nearest", f"WITH {BASE}, {edges_sql('points', 'idx', False, 0, k=1)} SELECT qid, node_id, {t.r6('dist')} AS dist FROM edges")
def knn10(spark, sf):
    q = t.points(spark, sf).withColumnRenamed("idx", "qid")
    return knn.nearest(q, t.nodes(spark, sf)).select("qid", "node_id", clean(F.col("dist")).alias("dist"))


@query("knn11_large_k", f"WITH {BASE}, {edges_sql('points', 'idx', False, 0, k=12, nodes='pn')} SELECT qid, rank, node_id, {t.r6('dist')} AS dist FROM edges"
       .replace(f"{t.nodes_sql()}", f"{t.nodes_sql()}, pn AS (SELECT idx AS node_id, x, y, z FROM points)"))
def knn11(spark, sf):
    """All points against all points, so the tree has more than one level."""
    p = t.points(spark, sf)
    out = knn.knn(p.withColumnRenamed("idx", "qid"), p.withColumnRenamed("idx", "node_id"), 12)
    return out.select("qid", "rank", "node_id", clean(F.col("dist")).alias("dist"))


_V = f"{t.points_sql()}, {t.vertices_sql()}"
_DQ = "1.0::DOUBLE AS rw, " + ", ".join(f"0.0::DOUBLE AS {p}" for p in ("rx", "ry", "rz", "dw", "dx", "dy", "dz"))


def _pos(df, *ids):
    return df.select(*ids, *[clean(F.col(c)).alias(c) for c in "xyz"])


_XYZ = ", ".join(f"{t.r6(c)} AS {c}" for c in "xyz")


@query("grf1_init_nodes", f"WITH {_V} SELECT vid AS node_id, vid AS vertex_id, {_XYZ}, {_DQ} FROM vertices")
def grf1(spark, sf):
    n = graph.init_nodes(t.vertices(spark, sf))
    return n.withColumns({c: clean(F.col(c)) for c in "xyz"})


@query("grf2_sample_random", f"WITH {_V} SELECT vid, {_XYZ} FROM vertices ORDER BY (vid * 2654435761) % 4294967296, vid LIMIT 273")
def grf2(spark, sf):
    return _pos(graph.sample_random(t.vertices(spark, sf), 273), "vid")


@query("grf3_sample_first", f"WITH {_V} SELECT vid, {_XYZ} FROM vertices ORDER BY vid LIMIT 273")
def grf3(spark, sf):
    return _pos(graph.sample_first(t.vertices(spark, sf), 273), "vid")


@query("grf4_sample_with_replacement", f"""WITH {_V}, o AS (SELECT *, row_number() OVER (ORDER BY vid) - 1 AS at_ FROM vertices),
d AS (SELECT i AS draw, CAST('0x' || substr(md5('1234:' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM vertices) AS at_ FROM range(273) r(i))
SELECT draw, vid, {_XYZ} FROM d JOIN o USING (at_)""")
def grf4(spark, sf):
    return _pos(graph.sample_with_replacement(t.vertices(spark, sf), 273), "draw", "vid")


def solution(spark, sf):
    """Six numbers per node from the embeddings."""
    e = t.read(spark, sf, "embeddings")
    names = ("roll", "pitch", "yaw", "tx", "ty", "tz")
    return e.select(F.col("vec_id").alias("node_id"),
                    *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names, 10)])


SOLUTION = """sol AS (SELECT vec_id AS node_id, embedding[11]::DOUBLE AS roll, embedding[12]::DOUBLE AS pitch,
  embedding[13]::DOUBLE AS yaw, embedding[14]::DOUBLE AS tx, embedding[15]::DOUBLE AS ty, embedding[16]::DOUBLE AS tz
  FROM embeddings)"""
SOLVED = f"""{SOLUTION}, half AS (SELECT *, cos(roll/2) AS cr, sin(roll/2) AS sr, cos(pitch/2) AS cp, sin(pitch/2) AS sp,
  cos(yaw/2) AS cy, sin(yaw/2) AS sy FROM sol),
  sq AS (SELECT *, cy*cp*cr + sy*sp*sr AS qw, cy*cp*sr - sy*sp*cr AS qx, sy*cp*sr + cy*sp*cr AS qy, sy*cp*cr - cy*sp*sr AS qz FROM half),
  sdq AS (SELECT node_id, qw, qx, qy, qz, -0.5*(tx*qx + ty*qy + tz*qz) AS tw_, 0.5*(tx*qw + ty*qz - tz*qy) AS tx_,
    0.5*(-tx*qz + ty*qw + tz*qx) AS ty_, 0.5*(tx*qy - ty*qx + tz*qw) AS tz_ FROM sq)"""


@query("grf5_update_nodes", f"""WITH {BASE}, {SOLVED} SELECT node_id, {', '.join(t.r6(f'coalesce({a}, {b})') + f' AS {b}' for a, b in zip(
    ('qw', 'qx', 'qy', 'qz', 'tw_', 'tx_', 'ty_', 'tz_'), ('rw', 'rx', 'ry', 'rz', 'dw', 'dx', 'dy', 'dz')))}
FROM nodes LEFT JOIN sdq USING (node_id)""")
def grf5(spark, sf):
    out = graph.update_nodes(t.nodes(spark, sf), solution(spark, sf))
    return out.select("node_id", *[clean(F.col(p)).alias(p) for p in graph.DualQuat.identity().as_map()])
