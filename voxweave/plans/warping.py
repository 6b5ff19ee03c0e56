"""Skinning queries (BLD) over the point graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dualquat import PARTS
from ..functions.vec import clean
from ..operators import blend
from . import dqsql as q
from . import tables as t
from .neighbours import BASE, VERTEX_EDGES, edges_sql, vertex_edges
from .registry import query

EDGES = f"{BASE}, {VERTEX_EDGES}"
_P8 = ", ".join(f"{t.r6(p)} AS {p}" for p in PARTS)


def _parts(df):
    return df.select("obs_id", *[clean(F.col(p)).alias(p) for p in PARTS])


def _obs(spark, sf):
    return t.points(spark, sf).withColumnRenamed("idx", "obs_id")


@query("bld2_blend_sum", f"WITH {EDGES}, {q.sums_cte()}, {q.unit_cte('bs', 'bu')} SELECT qid AS obs_id, {_P8} FROM bu")
def bld2(spark, sf):
    return _parts(blend.blended(vertex_edges(spark, sf), t.nodes(spark, sf)))


def _sequential_sql():
    step = [f"s.{p} + e{{k}}.weight * n{{k}}.{p}" for p in PARTS]
    ctes = [f"s0 AS (SELECT DISTINCT qid, 1.0::DOUBLE AS rw, {', '.join(f'0.0::DOUBLE AS {p}' for p in PARTS[1:])} FROM edges)"]
    for k in range(1, 5):
        raw = ", ".join(f"{x.format(k=k)} AS {p}" for x, p in zip(step, PARTS))
        ctes.append(f"""a{k} AS (SELECT s.qid, {raw} FROM s{k - 1} s JOIN edges e{k} ON e{k}.qid = s.qid AND e{k}.rank = {k}
          JOIN nodes n{k} ON n{k}.node_id = e{k}.node_id), {q.unit_cte(f'a{k}', f's{k}')}""")
    return ", ".join(ctes)


@query("bld1_blend_sequential", f"WITH {EDGES}, {_sequential_sql()} SELECT qid AS obs_id, {_P8} FROM s4")
def bld1(spark, sf):
    return _parts(blend.blended_sequential(vertex_edges(spark, sf), t.nodes(spark, sf)))


_OWN = f"""own AS (SELECT b.qid, {', '.join(f'coalesce(n.{p}, b.{p}) AS {p}' for p in PARTS)} FROM bu b LEFT JOIN nodes n ON n.vertex_id = b.qid)"""
_POS = q.position(list(PARTS), ["x", "y", "z"])


@query("bld5_blend_mesh", f"""WITH {EDGES}, {q.sums_cte()}, {q.unit_cte('bs', 'bu')}, {_OWN}
SELECT idx AS obs_id, {', '.join(f'{t.r6(c)} AS {a}' for c, a in zip(_POS, 'xyz'))} FROM points JOIN own ON own.qid = idx""")
def bld5(spark, sf):
    out = blend.blend_mesh(_obs(spark, sf), t.nodes(spark, sf), vertex_edges(spark, sf))
    return out.select("obs_id", *[clean(F.col(a)).alias(a) for a in "xyz"])


_SRC = f"""src AS (SELECT vec_id AS node_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
  1.0::DOUBLE AS rw, {', '.join(f'0.0::DOUBLE AS {p}' for p in PARTS[1:6])}, CASE WHEN label = 9 THEN -0.25::DOUBLE ELSE 0.0 END AS dy,
  CASE WHEN label = 9 THEN 0.25::DOUBLE ELSE 0.0 END AS dz FROM embeddings)"""


@query("bld6_blend_to_mesh", f"""WITH {t.points_sql()}, {_SRC}, {edges_sql('points', 'idx', False, 0, nodes='src').replace(f'{t.RADIUS ** 2}::DOUBLE', '0.25::DOUBLE')},
{q.sums_cte(nodes='src')}, wo AS (SELECT b.qid, {', '.join(f"b.{p} + CASE WHEN s.label = 9 THEN s.{p} ELSE 0 END AS {p}" for p in PARTS)}
FROM bs b LEFT JOIN src s ON s.node_id = b.qid), {q.unit_cte('wo', 'bu')}
SELECT idx AS obs_id, {', '.join(f'{t.r6(c)} AS {a}' for c, a in zip(_POS, 'xyz'))} FROM points JOIN bu ON bu.qid = idx""")
def bld6(spark, sf):
    labels = t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("obs_id"), "label")
    src = _obs(spark, sf).join(labels, "obs_id")
    moved = F.col("label") == 9
    vals = {"rw": F.lit(1.0), "dy": F.when(moved, -0.25).otherwise(0.0), "dz": F.when(moved, 0.25).otherwise(0.0)}
    tr = src.select("obs_id", *[vals.get(p, F.lit(0.0)).alias(p) for p in PARTS])
    out = blend.blend_to_mesh(_obs(spark, sf), src, tr)
    return out.select("obs_id", *[clean(F.col(a)).alias(a) for a in "xyz"])
