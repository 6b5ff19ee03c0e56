"""Source and sink queries (SRC, SNK): the readers and writers' row logic on table text."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.vec import clean
from ..operators import graph, knn, mesh
from ..runtime import ensure_checkpoint_dir
from ..sinks import images, text
from ..sources import frames, obj
from . import tables as t
from .image import PIX, normals, normals_sql
from .neighbours import BASE, CFG, edges_sql
from .registry import query
from .surface import FACE_POS


@query("src1_frame_index", """WITH p AS (SELECT 'rgb/' || printf('%.3f', value) || printf('%06d', event_id) || '.png' AS path,
  (printf('%.3f', value) || printf('%06d', event_id))::DOUBLE AS ts FROM events)
SELECT row_number() OVER (ORDER BY ts, path) - 1 AS frame_id, path, ts FROM p""")
def src1(spark, sf):
    e = t.read(spark, sf, "events")
    path = F.format_string("rgb/%.3f%06d.png", F.col("value") + F.lit(0.0), "event_id")
    return frames.frame_index(e.select(path.alias("path")))


_LINE = "CASE WHEN event_id % 9 = 0 THEN '# ' || event_id ELSE event_id || ' depth/' || user_id || '  rgb' || event_id || ' x' END"


def _lines(spark, sf):
    e = t.read(spark, sf, "events")
    line = F.when(F.col("event_id") % 9 == 0, F.format_string("# %d", "event_id")).otherwise(
        F.format_string("%d depth/%d  rgb%d x", "event_id", "user_id", "event_id"))
    return e.select(F.col("event_id").alias("line"), line.alias("value"))


@query("src2_associations", f"SELECT event_id AS line, event_id || '' AS depth, 'rgb' || event_id AS rgb FROM events WHERE event_id % 9 <> 0")
def src2(spark, sf):
    return frames.associations(_lines(spark, sf))


def _truth(spark, sf):
    e = t.read(spark, sf, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(7)]
    line = F.when(F.col("vec_id") % 7 == 0, F.lit("# comment")).when(F.col("vec_id") % 11 == 0, F.lit("  ")).otherwise(
        F.format_string("%d.5 " + " ".join(["%.6f"] * 7), "vec_id", *[F.round(c, 6) for c in v]))
    return frames.ground_truth(e.select(F.col("vec_id").alias("line"), line.alias("value")))


_NAMES = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
_TRUTH = f"""gt AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS line, vec_id + 0.5::DOUBLE AS ts, {', '.join(t.r6(f'embedding[{i}]::DOUBLE') + f' AS {n}' for i, n in enumerate(_NAMES, 1))}
  FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0)"""


@query("src3_ground_truth", f"WITH {_TRUTH} SELECT * FROM gt")
def src3(spark, sf):
    return _truth(spark, sf).select("line", "ts", *[clean(F.col(n)).alias(n) for n in _NAMES])


@query("src4_pair_by_position", f"WITH {_TRUTH} SELECT vec_id AS frame_id, tx, qw FROM embeddings JOIN gt ON gt.line = vec_id + 5")
def src4(spark, sf):
    f = t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"))
    j = frames.pair_by_position(f, _truth(spark, sf), 5)
    return j.select("frame_id", clean(F.col("tx")).alias("tx"), clean(F.col("qw")).alias("qw"))


@query("src5_png_round_trip", f"WITH {PIX} SELECT frame_id, idx, {t.r6('floor(depth * 5000 + 0.5) / 5000')} AS depth, r, g, b FROM pixels")
def src5(spark, sf):
    """Frames written as PNG images and decoded again."""
    s = t.BIG
    png = images.png_images(t.pixels(spark, sf), s)
    full = t.pixels(spark, sf).select("frame_id", "idx")

    def decode(batches):
        for b in batches:
            for fid, d, c in zip(b["frame_id"], b["depth_png"], b["rgb_png"]):
                depth, rgb = frames.decode_png(bytes(d)).reshape(-1), frames.decode_png(bytes(c)).reshape(-1, 3).astype(np.int64)
                yield pd.DataFrame({"frame_id": fid, "idx": np.arange(len(depth)), "depth": depth / s.depth_scale,
                                    "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})
    back = png.mapInPandas(decode, "frame_id long, idx long, depth double, r long, g long, b long")
    return full.join(back, ["frame_id", "idx"]).withColumn("depth", clean(F.col("depth")))


@query("src6_frame_folder", f"""WITH {PIX}, o AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id DESC) - 1 AS n FROM (SELECT DISTINCT frame_id FROM pixels)),
i AS (SELECT n, k FROM o, range({t.BIG.rows * t.BIG.cols}) r(k))
SELECT n AS frame_id, k AS idx, {t.r6('floor(coalesce(depth, 0) * 5000 + 0.5) / 5000')} AS depth, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b
FROM i JOIN o USING (n) LEFT JOIN pixels p ON p.frame_id = o.frame_id AND p.idx = k""")
def src6(spark, sf):
    """Frames written as a folder of filtered PNG files, the last one first in time; listed, paired and decoded."""
    root = os.path.join(ensure_checkpoint_dir(spark), f"frames-{uuid.uuid4().hex}")
    images.write_folder(t.pixels(spark, sf).withColumn("ts", 1e6 - F.col("frame_id") / 30.0), root, t.BIG, (1, 2, 3, 4, 0))
    back = frames.read_folder(spark, root, t.BIG)
    return back.select("frame_id", "idx", clean(F.col("depth")).alias("depth"), "r", "g", "b")


def _obj(spark, sf):
    """The point mesh as OBJ text, numbered across its three sections."""
    lines = text.obj_lines(t.vertices(spark, sf), t.triangles(spark, sf))
    return obj.parse(lines.select("section", "ord", F.col("line").alias("value")), ["section", "ord"])


_M = f"{t.points_sql()}, {t.vertices_sql()}, {t.triangles_sql()}"


@query("src7_obj_vertices", f"WITH {_M} SELECT vid, {', '.join(f'{t.r6(a)} AS {a}' for a in 'xyz')} FROM vertices")
def src7_vertices(spark, sf):
    return _obj(spark, sf)["vertices"].select("vid", *[clean(F.col(a)).alias(a) for a in "xyz"])


@query("src7_obj_faces", f"WITH {_M} SELECT row_number() OVER (ORDER BY fid) - 1 AS fid, v0, v1, v2 FROM faces")
def src7_faces(spark, sf):
    return _obj(spark, sf)["faces"].select("fid", "v0", "v1", "v2")


def _fmt(*cols):
    return " || ' ' || ".join(f"printf('%.6f', round({c}, 6))" for c in cols)


def _rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


@query("snk1_soup_obj", f"""WITH {_M}, {FACE_POS} SELECT 0 AS section, fid * 3 + k AS ord, 'v ' || CASE k WHEN 0 THEN {_fmt('p0x', 'p0y', 'p0z')}
  WHEN 1 THEN {_fmt('p1x', 'p1y', 'p1z')} ELSE {_fmt('p2x', 'p2y', 'p2z')} END AS line FROM fp, range(3) g(k)
UNION ALL SELECT 2, fid, 'f ' || (fid * 3 + 1) || ' ' || (fid * 3 + 2) || ' ' || (fid * 3 + 3) FROM fp""")
def snk1(spark, sf):
    v, f = mesh.soup(mesh.face_positions(t.triangles(spark, sf), t.vertices(spark, sf)))
    return text.obj_lines(_rounded(v, "x", "y", "z"), f)


@query("snk2_indexed_obj", f"""WITH {_M} SELECT 0 AS section, vid AS ord, 'v ' || {_fmt('x', 'y', 'z')} AS line FROM vertices
UNION ALL SELECT 1, vid, 'vn ' || {_fmt('z', 'x', 'y')} FROM vertices
UNION ALL SELECT 2, fid, 'f ' || concat_ws(' ', (v0+1) || '//' || (v0+1), (v1+1) || '//' || (v1+1), (v2+1) || '//' || (v2+1)) FROM faces""")
def snk2(spark, sf):
    v = _rounded(t.vertices(spark, sf), "x", "y", "z")
    n = v.select("vid", F.col("z").alias("nx"), F.col("x").alias("ny"), F.col("y").alias("nz"))
    return text.obj_lines(v, t.triangles(spark, sf), n)


@query("snk4_trajectory", f"""WITH {t.poses_sql()} SELECT 0 AS section, frame_id AS ord, printf('%.6f', frame_id / 10.0::DOUBLE) || ' ' || {_fmt('tx', 'ty', 'tz', 'qx', 'qy', 'qz', 'qw')} AS line FROM poses""")
def snk4(spark, sf):
    p = _rounded(t.poses(spark, sf), "tx", "ty", "tz", "qx", "qy", "qz", "qw")
    return text.trajectory_lines(p.withColumn("ts", F.col("frame_id") / 10.0))


@query("snk5_normals", f"""WITH {PIX}, {normals_sql()} SELECT 0 AS section, idx AS ord, idx || ' ' || {_fmt('x', 'y', 'z', 'nx', 'ny', 'nz')} AS line FROM normals WHERE nx IS NOT NULL""")
def snk5(spark, sf):
    n = normals(spark, sf).filter("nx is not null")
    return text.normal_lines(n.withColumns({c: clean(F.col(c)) for c in ("x", "y", "z", "nx", "ny", "nz")}))


def _coo(spark, sf):
    e = t.read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("i"), F.posexplode(F.slice("embedding", 1, 6)).alias("j", "val")).select(
        "i", F.col("j").cast("long").alias("j"), F.round(F.col("val").cast("double"), 6).alias("val"))


@query("snk6_matrix_rows", f"SELECT 0 AS section, vec_id AS ord, {_fmt(*[f'embedding[{i}]::DOUBLE' for i in range(1, 7)])} AS line FROM embeddings")
def snk6(spark, sf):
    return text.matrix_lines(_coo(spark, sf))


_NE = edges_sql("nodes", "node_id", True, 1e-4, name="ne")


@query("snk7_graph", f"""WITH {BASE}, {_NE}, nb AS (SELECT qid, string_agg(node_id || ':' || printf('%.6f', round(dist, 6)) || ':' || printf('%.6f', round(weight, 6)), ' ' ORDER BY rank) AS nb FROM ne GROUP BY qid)
SELECT 0 AS section, n.node_id AS ord, n.node_id || ' ' || {_fmt('x', 'y', 'z')} || ' ' || nb AS line FROM nodes n JOIN nb ON nb.qid = n.node_id""")
def snk7(spark, sf):
    n = t.nodes(spark, sf)
    e = knn.node_edges(n, CFG).withColumns({c: F.round(c, 6) for c in ("dist", "weight")})
    return text.graph_lines(graph.describe(_rounded(n, "x", "y", "z"), e))


@query("snk9_image_arrays", f"""WITH {PIX}, s AS (SELECT frame_id, idx, b AS r FROM pixels)
SELECT frame_id, count(*) AS n, sum(r * (idx % 7))::BIGINT AS check_sum, min_by(r, idx) AS first_r FROM s GROUP BY frame_id""")
def snk9(spark, sf):
    """Colour arrays with red and blue swapped, reduced to a position-dependent sum."""
    a = images.image_arrays(images.swap_red_blue(t.pixels(spark, sf)), "r")
    total = F.aggregate(F.transform("r", lambda x, i: x * (i % 7)), F.lit(0).cast("long"), lambda s, x: s + x)
    return a.select("frame_id", F.size("r").cast("long").alias("n"), total.alias("check_sum"), F.get("r", F.lit(0)).alias("first_r"))


@query("snk10_numbers", f"SELECT 0 AS section, event_id AS ord, printf('%.6f', value + 0.0) AS line FROM events")
def snk10(spark, sf):
    e = t.read(spark, sf, "events").withColumn("value", F.col("value") + F.lit(0.0))
    return text.number_lines(e, "event_id", "value")
