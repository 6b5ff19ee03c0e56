"""Mesh operators over vertices(vid, x, y, z, ...) and faces(fid, v0, v1, v2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import V3
from ..runtime import with_running


def corners(faces: DataFrame) -> DataFrame:
    """One row (fid, k, vid) per face corner."""
    return faces.select("fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid"))


def regroup(df: DataFrame, values: dict[str, str], keys: str | list[str] = "fid") -> DataFrame:
    """Back to one row per face: column ``values[c].format(k)`` from value c of corner k."""
    aggs = [F.max(F.when(F.col("k") == k, F.col(c))).alias(name.format(k=k))
            for c, name in values.items() for k in range(3)]
    return df.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(*aggs)


def face_positions(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid and p0x..p2z: one join over the exploded corners in place of three."""
    j = corners(faces).join(vertices.select("vid", "x", "y", "z"), "vid")
    return regroup(j, {a: "p{k}" + a for a in "xyz"})


def remap(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace vertex ids by ``mapping`` (vid, to)."""
    return regroup(corners(faces).join(mapping, "vid"), {"to": "v{k}"})


def soup(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of triangles (fid, p0x..p2z [, r, g, b]): corner k of face f is vertex 3f+k."""
    colour = [c for c in ("r", "g", "b") if c in triangles.columns]
    v = triangles.select("fid", *colour, F.posexplode(F.array(
        *[V3.of(f"p{k}").struct() for k in range(3)])).alias("k", "p"))
    vertices = v.select((F.col("fid") * 3 + F.col("k")).alias("vid"), "p.*", *colour)
    faces = triangles.select("fid", *[(F.col("fid") * 3 + k).alias(f"v{k}") for k in range(3)])
    return vertices, faces


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def first_equal(vertices: DataFrame) -> DataFrame:
    """(vid, to): the lowest id at exactly the same position. A grouping and a join, so that a
    position shared by very many vertices is combined map-side."""
    at = ["x", "y", "z"]
    low = vertices.groupBy(*at).agg(F.min("vid").alias("to"))
    return vertices.select("vid", *at).join(low, at).select("vid", "to")


def reindex(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces that point at the first equal vertex; the vertices stay as they are."""
    return remap(faces, first_equal(vertices))


def compress(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop duplicate positions, renumber the rest 0.. by first occurrence, re-index faces."""
    at = ["x", "y", "z"]
    extra = [c for c in vertices.columns if c not in ("vid", *at)]
    low = vertices.groupBy(*at).agg(F.min("vid").alias("old"), *[F.min_by(c, "vid").alias(c) for c in extra])
    kept = with_running(low, ["old"], ordinal="vid")
    mapping = vertices.select(F.col("vid").alias("src"), *at).join(
        kept.select(*at, F.col("vid").alias("to")), at).select(F.col("src").alias("vid"), "to")
    return kept.select("vid", *at, *extra), remap(faces, mapping)


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): unit sum of the unnormalised normals of the faces around a vertex."""
    p = face_positions(faces, vertices)
    a, b, c = (V3.of(f"p{k}") for k in range(3))
    n = p.select("fid", *(b - a).cross(c - a).named("n"))
    per = corners(faces).join(n, "fid").groupBy("vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    return per.select("vid", *V3.of("n").normalize().named("n"))


def face_normals(faces: DataFrame, normals: DataFrame) -> DataFrame:
    """(fid, nx, ny, nz): unit sum of the three vertex normals."""
    j = corners(faces).join(normals, "vid").groupBy("fid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    return j.select("fid", *V3.of("n").normalize().named("n"))


def normal_indices(faces: DataFrame) -> DataFrame:
    return faces.withColumns({f"n{k}": F.col(f"v{k}") for k in range(3)})


def info(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(what, n) for vertices and faces."""
    def n(df, what):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(vertices, "vertices").unionByName(n(faces, "faces"))


def boundary(vertices: DataFrame) -> DataFrame:
    """One row: means, bounds and the largest extent."""
    b = vertices.agg(*[f(a).alias(f"{n}_{a}") for a in "xyz"
                       for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    return b.withColumn("scale", F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"]))


def normalize_pose(vertices: DataFrame) -> DataFrame:
    """Centre on the mean, scale to unit extent, push back by two."""
    b = boundary(vertices).first()
    out = {a: F.try_divide(F.col(a) - F.lit(b[f"mean_{a}"]), F.lit(b["scale"])) for a in "xyz"}
    out["z"] = out["z"] - 2.0
    return vertices.withColumns(out)
