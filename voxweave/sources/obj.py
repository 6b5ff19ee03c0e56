"""Wavefront OBJ meshes as vertex and face tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import with_running
from .frames import ordered_lines
from .text import numbers, words


def parse(lines: DataFrame, order: list[str] = ["line"]) -> dict[str, DataFrame]:
    """vertices (vid, x, y, z[, r, g, b]), normals (nid, nx, ny, nz), texcoords (tid, s, t) and
    faces (fid, v0..v2, t0..t2, n0..n2) of rows (value and the columns of ``order``). Ids are
    0-based; the position of a vertex among the v lines is a running count, so no line passes
    through one task. A face of more corners becomes a fan of triangles around its first."""
    tag = F.get(words(F.col("value")), 0)
    counts = {f"_{k}": F.when(tag == k, 1).otherwise(0) for k in ("v", "vn", "vt")}
    triangles = F.greatest(F.size(words(F.trim("value"))) - 3, F.lit(0))
    counts["_f"] = F.when(tag == "f", triangles).otherwise(0)
    df = with_running(lines.withColumn("tag", tag).filter(F.col("tag").isin("v", "vn", "vt", "f")), order, sums=counts)
    df = df.withColumn("rest", F.regexp_replace(F.trim("value"), r"^\S+\s+", ""))
    n = numbers(F.col("rest"))

    def rows(kind, ident, names):
        return df.filter(F.col("tag") == kind).select((F.col(f"_{kind}") - 1).alias(ident),
                                                      *[F.get(n, i).alias(c) for i, c in enumerate(names)])
    w = words(F.col("rest"))

    def part(k, at):
        text = F.get(F.split(F.get(w, k), "/"), at)
        return (F.when(F.length(text) > 0, text.cast("long")) - 1)
    fans = df.filter("tag = 'f'").withColumn("_n", F.size(w) - 2).filter("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    corner = [F.lit(0), F.col("_k") + 1, F.col("_k") + 2]
    faces = fans.select((F.col("_f") - F.col("_n") + F.col("_k")).alias("fid"),
                        *[part(corner[k], at).alias(f"{p}{k}") for at, p in enumerate("vtn") for k in range(3)])
    return {"vertices": rows("v", "vid", ("x", "y", "z", "r", "g", "b")), "normals": rows("vn", "nid", ("nx", "ny", "nz")),
            "texcoords": rows("vt", "tid", ("s", "t")), "faces": faces}


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if not path.lower().endswith(".obj"):
        raise ValueError(f"unsupported mesh format: {path}")
    return parse(ordered_lines(spark, path))
