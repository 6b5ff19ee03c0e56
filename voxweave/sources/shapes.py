"""Generated meshes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uv_sphere(spark: SparkSession, radius: float, divisions: int) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with ``divisions`` bands and slices; poles are single vertices."""
    n = divisions
    ring = spark.range((n - 1) * n).select((F.col("id") + 1).alias("vid"), (F.expr(f"id div {n}") + 1).alias("i"), (F.col("id") % n).alias("j"))
    a, b = F.col("i") * math.pi / n, F.col("j") * 2 * math.pi / n
    body = ring.select("vid", (radius * F.sin(a) * F.cos(b)).alias("x"), (radius * F.cos(a)).alias("y"), (radius * F.sin(a) * F.sin(b)).alias("z"))
    last = (n - 1) * n + 1
    poles = spark.range(2).select((F.col("id") * last).alias("vid"), F.lit(0.0).alias("x"),
                                  F.when(F.col("id") == 0, radius).otherwise(-radius).alias("y"), F.lit(0.0).alias("z"))
    q = spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"))

    def at(i, j):
        inner = (i - 1) * n + j % n + 1
        return F.when(i == 0, F.lit(0)).when(i == n, F.lit(last)).otherwise(inner).cast("long")
    i, j = F.col("i"), F.col("j")
    p = q.select("i", "j", at(i, j).alias("a"), at(i, j + 1).alias("b"), at(i + 1, j).alias("c"), at(i + 1, j + 1).alias("d"))
    tri = p.select(F.inline(F.array(F.struct((i * n + j).alias("q"), F.lit(0).alias("k"), F.col("a").alias("v0"), F.col("b").alias("v1"), F.col("d").alias("v2")),
                                    F.struct((i * n + j).alias("q"), F.lit(1).alias("k"), F.col("a").alias("v0"), F.col("d").alias("v1"), F.col("c").alias("v2")))))
    faces = tri.filter("v0 <> v1 and v1 <> v2 and v0 <> v2")
    return body.unionByName(poles), faces.select((F.col("q") * 2 + F.col("k")).alias("fid"), "v0", "v1", "v2")
