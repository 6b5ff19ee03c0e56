"""Projections of the given tables onto the engine's schemas, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Sensor, Tsdf

BIG = Sensor(rows=100, cols=100, fx=82.03125, fy=82.03125, cx=49.5, cy=49.5)
SMALL = Sensor(rows=32, cols=32, fx=26.25, fy=26.25, cx=15.5, cy=15.5)
COARSE = Tsdf(voxel_size=0.05, block_size=8, truncation=0.15)
RADIUS = 0.25


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pixels(spark: SparkSession, sf: str, s: Sensor = BIG) -> DataFrame:
    """events as consecutive depth frames of the sensor's size."""
    return frames_of(read(spark, sf, "events"), s)


def frames_of(e: DataFrame, s: Sensor) -> DataFrame:
    n = s.rows * s.cols
    return e.select(
        F.expr(f"event_id div {n}").alias("frame_id"),
        (F.col("event_id") % n).alias("idx"),
        (F.col("event_id") % n % s.cols).alias("u"),
        F.expr(f"event_id % {n} div {s.cols}").alias("v"),
        (F.lit(0.1) + F.col("value") / 200.0).alias("depth"),
        (F.col("user_id") % 256).alias("r"),
        (F.col("event_id") * 7 % 256).alias("g"),
        (F.col("event_id") * 13 % 256).alias("b"))


def pixels_sql(s: Sensor = BIG, name: str = "pixels") -> str:
    n = s.rows * s.cols
    return f"""{name} AS (SELECT event_id // {n} AS frame_id, event_id % {n} AS idx,
      event_id % {n} % {s.cols} AS u, event_id % {n} // {s.cols} AS v,
      0.1::DOUBLE + value / 200.0::DOUBLE AS depth, user_id % 256 AS r,
      event_id * 7 % 256 AS g, event_id * 13 % 256 AS b FROM events)"""


def xyz_sql(s: Sensor, d: str = "depth", u: str = "u", v: str = "v") -> tuple[str, str, str]:
    return (f"(({u} - {s.cx}::DOUBLE) * {d} / {s.fx}::DOUBLE)",
            f"(({v} - {s.cy}::DOUBLE) * {d} / {s.fy}::DOUBLE)", d)


def _dim(i: int):
    return F.col("embedding")[i].cast("double")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"), _dim(0).alias("x"), _dim(1).alias("y"), _dim(2).alias("z"))


def points_sql(name: str = "points") -> str:
    return f"""{name} AS (SELECT vec_id AS idx, embedding[1]::DOUBLE AS x,
      embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every point is a node; those of label 0 are moved by (0, -0.5, 0.5)."""
    moved = F.col("label") == 0

    def part(v):
        return F.when(moved, F.lit(v)).otherwise(F.lit(0.0))
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("node_id"), F.col("vec_id").alias("vertex_id"),
        _dim(0).alias("x"), _dim(1).alias("y"), _dim(2).alias("z"),
        F.lit(1.0).alias("rw"), F.lit(0.0).alias("rx"), F.lit(0.0).alias("ry"),
        F.lit(0.0).alias("rz"), F.lit(0.0).alias("dw"), F.lit(0.0).alias("dx"),
        part(-0.25).alias("dy"), part(0.25).alias("dz"))


def nodes_sql(name: str = "nodes") -> str:
    return f"""{name} AS (SELECT vec_id AS node_id, vec_id AS vertex_id, embedding[1]::DOUBLE AS x,
      embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 1.0::DOUBLE AS rw,
      0.0::DOUBLE AS rx, 0.0::DOUBLE AS ry, 0.0::DOUBLE AS rz, 0.0::DOUBLE AS dw,
      0.0::DOUBLE AS dx, CASE WHEN label = 0 THEN -0.25::DOUBLE ELSE 0.0::DOUBLE END AS dy,
      CASE WHEN label = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS dz
      FROM embeddings)"""


def poses(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    q = [_dim(i) for i in (6, 7, 8, 9)]
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return e.select(F.col("vec_id").alias("frame_id"), _dim(3).alias("tx"), _dim(4).alias("ty"),
                    _dim(5).alias("tz"), *[(c / F.nullif(n, F.lit(0.0))).alias(f"q{a}")
                                           for a, c in zip("xyzw", q)])


def poses_sql(name: str = "poses") -> str:
    raw = ", ".join(f"embedding[{i}]::DOUBLE AS e{i}" for i in range(4, 11))
    n = "sqrt(e7*e7 + e8*e8 + e9*e9 + e10*e10)"
    q = ", ".join(f"e{i} / {n} AS q{a}" for a, i in zip("xyzw", range(7, 11)))
    return f"""{name} AS (SELECT vec_id AS frame_id, e4 AS tx, e5 AS ty, e6 AS tz, {q}
      FROM (SELECT vec_id, {raw} FROM embeddings))"""


def pose_rows_sql(src: str = "poses", name: str = "pm") -> str:
    """m00..m23 of the unit-quaternion poses."""
    return f"""{name} AS (SELECT frame_id,
      1 - 2*(qy*qy + qz*qz) AS m00, 2*(qx*qy - qw*qz) AS m01, 2*(qx*qz + qw*qy) AS m02, tx AS m03,
      2*(qx*qy + qw*qz) AS m10, 1 - 2*(qx*qx + qz*qz) AS m11, 2*(qy*qz - qw*qx) AS m12, ty AS m13,
      2*(qx*qz - qw*qy) AS m20, 2*(qy*qz + qw*qx) AS m21, 1 - 2*(qx*qx + qy*qy) AS m22, tz AS m23
      FROM {src})"""


def triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Faces over consecutive point triples; incomplete triples are left out."""
    p = points(spark, sf)
    f = p.groupBy(F.expr("idx div 3").alias("fid")).agg(F.count(F.lit(1)).alias("n"))
    return f.filter("n = 3").select("fid", (F.col("fid") * 3).alias("v0"),
                                    (F.col("fid") * 3 + 1).alias("v1"),
                                    (F.col("fid") * 3 + 2).alias("v2"))


def triangles_sql(name: str = "faces") -> str:
    return f"""{name} AS (SELECT idx // 3 AS fid, (idx // 3) * 3 AS v0, (idx // 3) * 3 + 1 AS v1,
      (idx // 3) * 3 + 2 AS v2 FROM points GROUP BY 1, 2, 3, 4 HAVING count(*) = 3)"""


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).withColumnRenamed("idx", "vid")


def vertices_sql(name: str = "vertices") -> str:
    return f"{name} AS (SELECT idx AS vid, x, y, z FROM points)"


def lattice(spark: SparkSession, sf: str, side: int = 20) -> DataFrame:
    """events as a fully observed voxel column, side x side x any height."""
    e = read(spark, sf, "events")
    return e.select((F.col("event_id") % side).alias("gx"),
                    F.expr(f"event_id div {side} % {side}").alias("gy"),
                    F.expr(f"event_id div {side * side}").alias("gz"),
                    (F.col("value") / 97.0 - F.lit(0.5)).alias("sdf"), F.lit(1).alias("weight"),
                    (F.col("user_id") % 256).alias("r"), (F.col("event_id") * 7 % 256).alias("g"),
                    (F.col("event_id") * 13 % 256).alias("b"))


def lattice_sql(side: int = 20, name: str = "lattice") -> str:
    return f"""{name} AS (SELECT event_id % {side} AS gx, event_id // {side} % {side} AS gy,
      event_id // {side * side} AS gz, value / 97.0::DOUBLE - 0.5::DOUBLE AS sdf, 1 AS weight,
      user_id % 256 AS r, event_id * 7 % 256 AS g, event_id * 13 % 256 AS b FROM events)"""


def r6(expr: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0::DOUBLE"
