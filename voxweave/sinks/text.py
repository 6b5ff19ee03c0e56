"""Text sinks. Lines carry their order and are written range-sorted: the part files, read in
name order, are the file. Nothing is gathered into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (section, ord, line) rows."""
    lines.sort("section", "ord").select("line").write.mode(mode).text(path)


def _lines(df: DataFrame, section: int, order, fmt: str, *cols) -> DataFrame:
    return df.select(F.lit(section).alias("section"), order.cast("long").alias("ord"),
                     F.format_string(fmt, *cols).alias("line"))


def obj_lines(vertices: DataFrame, faces: DataFrame, normals: DataFrame | None = None) -> DataFrame:
    """v (with colour where present), vn and f lines. Vertex ids must be dense from 0; file
    indexes are 1-based. With normals the faces read a//n."""
    colour = [c for c in ("r", "g", "b") if c in vertices.columns]
    cols = ["x", "y", "z", *colour]
    out = _lines(vertices, 0, F.col("vid"), "v " + " ".join(["%.6f"] * len(cols)), *cols)
    if normals is not None:
        out = out.unionByName(_lines(normals, 1, F.col("vid"), "vn %.6f %.6f %.6f", "nx", "ny", "nz"))
    idx = [F.col(f"v{k}") + 1 for k in range(3)]
    if normals is None:
        return out.unionByName(_lines(faces, 2, F.col("fid"), "f %d %d %d", *idx))
    twice = [c for i in idx for c in (i, i)]
    return out.unionByName(_lines(faces, 2, F.col("fid"), "f %d//%d %d//%d %d//%d", *twice))


def trajectory_lines(poses: DataFrame) -> DataFrame:
    """ts tx ty tz qx qy qz qw per pose (frame_id, ts, ...)."""
    return _lines(poses, 0, F.col("frame_id"), " ".join(["%.6f"] * 8), "ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw")


def append_trajectory(poses: DataFrame, path: str) -> None:
    write_lines(trajectory_lines(poses), path, "append")


def normal_lines(points: DataFrame) -> DataFrame:
    """idx px py pz nx ny nz."""
    return _lines(points, 0, F.col("idx"), "%d " + " ".join(["%.6f"] * 6), F.col("idx"), "x", "y", "z", "nx", "ny", "nz")


def number_lines(df: DataFrame, order: str, value: str) -> DataFrame:
    return _lines(df, 0, F.col(order), "%.6f", F.col(value))


def matrix_lines(matrix: DataFrame, first: int | None = None, last: int | None = None,
                 by_column: bool = False) -> DataFrame:
    """One line per row (or column) of (i, j, val), rows first..last only; a line lists its
    entries in index order."""
    a, b = ("j", "i") if by_column else ("i", "j")
    if first is not None:
        matrix = matrix.filter(F.col("i").between(first, last))
    g = matrix.groupBy(a).agg(F.array_sort(F.collect_list(F.struct(b, "val"))).alias("_e"))
    text = F.array_join(F.transform("_e", lambda e: F.format_string("%.6f", e["val"])), " ")
    return g.select(F.lit(0).alias("section"), F.col(a).alias("ord"), text.alias("line"))


def graph_lines(described: DataFrame) -> DataFrame:
    """Lines of ``graph.describe``."""
    return described.select(F.lit(0).alias("section"), F.col("node_id").alias("ord"), "line")
