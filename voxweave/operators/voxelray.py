"""Sphere tracing of a voxel map from one camera: rendered depth and colour.

A ray's next step depends on the map value at its present position, so one ray is a sequential
walk. Rays are grouped by image tile and each tile receives just the voxels whose neighbourhood
projects onto it; that set is bounded by the tile's view volume and the maximum depth, however
large the map is. Spark does the culling, the tile assignment and the shuffle; a task walks the
rays of a tile together in NumPy.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Sensor, Tsdf
from ..functions import camera
from ..functions.vec import V3, div
from ..runtime import computed
from .pixels import joined_pose
from .voxels import G

TILE = 16
POSE = [f"m{i}{j}" for i in range(3) for j in range(4)]


def _tiles_across(s: Sensor) -> int:
    return -(-s.cols // TILE)


def _voxels_by_tile(voxels: DataFrame, views: DataFrame, s: Sensor, cfg: Tsdf) -> DataFrame:
    """(view, tile, voxel) for each tile of a view one of whose rays can read the voxel."""
    h = cfg.voxel_size
    margin = 1.5 * h * math.sqrt(3)
    pose = joined_pose()
    df = voxels.join(views.select("view", *POSE), "view")
    seen = pose.rotation().T.apply(V3.of("g") * F.lit(h) - pose.translation())
    df = computed(df, seen.as_map("_c"), ["view", *G, "sdf", "weight", "r", "g", "b"])
    c = V3.of("_c")
    near, far = c.z - margin, c.z + margin
    df = df.filter((far > 0) & (near <= cfg.max_depth))
    # Widest slope of a ray per axis; a voxel beside the view volume is dropped here.
    sx = max(s.cx + 1, s.cols - s.cx) / s.fx
    sy = max(s.cy + 1, s.rows - s.cy) / s.fy
    df = df.filter((F.abs(c.x) - margin <= far * sx) & (F.abs(c.y) - margin <= far * sy))

    def span(a, f, centre, n):
        """First and last pixel whose ray can come within the margin along one axis."""
        def px(num, den):
            return div(num * F.lit(f), den) + F.lit(centre)
        lo = F.least(px(a - margin, near), px(a - margin, far))
        hi = F.greatest(px(a + margin, near), px(a + margin, far))
        whole = near <= 1e-9
        lo = F.when(whole, 0).otherwise(F.greatest(F.floor(lo), F.lit(0)))
        hi = F.when(whole, n - 1).otherwise(F.least(F.ceil(hi), F.lit(n - 1)))
        return F.floor(lo / TILE), F.floor(hi / TILE)
    x0, x1 = span(c.x, s.fx, s.cx, s.cols)
    y0, y1 = span(c.y, s.fy, s.cy, s.rows)
    df = computed(df, {"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1}, ["view", *G, "sdf", "weight", "r", "g", "b"])
    df = df.filter("_x0 <= _x1 and _y0 <= _y1")
    df = df.withColumn("_ty", F.explode(F.sequence("_y0", "_y1")))
    df = df.withColumn("_tx", F.explode(F.sequence("_x0", "_x1")))
    return df.select("view", (F.col("_ty") * _tiles_across(s) + F.col("_tx")).alias("tile"), *G, "sdf",
                     "weight", "r", "g", "b")


def _columns(rows: pa.Table, names: list[str], kind) -> np.ndarray:
    return np.stack([np.asarray(rows[c].to_numpy(), kind) for c in names], axis=1)


class _Field:
    """Trilinear reads of one tile's voxels."""

    corners = np.array([(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)])

    def __init__(self, vox: pa.Table, h: float):
        self.h = h
        g = _columns(vox, G, np.int64)
        self.lo = g.min(axis=0) - 2 if len(g) else np.zeros(3, np.int64)
        self.n = (g.max(axis=0) + 3 - self.lo) if len(g) else np.ones(3, np.int64)
        key = self._key(g)
        order = np.argsort(key)
        self.key = key[order]
        self.val = _columns(vox, ["sdf", "weight", "r", "g", "b"], float)[order]

    def _key(self, g):
        d = g - self.lo
        ok = ((d >= 0) & (d < self.n)).all(axis=1)
        return np.where(ok, (d[:, 0] * self.n[1] + d[:, 1]) * self.n[2] + d[:, 2], -1)

    def read(self, p):
        x = p / self.h
        k = self._key((np.floor(np.abs(x) + 0.5) * np.sign(x)).astype(np.int64))
        at = np.searchsorted(self.key, k)
        hit = (at < len(self.key)) & (k >= 0)
        hit[hit] = self.key[at[hit]] == k[hit]
        out = np.zeros((len(p), 5))
        out[hit] = self.val[at[hit]]
        return out

    def sample(self, p):
        """(sdf, weight, r, g, b) at each point. The point and its corners are looked up in one go."""
        f = p / self.h - np.floor(p / self.h)
        centre, *near = self.read(np.concatenate([p, *[p + (o - 0.5) * self.h for o in self.corners]])).reshape(9, len(p), 5)
        acc = np.zeros((len(p), 5))
        for o, v in zip(self.corners, near):
            w = np.prod(np.where(o == 1, f, 1 - f), axis=1)
            acc += w[:, None] * np.where(v[:, 1:2] == 0, centre, v)
        acc[:, 1] = centre[:, 1]
        acc[centre[:, 1] == 0] = 0.0
        return acc


def render_views(voxels: DataFrame, views: DataFrame, s: Sensor, cfg: Tsdf) -> DataFrame:
    """view, idx, depth and r, g, b per pixel of each view (view, m00..m23) of its own map, the voxels with its ``view``.
    Step by the truncation in unseen space, else by the sdf; stop at an observed value below the voxel size. A ray that
    leaves the depth range keeps the depth it reached and is black."""
    across, down = _tiles_across(s), -(-s.rows // TILE)
    tiles = views.select("view", *POSE, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across * down - 1).cast("long"))).alias("tile"))

    schema = pa.schema([("view", pa.int64()), ("idx", pa.int64()), ("depth", pa.float64()), *[(c, pa.int64()) for c in "rgb"]])

    def walk(key, tile: pa.Table, vox: pa.Table) -> pa.Table:
        if not len(tile):
            return schema.empty_table()
        field = _Field(vox, cfg.voxel_size)
        pose = _columns(tile, POSE, float)[0].reshape(3, 4)
        at_tile = tile["tile"][0].as_py()
        v, u = (x.ravel() for x in np.mgrid[at_tile // across * TILE:min((at_tile // across + 1) * TILE, s.rows),
                                            at_tile % across * TILE:min((at_tile % across + 1) * TILE, s.cols)])
        idx = v * s.cols + u

        def at(d, m):
            cam = np.stack([(u[m] - s.cx) * d[m] / s.fx, (v[m] - s.cy) * d[m] / s.fy, d[m]], axis=1)
            return cam @ pose[:, :3].T + pose[:, 3]
        d = np.zeros(len(idx))
        live = np.arange(len(idx))
        while len(live):
            val = field.sample(at(d, live))
            seen = val[:, 1] != 0
            d[live] += np.where(seen, val[:, 0], cfg.truncation)
            live = live[~(seen & (val[:, 0] < cfg.voxel_size)) & (d[live] < cfg.max_depth)]
        rgb = np.zeros((len(idx), 3), dtype=np.int64)
        hit = np.flatnonzero(d < cfg.max_depth)
        if len(hit):
            rgb[hit] = np.floor(np.round(field.sample(at(d, hit))[:, 2:], 9)).astype(np.int64)
        return pa.table([pa.array([tile["view"][0].as_py()] * len(idx), pa.int64()), pa.array(idx), pa.array(d), *[pa.array(rgb[:, k]) for k in range(3)]], schema)

    parts = _voxels_by_tile(voxels, views, s, cfg)
    return tiles.groupBy("view", "tile").cogroup(parts.groupBy("view", "tile")).applyInArrow(
        walk, "view long, idx long, depth double, r long, g long, b long")


def render(voxels: DataFrame, pose, s: Sensor, cfg: Tsdf) -> DataFrame:
    """idx, depth and r, g, b per pixel of one view, as :func:`render_views`."""
    row = [(0, *map(float, np.asarray(pose, dtype=float)[:3].reshape(12)))]
    view = voxels.sparkSession.createDataFrame(row, "view long, " + ", ".join(f"{c} double" for c in POSE))
    return render_views(voxels.withColumn("view", F.lit(0).cast("long")), view, s, cfg).drop("view")


def generate_depth(voxels: DataFrame, pose, s: Sensor, cfg: Tsdf) -> DataFrame:
    return render(voxels, pose, s, cfg).select("idx", "depth")


def generate_rgb(voxels: DataFrame, pose, s: Sensor, cfg: Tsdf) -> DataFrame:
    return render(voxels, pose, s, cfg).select("idx", "r", "g", "b")
