"""Sparse voxel map: keys, block allocation along rays, integration and merging.

A map is a table (gx, gy, gz, sdf, weight, r, g, b) of observed voxels; absence is a missing row.
A block is B^3 voxels. Everything is keyed by integer coordinates, so Spark's own hash
partitioning takes the place of a hash table and of slot management.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Sensor, Tsdf
from ..functions import camera
from ..functions.vec import V3, div, round_away
from ..runtime import computed, cut
from .pixels import joined_pose, pose_columns

MAP_SCHEMA = "gx long, gy long, gz long, sdf double, weight int, r long, g long, b long"
G = ["gx", "gy", "gz"]
BLOCK = ["bx", "by", "bz"]
CHUNK = 4096        # frames whose observations of one voxel may meet in one array


def empty_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAP_SCHEMA)


# -- keys --------------------------------------------------------------------------------
# Spatial hash primes and the value they act on are 32-bit signed; fixed values
HASH_PRIMES = (73856093, 19349669, 83492791)


def _wrap32(x: Column) -> Column:
    m = x.bitwiseAND(F.lit(4294967295))
    return m.bitwiseXOR(F.lit(2147483648)) - F.lit(2147483648)


def block_hash(x: Column, y: Column, z: Column, cfg: Tsdf) -> Column:
    """First slot of the bucket of a block; products and xor wrap to 32 bits."""
    parts = [_wrap32(c.cast("long") * F.lit(p)) for c, p in zip((x, y, z), HASH_PRIMES)]
    h = reduce(lambda a, b: a.bitwiseXOR(b), parts)
    return F.pmod(h, F.lit(cfg.buckets)) * cfg.bucket_size


def voxel_of(p: V3, cfg: Tsdf) -> V3:
    """Nearest voxel, halves away from zero."""
    return V3(*[round_away(c / F.lit(cfg.voxel_size)) for c in p])


def block_of(g: V3, cfg: Tsdf) -> V3:
    b = F.lit(cfg.block_size)
    return V3(*[((c - F.pmod(c, b)) / b).cast("long") for c in g])


def local_of(g: V3, cfg: Tsdf) -> V3:
    return V3(*[F.pmod(c, F.lit(cfg.block_size)) for c in g])


def local_index(local: V3, cfg: Tsdf) -> Column:
    n = cfg.block_size
    return local.x * (n * n) + local.y * n + local.z


def with_voxel_keys(df: DataFrame, p: V3, cfg: Tsdf) -> DataFrame:
    df = df.withColumns(voxel_of(p, cfg).as_map("g"))
    return df.withColumns({**block_of(V3.of("g"), cfg).as_map("b"),
                           **local_of(V3.of("g"), cfg).as_map("l")})


def array_index(g: V3, per_axis: int) -> Column:
    """Linear index of a voxel in a dense cube."""
    return g.x + g.y * per_axis + g.z * (per_axis * per_axis)


def array_voxel(index: Column, per_axis: int) -> V3:
    n = F.lit(per_axis)
    return V3(index % n, F.floor((index % (n * n)) / n), F.floor(index / (n * n)))


def voxel_to_world(g: V3, cfg: Tsdf) -> V3:
    return g * F.lit(cfg.voxel_size)


# -- block allocation --------------------------------------------------------------------
def _crossings(o: Column, e: Column, edge: float) -> Column:
    """Ray parameters in (0, 1) where o + t (e - o) passes a multiple of ``edge``."""
    lo = F.floor(F.least(o, e) / F.lit(edge)) + 1
    hi = F.ceil(F.greatest(o, e) / F.lit(edge)) - 1
    ks = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(ks, lambda k: div(k * F.lit(edge) - o, e - o))


def ray_blocks(rays: DataFrame, cfg: Tsdf, keep: list[str]) -> DataFrame:
    """Distinct (keep, block) over the segments from ox,oy,oz to ex,ey,ez. A ray lists the
    planes it crosses; each gap between crossings lies in exactly one block."""
    edge = cfg.block_edge
    o, e = V3.of("o"), V3.of("e")
    ts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)),
                               *[_crossings(a, b, edge) for a, b in zip(o, e)]))
    df = rays.withColumn("_ts", ts)
    mids = F.transform(F.expr("slice(_ts, 1, size(_ts) - 1)"),
                       lambda t, i: (t + F.get(F.col("_ts"), i + 1)) / 2.0)
    df = df.withColumn("_t", F.explode(mids))
    b = V3(*[F.floor((p + (q - p) * F.col("_t")) / F.lit(edge)) for p, q in zip(o, e)])
    return df.select(*keep, *b.named("b")).distinct()


def pixel_rays(pixels: DataFrame, poses: DataFrame, s: Sensor, cfg: Tsdf) -> DataFrame:
    """Segment from the camera to ``truncation`` behind the surface for each valid pixel."""
    cam = camera.back_project(s, F.col("depth"))
    # A valid depth is positive, so the camera-space length is too.
    longer = 1.0 + F.lit(cfg.truncation) / cam.length()
    df = pixels.filter(camera.valid_depth(cfg.min_depth, cfg.max_depth))
    df = df.select("frame_id", *(cam * longer).named("c"))
    df = df.join(pose_columns(poses), "frame_id")
    return df.select("frame_id", F.col("m03").alias("ox"), F.col("m13").alias("oy"),
                     F.col("m23").alias("oz"), *joined_pose().apply(V3.of("c")).named("e"))


def allocate(pixels: DataFrame, poses: DataFrame, s: Sensor, cfg: Tsdf) -> DataFrame:
    """(frame_id, bx, by, bz) of every block a frame's rays pass through."""
    return ray_blocks(pixel_rays(pixels, poses, s, cfg), cfg, ["frame_id"])


def blocks(allocated: DataFrame) -> DataFrame:
    """Blocks of the map with the frame that first touched them."""
    return allocated.groupBy(*BLOCK).agg(F.min("frame_id").alias("born"))


def insert_blocks(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks to add: wanted, distinct and not there yet."""
    return wanted.select(*BLOCK).distinct().join(existing, BLOCK, "left_anti")


def delete_blocks(existing: DataFrame, gone: DataFrame) -> DataFrame:
    return existing.join(gone, BLOCK, "left_anti")


def find_blocks(queries: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``found`` (0/1)."""
    hit = existing.select(*BLOCK).distinct().withColumn("found", F.lit(1))
    return queries.join(hit, BLOCK, "left").withColumn("found", F.coalesce("found", F.lit(0)))


# -- integration -------------------------------------------------------------------------
def reach(s: Sensor, cfg: Tsdf) -> int:
    """How many blocks away from a ray a voxel that projects onto its pixel can lie: the
    half-pixel error at the far end of the longest ray, doubled for the ray's cut end."""
    slope = math.sqrt(1 + (max(s.cx, s.cols - s.cx) / s.fx) ** 2 + (max(s.cy, s.rows - s.cy) / s.fy) ** 2)
    far = cfg.max_depth * slope + cfg.truncation
    return max(1, math.ceil(2 * far * math.hypot(0.5 / s.fx, 0.5 / s.fy) / cfg.block_edge))


def near_blocks(allocated: DataFrame, s: Sensor, cfg: Tsdf) -> DataFrame:
    """(frame_id, block) within ``reach`` of the blocks that a frame's rays pass."""
    n = reach(s, cfg)
    near = F.sequence(F.lit(-n), F.lit(n))
    # A frame touches a bounded number of blocks, so one shuffle by frame serves all three steps.
    d = allocated.repartition("frame_id")
    for a in BLOCK:
        d = d.withColumn(f"_{a}", F.explode(near)).withColumn(a, F.col(a) + F.col(f"_{a}")).drop(f"_{a}")
        d = d.distinct()
    return d


def frame_blocks(allocated: DataFrame, known: DataFrame, s: Sensor, cfg: Tsdf) -> DataFrame:
    """(frame, block) pairs to integrate: blocks that exist by then and lie within ``reach``
    of the frame's rays. Any other existing block gets no observation from the frame, so this
    replaces pairing every frame with every block."""
    d = near_blocks(allocated, s, cfg)
    return d.join(known, BLOCK).filter(F.col("born") <= F.col("frame_id")).drop("born")


def _to_camera(p: V3) -> V3:
    return joined_pose().rotation().T.apply(p - joined_pose().translation())


def _observe(s: Sensor, cfg: Tsdf):
    """The voxels of one frame's blocks that see its pixels, some blocks at a time."""
    n, h, tau = cfg.block_size, cfg.voxel_size, cfg.truncation
    inner = np.stack(np.unravel_index(np.arange(n ** 3), (n, n, n)), axis=1)

    def run(key, blocks: pa.Table, seen: pa.Table) -> pa.Table:
        idx, found = seen["idx"].to_numpy(), []
        order = np.argsort(idx, kind="stable")
        idx, sd = idx[order], seen["_sd"].to_numpy()[order]
        at = np.stack([blocks[c].to_numpy() for c in BLOCK], axis=1) * n
        m = {c: blocks[c].to_numpy() for c in (f"m{i}{k}" for i in range(3) for k in range(4))}
        step = max(1, 200_000 // n ** 3) if len(idx) else max(1, len(at))
        for k in range(0, len(at) if len(idx) else 0, step):
            rows = slice(k, k + step)
            g = (at[rows, None, :] + inner[None]).reshape(-1, 3)
            e = {c: np.repeat(v[rows], n ** 3) for c, v in m.items()}
            d = [g[:, i] * h - e[f"m{i}3"] for i in range(3)]
            x, y, z = (e[f"m0{i}"] * d[0] + e[f"m1{i}"] * d[1] + e[f"m2{i}"] * d[2] for i in range(3))
            near = np.flatnonzero(z > 0)  # on the camera plane there is no pixel
            g, x, y, z = g[near], x[near], y[near], z[near]
            u, v = s.fx * x / z + s.cx, s.fy * y / z + s.cy
            ok = np.flatnonzero((u > -0.5) & (u < s.cols - 0.5) & (v > -0.5) & (v < s.rows - 0.5))
            g, vd = g[ok], np.sqrt(x[ok] * x[ok] + y[ok] * y[ok] + z[ok] * z[ok])
            pixel = (np.floor(np.abs(v[ok]) + 0.5) * np.sign(v[ok]) * s.cols + np.floor(np.abs(u[ok]) + 0.5) * np.sign(u[ok])).astype(np.int64)
            first = np.searchsorted(idx, pixel)
            times = np.searchsorted(idx, pixel, side="right") - first  # a pixel may be there more than once
            own = np.repeat(np.arange(len(pixel)), times)
            p = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + first[own]
            gap, before = sd[p] - vd[own], vd[own] < sd[p] - tau
            ok = ((vd[own] > sd[p] - tau) & (vd[own] < sd[p] + tau)) | before
            found.append((g[own[ok]], np.where(before, tau, gap)[ok], order[p[ok]]))
        g, sdf, p = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros((0, 3), np.int64), np.zeros(0), np.zeros(0, np.int64))
        colours = seen.select(["r", "g", "b"]).take(pa.array(p))
        return pa.table([pa.array(np.full(len(p), key[0].as_py(), np.int64)), *[pa.array(g[:, i]) for i in range(3)], pa.array(sdf), *colours.columns],
                        ["frame_id", *G, "sdf", "r", "g", "b"])
    return run


def observations(pairs: DataFrame, pixels: DataFrame, poses: DataFrame, s: Sensor,
                 cfg: Tsdf) -> DataFrame:
    """One row per (frame, voxel) that sees a valid pixel within or before the surface.

    A frame's blocks meet its pixels in one task: both are bounded by the sensor, and of the voxels, hundreds for each
    that sees a pixel within reach, only those that do are ever rows.
    """
    edge = cfg.block_edge
    df = pairs.join(pose_columns(poses), "frame_id")
    corner = _to_camera(V3.of("b") * F.lit(edge))
    df = computed(df, corner.as_map("_k")).filter(F.col("_kz") >= 0)
    u, v = camera.project_raw(s, V3.of("_k") + F.lit(0.5 * edge))
    df = df.filter(camera.rounds_into_image(s, u, v))
    df = df.select(F.col("frame_id").cast("long"), *BLOCK, *[f"m{i}{k}" for i in range(3) for k in range(4)])
    seen = pixels.filter(camera.valid_depth(cfg.min_depth, cfg.max_depth)).filter("frame_id is not null and idx is not null")
    seen = seen.select(F.col("frame_id").cast("long"), F.col("idx").cast("long"), *[F.col(c).cast("long") for c in "rgb"],
                       camera.back_project(s, F.col("depth")).length().alias("_sd"))
    return df.groupBy("frame_id").cogroup(seen.groupBy("frame_id")).applyInArrow(
        _observe(s, cfg), "frame_id long, gx long, gy long, gz long, sdf double, r long, g long, b long")


# -- merging -----------------------------------------------------------------------------
def _merge(cfg: Tsdf):
    """Running weighted mean; colours truncate at each step and the weight saturates."""
    def step(acc, o):
        w = acc["weight"]

        def mean(c):
            return ((acc[c] * w + o[c]) / (w + 1)).cast("long")

        return F.struct(((acc["sdf"] * w + o["sdf"]) / (w + 1)).alias("sdf"),
                        F.least(w + 1, F.lit(cfg.max_weight)).alias("weight"),
                        *[mean(c).alias(c) for c in "rgb"])
    return step


def _lookup(table):
    """Read a level map; a one-element map is a constant."""
    return lambda v: F.get(table, F.least(v.cast("int"), F.size(table) - 1))


def _state(prior: bool) -> Column:
    def v(name, kind):
        zero = F.lit(0).cast(kind)
        return (F.coalesce(F.col(f"_p_{name}"), zero) if prior else zero).alias(name)
    return F.struct(v("sdf", "double"), v("weight", "int"), v("r", "long"), v("g", "long"),
                    v("b", "long"))


def _grouped(obs: DataFrame, keys: list[str]) -> DataFrame:
    return obs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("frame_id", "sdf", "r", "g", "b"))).alias("_obs"))


def _renamed(prior: DataFrame) -> DataFrame:
    return prior.select(*G, *[F.col(c).alias(f"_p_{c}") for c in ("sdf", "weight", "r", "g", "b")])


def fold(obs: DataFrame, cfg: Tsdf, prior: DataFrame | None = None) -> DataFrame:
    """Merge observations in frame order. A voxel has at most one observation per frame, so
    its array is as long as the frames are many: the plain model of ``fold_running``, which ``merge`` uses, and ``fold_chunked``."""
    g = _grouped(obs, G)
    if prior is not None:
        g = g.join(_renamed(prior), G, "full_outer").withColumn("_obs", F.coalesce("_obs", F.array()))
    merged = F.aggregate("_obs", _state(prior is not None), _merge(cfg))
    return g.select(*G, merged.alias("_m")).select(*G, "_m.*")


def fold_chunked(obs: DataFrame, cfg: Tsdf, prior: DataFrame | None = None, chunk: int = CHUNK,
                 fan: int = 256) -> DataFrame:
    """``fold`` for any number of frames: exact, and no array grows with the frame count.

    Frames are cut into chunks. Given the weight a chunk starts with, its effect on the sdf is
    an affine map and its effect on a colour is a map of the 256 levels. Such maps compose, so
    chunks are summarised independently, then composed ``fan`` at a time, then applied.
    """
    n_max = F.lit(cfg.max_weight)
    # One exchange by voxel serves every step below: neither observations nor level maps are moved again.
    g = _grouped(obs.withColumn("_c", F.floor(F.col("frame_id") / chunk)).repartition(*G), [*G, "_c"])
    # How many observations precede each chunk, and hence its start weight.
    before = Window.partitionBy(*G).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_n", F.coalesce(F.sum(F.size("_obs")).over(before), F.lit(0)))
    if prior is not None:
        g = g.join(prior.select(*G, F.col("weight").alias("_p")), G, "left").withColumn("_n", F.col("_n") + F.coalesce("_p", F.lit(0)))
    g = g.withColumn("_w", F.least("_n", n_max).cast("int"))

    def affine(acc, o):
        w = acc["fw"]
        return F.struct((acc["fa"] * w / (w + 1)).alias("fa"),
                        ((acc["fb"] * w + o["sdf"]) / (w + 1)).alias("fb"),
                        F.least(w + 1, n_max).alias("fw"))
    start = F.struct(F.lit(1.0).alias("fa"), F.lit(0.0).alias("fb"), F.col("_w").alias("fw"))

    def levels(c):
        def run(first):
            init = F.struct(first.cast("long").alias("v"), F.col("_w").alias("w"))
            return F.aggregate("_obs", init, lambda acc, o: F.struct(
                ((acc["v"] * acc["w"] + o[c]) / (acc["w"] + 1)).cast("long").alias("v"),
                F.least(acc["w"] + 1, n_max).alias("w")))["v"]
        # With no earlier weight the start level does not matter: the map is constant.
        return F.when(F.col("_w") == 0, F.array(run(F.lit(0)))).otherwise(
            F.transform(F.sequence(F.lit(0), F.lit(255)), run))
    parts = g.select(*G, "_c", F.aggregate("_obs", start, affine).alias("_f"),
                     *[levels(c).alias(c) for c in "rgb"])
    parts = parts.select(*G, F.floor(F.col("_c") / fan).alias("_s"),
                         F.struct(F.col("_c").alias("at"), "_f.fa", "_f.fb", "_f.fw", "r", "g", "b").alias("_x"))

    def compose(acc, x):
        return F.struct(x["at"].alias("at"), (acc["fa"] * x["fa"]).alias("fa"),
                        (x["fa"] * acc["fb"] + x["fb"]).alias("fb"), x["fw"].alias("fw"),
                        *[F.transform(acc[c], _lookup(x[c])).alias(c)
                          for c in "rgb"])

    def sequence_of(df, *keys):
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_l"))
    packed = sequence_of(parts, *G, "_s").select(
        *G, F.aggregate(F.expr("slice(_l, 2, size(_l))"), F.get("_l", F.lit(0)), compose).alias("_x"))

    def apply(acc, x):
        return F.struct((x["fa"] * acc["sdf"] + x["fb"]).alias("sdf"), x["fw"].alias("weight"),
                        *[_lookup(x[c])(acc[c]).alias(c) for c in "rgb"])
    out = sequence_of(packed, *G)
    if prior is not None:
        out = out.join(_renamed(prior), G, "full_outer").withColumn("_l", F.coalesce("_l", F.array()))
    out = out.select(*G, F.aggregate("_l", _state(prior is not None), apply).alias("_m"))
    return out.select(*G, "_m.*")


def _running(cfg: Tsdf):
    """Folds rows that come by voxel, prior first, then by frame; the voxel that a batch ends in goes on in the next."""
    names = [*G, "sdf", "weight", "r", "g", "b"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def table(rows):
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.record_batch([pa.array(c, k, from_pandas=True) for c, k in zip(columns, kinds)], names)

    def run(batches):
        at, sdf, w, r, g, b = None, 0.0, 0, 0, 0, 0
        for batch in batches:
            done = []
            x, y, z, n, rr, gg, bb = (batch[c].to_pylist() for c in (*G, "weight", "r", "g", "b"))
            for i, o in enumerate(batch["sdf"].to_numpy(zero_copy_only=False).tolist()):
                here = (x[i], y[i], z[i])
                if here != at:
                    if at is not None:
                        done.append((*at, sdf, w, r, g, b))
                    at, sdf, w, r, g, b = here, 0.0, 0, 0, 0, 0
                if n[i] is not None:
                    sdf, w, r, g, b = o, n[i], rr[i], gg[i], bb[i]
                    continue
                v = w + 1
                # Colours truncate as a cast does.
                sdf, r, g, b = (sdf * w + o) / v, int((r * w + rr[i]) / v), int((g * w + gg[i]) / v), int((b * w + bb[i]) / v)
                w = min(v, cfg.max_weight)
            yield table(done)
        if at is not None:
            yield table([(*at, sdf, w, r, g, b)])
    return run


def fold_running(obs: DataFrame, cfg: Tsdf, prior: DataFrame | None = None) -> DataFrame:
    """``fold`` for any number of frames: one exchange by voxel, then the sorted rows are scanned, one step per
    observation, and no more than the voxel at hand is held. Colours must not be null."""
    rows = obs.select(*G, "frame_id", "sdf", F.lit(None).cast("int").alias("weight"), *[F.col(c).cast("long") for c in "rgb"])
    if prior is not None:  # a row with a weight is a state, not an observation
        kept = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("sdf", "weight", "r", "g", "b")}
        rows = rows.unionByName(prior.withColumns(kept).select(*G, F.lit(None).cast("long").alias("frame_id"), "sdf",
                                                               F.col("weight").cast("int"), *[F.col(c).cast("long") for c in "rgb"]))
    rows = rows.repartition(*G).sortWithinPartitions(*G, F.col("weight").isNull(), "frame_id", "sdf", *"rgb")
    return rows.drop("frame_id").mapInArrow(_running(cfg), MAP_SCHEMA)


def _levels_only(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(c))).cast("long") for c in "rgb"})


def merge(obs: DataFrame, cfg: Tsdf, prior: DataFrame | None = None) -> DataFrame:
    """Fold observations in frame order, whatever their number. Colours are levels from 0 to 255: others, which a user
    may have set, are taken as the nearest level."""
    return fold_running(_levels_only(obs), cfg, None if prior is None else _levels_only(prior))


def merge_one(obs: DataFrame, cfg: Tsdf, prior: DataFrame, keys: list[str]) -> DataFrame:
    """``merge`` for at most one observation of each voxel, whose key is ``keys``: a plain join; returns observed voxels."""
    o, p = _levels_only(obs), _levels_only(prior)
    j = o.join(p.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in ("sdf", "weight", "r", "g", "b")]), keys, "left")
    step = _merge(cfg)(_state(True), F.struct("sdf", "r", "g", "b"))
    return j.select(*keys, step.alias("_m")).select(*keys, "_m.*")


def fuse(pixels: DataFrame, poses: DataFrame, s: Sensor, cfg: Tsdf, *,
         allocated: DataFrame | None = None) -> DataFrame:
    """Integrate every frame at its given pose and return the observed voxels."""
    # Read twice below and far smaller than the pixels it comes from.
    allocated = cut(allocate(pixels, poses, s, cfg)) if allocated is None else allocated
    pairs = frame_blocks(allocated, blocks(allocated), s, cfg)
    obs = observations(pairs, pixels, poses, s, cfg)
    return merge(obs, cfg)


def with_blocks(voxels: DataFrame, cfg: Tsdf) -> DataFrame:
    """Map rows with their block and local coordinates."""
    g = V3.of("g")
    return voxels.withColumns({**block_of(g, cfg).as_map("b"), **local_of(g, cfg).as_map("l")})


# -- lookup ------------------------------------------------------------------------------
def get_voxels(queries: DataFrame, voxels: DataFrame, cfg: Tsdf) -> DataFrame:
    """Voxel at each query point x,y,z; zeros where nothing was observed."""
    q = queries.withColumns(voxel_of(V3.of(), cfg).as_map("g"))
    out = q.join(voxels, G, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("sdf", "weight", "r", "g", "b")})


def set_voxels(voxels: DataFrame, known: DataFrame, updates: DataFrame, cfg: Tsdf) -> DataFrame:
    """Overwrite voxels whose block exists in ``known``; other updates are ignored. One
    grouping merges both sides: an update outranks the stored row."""
    cols = ["sdf", "weight", "r", "g", "b"]
    ok = with_blocks(updates, cfg).join(known.select(*BLOCK).distinct(), BLOCK, "left_semi")
    both = voxels.select(*G, *cols, F.lit(0).alias("_o")).unionByName(
        ok.select(*G, *cols, F.lit(1).alias("_o")))
    return both.groupBy(*G).agg(F.max_by(F.struct(*cols), "_o").alias("_v")).select(*G, "_v.*")


def interpolate(queries: DataFrame, voxels: DataFrame, cfg: Tsdf, key: str) -> DataFrame:
    """Trilinear sdf and colour at x,y,z of each ``key`` row, on the grid shifted by half a
    voxel. Unobserved corners take the centre voxel's value; the weight is the centre's."""
    h = cfg.voxel_size
    p = V3.of()
    f = p / F.lit(h) - (p / F.lit(h)).floor()
    taps = [F.struct(F.lit(True).alias("c"), F.lit(0.0).alias("w"), *voxel_of(p, cfg).named("g"))]
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                w = reduce(lambda a, b: a * b, [x if o else 1.0 - x for x, o in zip(f, (i, j, k))])
                q = p + V3.lit(*[(o - 0.5) * h for o in (i, j, k)])
                taps.append(F.struct(F.lit(False).alias("c"), w.alias("w"), *voxel_of(q, cfg).named("g")))
    # Every tap is an equi-join on the voxel key; a popular voxel only skews the query side,
    # which adaptive execution can split, since the map holds one row per voxel.
    t = queries.withColumn("_t", F.explode(F.array(*taps))).select(key, "_t.*")
    t = t.join(voxels.withColumnRenamed("g", "g_").withColumnRenamed("weight", "n"), G, "left")
    vals = {"sdf": "sdf", "r": "r", "g": "g_", "b": "b"}
    aggs = [F.max(F.when(F.col("c"), F.col("n"))).alias("weight")]
    for n, c in vals.items():
        aggs += [F.max(F.when(F.col("c"), F.col(c))).alias(f"_0{n}"),
                 F.sum(F.when(~F.col("c"), F.col("w") * F.col(c))).alias(f"_s{n}"),
                 F.sum(F.when(~F.col("c") & F.col("n").isNull(), F.col("w"))).alias(f"_m{n}")]
    out = t.groupBy(key).agg(*aggs)

    def value(n):
        full = F.coalesce(f"_s{n}", F.lit(0.0)) + F.coalesce(f"_m{n}", F.lit(0.0)) * F.col(f"_0{n}")
        return F.when(F.col("weight").isNull(), F.lit(0.0)).otherwise(full)
    return out.select(key, value("sdf").alias("sdf"), F.coalesce("weight", F.lit(0)).alias("weight"),
                      *[F.round(value(c), 9).cast("long").alias(c) for c in "rgb"])
