"""Frame-by-frame mapping: a stream that integrates at given poses, and tracking from frame to frame or to the model."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Rigid, Sensor, Tsdf
from ..functions.mat import Mat
from ..functions.vec import V3
from ..operators import rigid, voxelray
from ..operators import voxels as vx
from ..runtime import cut, ensure_checkpoint_dir


class MapStore:
    """Versions of a map in a shared folder: voxels, and the blocks with their first frame. A batch writes only the rows
    that it changes; every ``full`` versions all rows are written, so that a reader takes one full version and the
    changes since. A repeated batch overwrites its own version. ``also`` are further key columns."""

    def __init__(self, folder: str, full: int = 16, also: list[str] | None = None):
        self.folder, self.full = folder, full
        self.keys = {"voxels": [*(also or []), *vx.G], "blocks": [*(also or []), *vx.BLOCK]}

    def _at(self, kind: str, version: int) -> str:
        return os.path.join(self.folder, kind, f"v{version}")

    def read(self, spark, kind: str, version: int) -> DataFrame:
        """All rows as of a version: of each key the row that was written last."""
        key = self.keys[kind]
        parts = [spark.read.parquet(self._at(kind, v)).withColumn("_v", F.lit(v)) for v in range(version - version % self.full, version + 1)]
        if len(parts) == 1:
            return parts[0].drop("_v")
        every = reduce(DataFrame.unionByName, parts)
        rest = [c for c in every.columns if c not in (*key, "_v")]
        return every.groupBy(*key).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*key, "_r.*")

    def write(self, changed: DataFrame, kind: str, version: int) -> None:
        if version and version % self.full == 0:
            key = self.keys[kind]
            kept = self.read(changed.sparkSession, kind, version - 1).join(changed.select(*key), key, "left_anti")
            changed = kept.unionByName(changed)
        changed.write.mode("overwrite").parquet(self._at(kind, version))


def integrate(pixels: DataFrame, poses: DataFrame, s: Sensor, cfg: Tsdf, voxels: DataFrame | None,
              known: DataFrame | None, changed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(voxels, blocks) after merging the frames of ``pixels`` into an existing map; with ``changed``, only the voxels
    that the frames see and the blocks that are new."""
    allocated = cut(vx.allocate(pixels, poses, s, cfg))
    blocks = vx.blocks(allocated)
    new = blocks
    if known is not None:
        new = blocks.join(known.select(*vx.BLOCK), vx.BLOCK, "left_anti")
        blocks = known.unionByName(blocks).groupBy(*vx.BLOCK).agg(F.min("born").alias("born"))
    pairs = vx.frame_blocks(allocated, blocks, s, cfg)
    obs = vx.observations(pairs, pixels, poses, s, cfg)
    if changed and voxels is not None:
        obs = cut(obs)  # also names the voxels that are read
        voxels = voxels.join(obs.select(*vx.G).distinct(), vx.G, "left_semi")
    return vx.merge(obs, cfg, voxels), new if changed else blocks


def whole_frames(pixels: DataFrame, stamp: str, delay: str) -> DataFrame:
    """One row per frame of a stream of pixel rows, with its rows as an array ``pixels``, once no more can come.

    All rows of a frame carry its time ``stamp``. The rows are kept as state, over any number of micro-batches, until the
    watermark (the latest stamp less ``delay``) has passed it; a batch thus gives all frames up to some time that no
    earlier batch gave. Rows that come later than that are dropped by the engine. A last row with a null frame_id and a
    stamp beyond ``delay`` releases what is left. State is as large as the frames within ``delay``.
    """
    rest = [c for c in pixels.columns if c not in ("frame_id", stamp)]
    return (pixels.withWatermark(stamp, delay).groupBy("frame_id", stamp)
            .agg(F.collect_list(F.struct(*rest)).alias("pixels")))


def fuse_stream(pixels: DataFrame, poses: DataFrame, s: Sensor, cfg: Tsdf, store: MapStore, checkpoint: str,
                on_batch=None, *, stamp: str = "ts", delay: str = "10 seconds") -> StreamingQuery:
    """Merge a stream of pixel rows into the map in the order of frames, which must be that of their stamps. A frame may
    be spread over several batches, see :func:`whole_frames`; a pixel that is sent twice counts once."""
    spark = pixels.sparkSession

    def update(batch: DataFrame, version: int):
        # The session of a batch plans without adaptive execution, every exchange with all partitions; the stream's own,
        # which reads the rows once written, sizes them by the data.
        at = os.path.join(store.folder, "rows", f"v{version}")
        old = [None, None] if version == 0 else [store.read(spark, k, version - 1) for k in ("voxels", "blocks")]
        rows = batch.filter("frame_id is not null").select("frame_id", F.inline("pixels")).dropDuplicates(["frame_id", "idx"])
        rows.write.mode("overwrite").parquet(at)
        voxels, blocks = integrate(spark.read.parquet(at), poses, s, cfg, *old, changed=True)
        store.write(voxels, "voxels", version)
        store.write(blocks, "blocks", version)
        if on_batch:
            on_batch(version)
    return (whole_frames(pixels, stamp, delay).writeStream.outputMode("append").foreachBatch(update)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def track_to_frame(pixels: DataFrame, s: Sensor, cfg: Rigid) -> DataFrame:
    """World pose matrix of each frame: every frame is aligned to the one before it, all pairs
    at once, and the results are chained."""
    target = pixels.withColumn("frame_id", F.col("frame_id") + 1)
    relative = rigid.register(pixels, target, s, cfg, pixels.select("frame_id").distinct())
    return rigid.chain(relative)


def track_to_model(pixels: DataFrame, s: Sensor, tracking: Rigid, cfg: Tsdf, starts: DataFrame | None = None,
                   full: int = 16) -> tuple[DataFrame, DataFrame]:
    """Frame-to-model mapping of many sequences: pixels(seq, step, idx, u, v, depth, r, g, b) -> poses (seq, step,
    m00..m23) and voxels (seq, gx, gy, gz, sdf, weight, r, g, b).

    A frame is aligned to the depth that the map of its sequence shows from the last pose, then merged into that map. As
    a frame needs the map of those before it, the steps follow each other; each is a few jobs over all sequences at once,
    whose state is keyed: one pose per sequence, blocks and voxels by sequence and place. The frames are laid out by step
    first, so that a step reads its own alone, and it writes the voxels that it changes. A sequence may lack steps or end
    early: its pose then stays, and no row is given. ``starts``: (seq, m00..m23) of first poses, else the identity.
    """
    spark = pixels.sparkSession
    folder = os.path.join(ensure_checkpoint_dir(spark), f"track-{uuid.uuid4().hex}")
    pixels.repartition("step").write.partitionBy("step").parquet(f"{folder}/frames")
    laid = spark.read.parquet(f"{folder}/frames")
    store = MapStore(f"{folder}/maps", full, also=["seq"])
    every = laid.select("seq").distinct()
    eye = {c: 1.0 if c in ("m00", "m11", "m22") else 0.0 for c in rigid.POSE}
    pose = every.select("seq", *[F.lit(v).alias(c) for c, v in eye.items()]) if starts is None else starts.join(every, "seq", "left_semi")
    pose, voxels, known, version = cut(pose.select(F.col("seq").cast("long"), *rigid.POSE)), None, None, -1
    written = None
    for step in sorted(r[0] for r in laid.select("step").distinct().collect()):
        frames = cut(laid.filter(F.col("step") == step).drop("step").withColumnRenamed("seq", "frame_id"))
        here = frames.select(F.col("frame_id").alias("seq")).distinct()
        if voxels is not None:
            shown = voxelray.render_views(voxels.withColumnRenamed("seq", "view"), pose.join(here, "seq", "left_semi").withColumnRenamed("seq", "view"), s, cfg)
            model = cut(shown.filter(F.col("depth") < cfg.max_depth).select(
                F.col("view").alias("frame_id"), "idx", (F.col("idx") % s.cols).alias("u"), F.expr(f"idx div {s.cols}").alias("v"), "depth"))
            moved = rigid.register(frames, model, s, tracking).select(F.col("frame_id").alias("seq"), *[F.col(c).alias(f"_{c}") for c in rigid.POSE])
            pose = cut(_composed(pose, moved))
        now = pose.join(here, "seq", "left_semi")
        row = now.select("seq", F.lit(step).cast("long").alias("step"), *rigid.POSE)
        written = row if written is None else written.unionByName(row)
        placed = rigid.poses_of(now.withColumnRenamed("seq", "frame_id"))
        allocated = cut(vx.allocate(frames, placed, s, cfg))
        fresh = allocated.select(F.col("frame_id").alias("seq"), *vx.BLOCK)
        if known is not None:
            fresh = fresh.join(known, ["seq", *vx.BLOCK], "left_anti")
        version += 1
        store.write(fresh.withColumn("born", F.lit(step).cast("long")), "blocks", version)
        known = store.read(spark, "blocks", version).drop("born")
        pairs = vx.near_blocks(allocated, s, cfg).join(known.withColumnRenamed("seq", "frame_id"), ["frame_id", *vx.BLOCK])
        obs = vx.observations(pairs, frames, placed, s, cfg).withColumnRenamed("frame_id", "seq")
        before = spark.createDataFrame([], f"seq long, {vx.MAP_SCHEMA}") if voxels is None else voxels
        store.write(vx.merge_one(obs, cfg, before, ["seq", *vx.G]), "voxels", version)
        voxels = store.read(spark, "voxels", version)
    if written is None:
        return pose.select("seq", F.lit(0).cast("long").alias("step"), *rigid.POSE), spark.createDataFrame([], f"seq long, {vx.MAP_SCHEMA}")
    return written, voxels


def _composed(pose: DataFrame, moved: DataFrame) -> DataFrame:
    """Each sequence's pose after its frame's relative motion (columns with an underscore), if it has one."""
    j = pose.join(moved, "seq", "left")
    mat = lambda p: Mat.rigid(Mat.cols([f"{p}m{i}{k}" for i in range(3) for k in range(3)], 3), V3(*[F.col(f"{p}m{i}3") for i in range(3)]))
    product = mat("") @ mat("_")
    return j.select("seq", *[F.coalesce(product[i, k], F.col(f"m{i}{k}")).alias(f"m{i}{k}") for i in range(3) for k in range(4)])
