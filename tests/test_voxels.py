import math

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxweave.config import Sensor, Tsdf
from voxweave.operators import marching, mesh, raster, rigid
from voxweave.operators import voxels as vx
from voxweave.operators import voxelray
from voxweave.runtime import cut
from voxweave.streaming import tracking

CFG = Tsdf(voxel_size=0.1, block_size=4, truncation=0.3, max_weight=5)


def sequential(obs, cap):
    out = {}
    for o in sorted(obs, key=lambda o: o[0]):
        k = o[1:4]
        s, w, c = out.get(k, (0.0, 0, (0, 0, 0)))
        out[k] = ((s * w + o[4]) / (w + 1), min(w + 1, cap), tuple((a * w + b) // (w + 1) for a, b in zip(c, o[5:])))
    return out


def observations(n_frames, seed):
    r = np.random.default_rng(seed)
    rows = []
    for f in range(n_frames):
        for g in range(4):
            if g == 0 or r.random() < 0.4:  # voxel 0 is seen in every frame
                rows.append((f, g, 0, 0, float(r.normal()), *[int(x) for x in r.integers(0, 256, 3)]))
    return rows


OBS = "frame_id long, gx long, gy long, gz long, sdf double, r long, g long, b long"


@pytest.mark.parametrize("how", ["plain", "chunked", "prior", "chunked prior"])
def test_merge_is_the_sequential_fold(spark, how):
    rows = observations(60, 3)
    df = spark.createDataFrame(rows, OBS)
    if how == "plain":
        got = vx.fold(df, CFG)
    elif how == "chunked":
        got = vx.fold_chunked(df, CFG, chunk=4, fan=3)
    elif how == "chunked prior":
        got = vx.fold_chunked(df.filter("frame_id >= 25"), CFG, vx.fold(df.filter("frame_id < 25"), CFG), chunk=4, fan=3)
    else:
        got = vx.fold(df.filter("frame_id >= 25"), CFG, prior=vx.fold(df.filter("frame_id < 25"), CFG))
    want = sequential(rows, CFG.max_weight)
    for r in got.collect():
        s, w, c = want.pop((r["gx"], r["gy"], r["gz"]))
        assert abs(r["sdf"] - s) < 1e-9 and r["weight"] == w and (r["r"], r["g"], r["b"]) == c
    assert not want


def test_merge_of_levels_beyond_the_range(spark):
    """The same map whether frames fill one chunk or many; a prior outside 0..255 counts as the nearest level."""
    df = spark.createDataFrame([(f, 0, 0, 0, 0.1, 400 + f, 300, -5) for f in range(8)], OBS)
    prior = spark.createDataFrame([(0, 0, 0, 0.5, 2, 900, 10, 10)], vx.MAP_SCHEMA)
    near, far = (vx.merge(df.withColumn("frame_id", F.col("frame_id") * k), CFG, prior).collect() for k in (1, 5000))
    assert [tuple(r)[4:] for r in near] == [tuple(r)[4:] for r in far] and abs(near[0]["sdf"] - far[0]["sdf"]) < 1e-12
    assert near[0]["r"] == 255


def test_block_hash_wraps_like_int32(spark):
    def model(x, y, z):
        h = np.int64(0)
        for c, p in zip((x, y, z), vx.HASH_PRIMES):
            h ^= ((c * p + 2 ** 31) % 2 ** 32) - 2 ** 31
        return int(h) % 2500 * 10
    pts = [(i * 37 - 500, i - 3, 7 - i * i) for i in range(60)]
    df = spark.createDataFrame(pts, "x long, y long, z long")
    got = df.select("x", "y", "z", vx.block_hash(F.col("x"), F.col("y"), F.col("z"), Tsdf()).alias("h")).collect()
    assert all(r["h"] == model(r["x"], r["y"], r["z"]) for r in got)


def test_ray_blocks_match_dense_sampling(spark):
    rng = np.random.default_rng(5)
    seg = rng.uniform(-1, 1, (20, 6))
    df = spark.createDataFrame(pd.DataFrame(seg, columns=["ox", "oy", "oz", "ex", "ey", "ez"])).withColumn("k", F.lit(0))
    got = {(r["bx"], r["by"], r["bz"]) for r in vx.ray_blocks(df, CFG, ["k"]).collect()}
    ts = np.linspace(0, 1, 20001)[None, :, None]
    p = seg[:, None, :3] + (seg[:, None, 3:] - seg[:, None, :3]) * ts
    dense = {tuple(map(int, b)) for b in np.unique(np.floor(p / CFG.block_edge).reshape(-1, 3), axis=0)}
    assert dense <= got and len(got - dense) <= 1


def lattice_sphere(spark, n=16, radius=0.5):
    step = 1.6 / (n - 1)
    r = np.arange(n)
    g = np.stack(np.meshgrid(r, r, r, indexing="ij"), -1).reshape(-1, 3)
    sdf = np.linalg.norm(g * step - 0.8, axis=1) - radius
    pdf = pd.DataFrame(g, columns=["gx", "gy", "gz"]).assign(sdf=sdf, weight=1, r=10, g=20, b=30)
    return spark.createDataFrame(pdf), step


def test_extracted_sphere_is_watertight(spark):
    vox, step = lattice_sphere(spark)
    tri = marching.extract(vox, Tsdf(voxel_size=step)).toPandas()
    p = tri[[f"p{k}{a}" for k in range(3) for a in "xyz"]].to_numpy().reshape(-1, 3, 3)
    radius = np.linalg.norm(p - 0.8, axis=2)
    assert abs(radius - 0.5).max() < step
    normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    keep = np.linalg.norm(normal, axis=1) > 1e-12
    assert ((normal * (p.mean(axis=1) - 0.8)).sum(axis=1)[keep] > 0).all()
    ids = {}
    idx = np.array([ids.setdefault(tuple(np.round(v, 6)), len(ids)) for v in p.reshape(-1, 3)]).reshape(-1, 3)
    edges = {}
    for a, b, c in idx:
        for e in ((a, b), (b, c), (c, a)):
            if e[0] != e[1]:
                edges[e] = edges.get(e, 0) + 1
    assert all(edges.get((b, a)) == n for (a, b), n in edges.items())


def test_indexed_sphere_is_the_welded_soup(spark):
    vox, step = lattice_sphere(spark)
    vertices, faces = marching.extract_indexed(vox, Tsdf(voxel_size=step))
    v, f = vertices.toPandas().sort_values("vid"), faces.toPandas().sort_values("fid")
    assert list(v["vid"]) == list(range(len(v))) and list(f["fid"]) == list(range(len(f)))
    at, idx = v[["x", "y", "z"]].to_numpy(), f[["v0", "v1", "v2"]].to_numpy()
    assert len({tuple(p) for p in np.round(at, 9)}) == len(at)
    assert set(idx.ravel()) == set(range(len(at)))
    order = ["gx", "gy", "gz", "tri"]
    soup = marching.extract(vox, Tsdf(voxel_size=step)).toPandas().sort_values(order)
    assert (soup[order].to_numpy() == f[order].to_numpy()).all()
    assert np.allclose(soup[[f"p{k}{a}" for k in range(3) for a in "xyz"]].to_numpy().reshape(-1, 3, 3), at[idx], atol=1e-9)
    sides = {}
    for a, b, c in idx:
        for e in ((a, b), (b, c), (c, a)):
            if e[0] != e[1]:
                sides[e] = sides.get(e, 0) + 1
    assert all(sides.get((b, a)) == n for (a, b), n in sides.items())
    assert np.allclose(v[["r", "g", "b"]].to_numpy() * 255, [10, 20, 30])


def test_a_triangle_across_the_camera_plane_costs_its_pixels(spark):
    """Whole images are not listed: the candidates stay near the pixels that are hit."""
    s = Sensor(rows=120, cols=160)
    tri = [(0, 0.3, 0.2, 2.0, 0.0, 0.1, -2.0, 0.1, -0.1, -2.0),   # thin, across the plane
           (1, -0.5, -0.4, -1.0, 0.5, -0.4, -1.0, 0.0, 0.5, -1.5)]
    df = spark.createDataFrame(tri, "fid long, " + ", ".join(f"p{k}{a} double" for k in range(3) for a in "xyz"))
    listed = {r["fid"]: r["count"] for r in raster.candidates(df, s, np.eye(4)).groupBy("fid").count().collect()}
    hit = {r["fid"]: r["count"] for r in raster.ray_hits(df, s, np.eye(4)).groupBy("fid").count().collect()}
    for fid in (0, 1):
        assert hit[fid] > 50 and listed[fid] <= hit[fid] + 6 * s.rows
    pairs = raster.candidates(df, s, np.eye(4)).select("fid", "_u", "_v")
    assert pairs.count() == pairs.distinct().count()


def test_triangle_table_uses_exactly_the_cut_edges():
    table = marching.triangle_table()
    for case in range(256):
        used = {e for c, _, *t in table if c == case for e in t}
        assert sum(1 << e for e in used) == marching.edge_mask(case)


def test_implicit_surfaces(spark):
    pts = marching.implicit(marching.lattice(spark, 21, -10.0, 10.0), "sphere")
    tri = marching.march_field(pts.select("gx", "gy", "gz", "d"), 1.0)
    assert tri.count() > 0
    for kind in ("hyperboloid", "saddle"):
        assert marching.implicit(marching.lattice(spark, 5, -10.0, 10.0), kind).filter("d < 0").count() > 0


def sphere_depth(s, centre, radius, eye=(0.0, 0.0, 0.0)):
    """Analytic depth image of a sphere before a back wall."""
    v, u = np.divmod(np.arange(s.rows * s.cols), s.cols)
    d = np.stack([(u - s.cx) / s.fx, (v - s.cy) / s.fy, np.ones(len(u))], axis=1)
    oc = np.array(eye) - centre
    a, b, c = (d * d).sum(1), 2 * d @ oc, oc @ oc - radius ** 2
    disc = b * b - 4 * a * c
    t = np.where(disc >= 0, (-b - np.sqrt(np.maximum(disc, 0))) / (2 * a), np.inf)
    return np.where(np.isfinite(t), t, 1.9)


def pixels_of(spark, s, frames):
    parts = []
    for fid, depth in frames.items():
        i = np.arange(s.rows * s.cols)
        parts.append(pd.DataFrame({"frame_id": fid, "idx": i, "u": i % s.cols, "v": i // s.cols, "depth": depth,
                                   "r": i % 256, "g": 100, "b": 50}))
    return spark.createDataFrame(pd.concat(parts))


def poses_at(spark, eyes):
    rows = [(f, *map(float, e), 0.0, 0.0, 0.0, 1.0) for f, e in eyes.items()]
    return spark.createDataFrame(rows, "frame_id long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")


S = Sensor(rows=48, cols=64, fx=60.0, fy=60.0, cx=31.5, cy=23.5)
FINE = Tsdf(voxel_size=0.02, block_size=8, truncation=0.06)


@pytest.fixture(scope="module")
def sphere(spark):
    centre = np.array([0.0, 0.0, 1.0])
    eyes = {0: (0.0, 0.0, 0.0), 1: (0.05, 0.0, 0.0), 2: (0.0, 0.05, 0.0)}
    pix = pixels_of(spark, S, {f: sphere_depth(S, centre, 0.4, e) for f, e in eyes.items()}).cache()
    return pix, poses_at(spark, eyes), vx.fuse(pix, poses_at(spark, eyes), S, FINE).cache()


def test_fused_sphere_end_to_end(spark, sphere):
    _, _, vox = sphere
    tri = marching.extract(vox, FINE, (-0.2, -0.2, 0.5), (0.2, 0.2, 0.8)).toPandas()
    p = tri[[f"p{k}{a}" for k in range(3) for a in "xyz"]].to_numpy().reshape(-1, 3)
    radius = np.linalg.norm(p - [0, 0, 1.0], axis=1)
    assert len(p) > 100 and np.median(abs(radius - 0.4)) < FINE.voxel_size


def test_a_point_and_its_corners_are_one_lookup(monkeypatch):
    g = np.array([(x, y, z) for x in range(3) for y in range(3) for z in range(3)])
    vox = pa.table({**{c: g[:, k] for k, c in enumerate(("gx", "gy", "gz"))}, "sdf": g @ [0.1, 0.2, 0.4], "weight": np.ones(27, np.int32),
                    **{c: np.full(27, 7) for c in "rgb"}})
    field, asked, read = voxelray._Field(vox, 0.5), [], voxelray._Field.read
    monkeypatch.setattr(voxelray._Field, "read", lambda self, p: asked.append(len(p)) or read(self, p))
    at = np.array([[0.5, 0.6, 0.4], [0.55, 0.45, 0.5], [9.0, 9.0, 9.0]])
    got = field.sample(at)
    assert asked == [27]
    for p, row in zip(at, got):
        centre, f, acc = field.read(p[None])[0], p / 0.5 - np.floor(p / 0.5), np.zeros(5)
        for o in np.ndindex(2, 2, 2):
            v = field.read((p + (np.array(o) - 0.5) * 0.5)[None])[0]
            acc += np.prod(np.where(np.array(o) == 1, f, 1 - f)) * (v if v[1] else centre)
        acc[1] = centre[1]
        assert np.array_equal(row, acc if centre[1] else np.zeros(5))
    assert got[0, 0] and not got[2].any()


def test_rendered_depth_matches_brute_force(spark, sphere):
    _, _, vox = sphere
    pose = np.eye(4)
    pose[:3, 3] = (0.011, 0.007, 0.003)
    small = Sensor(rows=20, cols=24, fx=25.0, fy=25.0, cx=11.5, cy=9.5)
    got = voxelray.render(vox, pose, small, FINE).toPandas().sort_values("idx")
    field = {(r["gx"], r["gy"], r["gz"]): r for r in vox.collect()}
    h = FINE.voxel_size

    def key(p):
        return tuple(int(math.floor(abs(c / h) + 0.5) * np.sign(c)) for c in p)

    def sample(p):
        c = field.get(key(p))
        if c is None:
            return None
        f = p / h - np.floor(p / h)
        total = 0.0
        for o in np.ndindex(2, 2, 2):
            o = np.array(o)
            n = field.get(key(p + (o - 0.5) * h), c)
            total += np.prod(np.where(o == 1, f, 1 - f)) * n["sdf"]
        return total
    for idx, depth in zip(got["idx"], got["depth"]):
        d = 0.0
        while d < FINE.max_depth:
            u, v = idx % small.cols, idx // small.cols
            p = np.array([(u - small.cx) * d / small.fx, (v - small.cy) * d / small.fy, d]) + pose[:3, 3]
            s = sample(p)
            d += FINE.truncation if s is None else s
            if s is not None and s < h:
                break
        assert abs(d - depth) < 1e-9


def _same_map(a, b):
    key = ["gx", "gy", "gz", "weight", "r", "g", "b"]
    a, b = (d.select(*key, F.round("sdf", 9).alias("sdf")) for d in (a, b))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_stream_equals_batch(spark, sphere, tmp_path):
    """Frames cut in two by files, rows that come a file late, repeated rows, a file of rows that come too late."""
    pix, poses, vox = sphere
    rows = pix.withColumn("ts", F.timestamp_seconds(F.col("frame_id") + 1))
    half = F.col("idx") % 3
    parts = [rows.filter((F.col("frame_id") == 0) & (half != 0)),
             rows.filter((F.col("frame_id") == 0) & (half == 0) | (F.col("frame_id") == 1) & (half == 0)),
             rows.filter((F.col("frame_id") == 1) & (half < 2)),  # a third of it again
             rows.filter((F.col("frame_id") == 1) & (half == 2) | (F.col("frame_id") == 2)),
             spark.range(1).select(F.timestamp_seconds(F.lit(100)).alias("ts")),
             rows.filter((F.col("frame_id") == 0) & (half == 1)).withColumn("depth", F.col("depth") / 2)]
    for part in parts:
        rows.limit(0).unionByName(part, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    versions = []
    store = tracking.MapStore(str(tmp_path / "map"), full=2)  # full versions and changes both
    tracking.fuse_stream(stream, poses, S, FINE, store, str(tmp_path / "ck"), versions.append, delay="1 second").awaitTermination()
    assert versions == list(range(versions[-1] + 1)) and versions[-1] >= 5
    assert _same_map(store.read(spark, "voxels", versions[-1]), vox)


def test_store_keeps_what_later_versions_leave(spark, tmp_path):
    store = tracking.MapStore(str(tmp_path), full=3)
    for version in range(5):
        rows = [(0, 0, version, version)] + ([(9, 9, 9, version)] if version == 1 else [])
        store.write(spark.createDataFrame(rows, "bx long, by long, bz long, born long"), "blocks", version)
    got = {tuple(r) for r in store.read(spark, "blocks", 4).collect()}
    assert got == {(0, 0, v, v) for v in range(5)} | {(9, 9, 9, 1)}
    assert {tuple(r) for r in store.read(spark, "blocks", 2).collect()} == {(0, 0, 0, 0), (0, 0, 1, 1), (0, 0, 2, 2), (9, 9, 9, 1)}


def test_ray_depth_of_triangles_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    tri = rng.uniform(-1, 1, (12, 3, 3))
    tri[:, :, 2] -= 1.5
    tri[0, :, 2] += 3.0      # behind the camera
    tri[1, 0, 2] = 2.0       # across the camera plane
    cols = [f"p{k}{a}" for k in range(3) for a in "xyz"]
    pdf = pd.DataFrame(tri.reshape(-1, 9), columns=cols)
    pdf.insert(0, "fid", np.arange(12))
    s = Sensor(rows=12, cols=16)
    got = dict(raster.nearest_hits(spark.createDataFrame(pdf), s, np.eye(4)).select("idx", "t").collect())
    k = math.tan(math.radians(29))
    for idx in range(s.rows * s.cols):
        u, v = idx % s.cols, idx // s.cols
        d = np.array([(2 * (u + 1) / s.cols - 1) * s.cols / s.rows * k, (1 - 2 * (v + 1) / s.rows) * k, -1.0])
        d /= np.linalg.norm(d)
        ts = []
        for a, b, c in tri:
            e1, e2 = b - a, c - a
            p = np.cross(d, e2)
            det = e1 @ p
            if abs(det) < 1e-8:
                continue
            q = np.cross(-a, e1)
            x, y, t = -a @ p / det, d @ q / det, e2 @ q / det
            if 0 <= x <= 1 and y >= 0 and x + y <= 1:
                ts.append(t)
        assert (idx in got) == bool(ts)
        if ts:
            assert abs(got[idx] - min(ts)) < 1e-9


def _tracked_alone(pixels, frames, tracking_cfg):
    """One sequence as a plain loop: render, align, merge."""
    pose, out, voxels, blocks = np.eye(4), [], None, None
    spark = pixels.sparkSession
    for fid in frames:
        frame = pixels.filter(F.col("frame_id") == fid)
        if voxels is not None:
            seen = voxelray.generate_depth(voxels, pose, S, FINE).filter(F.col("depth") < FINE.max_depth)
            model = seen.select(F.lit(fid).cast("long").alias("frame_id"), "idx", (F.col("idx") % S.cols).alias("u"), F.expr(f"idx div {S.cols}").alias("v"), "depth")
            row = rigid.register(frame, model, S, tracking_cfg).select(*rigid.POSE).first()
            pose = pose @ np.vstack([np.array(row, dtype=float).reshape(3, 4), [0, 0, 0, 1]])
        out.append(pose)
        m = spark.createDataFrame([(int(fid), *map(float, pose[:3].reshape(12)))], "frame_id long, " + ", ".join(f"{c} double" for c in rigid.POSE))
        voxels, blocks = (cut(d) for d in tracking.integrate(frame, rigid.poses_of(m), S, FINE, voxels, blocks))
    return out, voxels


def test_track_to_model_keeps_sequences_apart(spark, sphere):
    """Two sequences together, one of them with a gap, equal each of them alone."""
    from voxweave.config import Rigid
    pix, _, _ = sphere
    steps = Rigid(iterations=(0, 0, 1))
    plan = {0: {0: 0, 1: 1}, 1: {1: 2}}  # sequence: step: frame
    rows = None
    for seq, frames in plan.items():
        for step, fid in frames.items():
            part = pix.filter(F.col("frame_id") == fid).withColumns({"seq": F.lit(seq), "step": F.lit(step)}).drop("frame_id")
            rows = part if rows is None else rows.unionByName(part)
    poses, maps = tracking.track_to_model(rows, S, steps, FINE, full=2)
    got = {(r["seq"], r["step"]): np.array([r[c] for c in rigid.POSE]).reshape(3, 4) for r in poses.collect()}
    assert sorted(got) == [(q, k) for q, frames in plan.items() for k in frames]
    for seq, frames in plan.items():
        want, voxels = _tracked_alone(pix, list(frames.values()), steps)
        assert all(np.abs(got[seq, step] - pose[:3]).max() < 1e-9 for step, pose in zip(frames, want))
        assert _same_map(maps.filter(F.col("seq") == seq), voxels)


def test_compress_keeps_shape(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 0.0, 0.0), (4, 0.0, 1.0, 0.0), (5, 1.0, 1.0, 0.0)],
                              "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 5, 4)], "fid long, v0 long, v1 long, v2 long")
    kept, faces = mesh.compress(v, f)
    assert sorted(map(tuple, faces.collect())) == [(0, 0, 1, 2), (1, 1, 3, 2)]
    assert kept.count() == 4


def test_merge_moves_observations_once(spark):
    """One exchange by voxel: chunks, their level maps and their composition stay where the observations are."""
    from voxweave.config import Tsdf
    from voxweave.operators import voxels
    rows = [(f, v % 3, v, 0, 0.01 * (f % 7) - 0.02, (f * v) % 256, f % 256, 255 - f % 256) for f in range(40) for v in range(6)]
    obs = spark.createDataFrame(rows, "frame_id long, gx long, gy long, gz long, sdf double, r long, g long, b long")
    got = voxels.fold_chunked(obs, Tsdf(), chunk=4, fan=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    near = lambda df: sorted((*r[:3], round(r["sdf"], 9), *r[4:]) for r in df.collect())
    assert near(got) == near(voxels.fold(obs, Tsdf()))


@pytest.mark.parametrize("parts", [1, 5])
def test_running_fold_scans_one_row_at_a_time(spark, parts):
    """The sequential fold over batches of a few rows, with a prior, and without an array that grows with the frames."""
    rows = observations(60, 3)
    df = spark.createDataFrame(rows, OBS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = vx.merge(df.filter("frame_id >= 25").repartition(parts), CFG, vx.merge(df.filter("frame_id < 25"), CFG))
        assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = sequential(rows, CFG.max_weight)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - s) < 1e-12 and got[k][1:] == (w, *c) for k, (s, w, c) in want.items())


def test_observations_make_no_row_per_voxel_of_a_block(spark):
    """Only voxels that see a pixel are rows; a pixel or a pose that is there twice counts twice, one without a place not."""
    s = Sensor(rows=8, cols=8, fx=8.0, fy=8.0, cx=3.5, cy=3.5)
    cfg = Tsdf(voxel_size=0.1, block_size=4, truncation=0.3)
    pix = "frame_id long, idx long, u long, v long, depth double, r long, g long, b long"
    one = [(0, i, i % 8, i // 8, 1.0, i, 2, None) for i in range(64)]
    poses = [(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    pose = "frame_id long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"

    def seen(pixels, poses, pairs=((0, 0, 0, 2), (0, 0, 0, 1), (0, -1, -1, 1), (0, 40, 0, 1), (None, 0, 0, 1))):
        p = spark.createDataFrame(list(pairs), "frame_id long, bx long, by long, bz long")
        df = vx.observations(p, spark.createDataFrame(pixels, pix), spark.createDataFrame(poses, pose), s, cfg)
        assert "Generate explode" not in df._jdf.queryExecution().executedPlan().toString()
        return sorted(tuple(r) for r in df.drop("b").collect())
    want = []
    for bx, by, bz in ((0, 0, 2), (0, 0, 1), (-1, -1, 1)):
        # The middle of the corner voxel of a block must fall into the image.
        mid = [c * 0.4 + 0.2 for c in (bx, by, bz)]
        if not all(-0.5 < 8 * c / mid[2] + 3.5 < 7.5 for c in mid[:2]):
            continue
        for x, y, z in np.ndindex(4, 4, 4):
            g = (bx * 4 + x, by * 4 + y, bz * 4 + z)
            p = [c * 0.1 for c in g]
            u, v = (8 * c / p[2] + 3.5 for c in p[:2])
            if not (-0.5 < u < 7.5 and -0.5 < v < 7.5):
                continue
            u, v = math.floor(u + 0.5), math.floor(v + 0.5)
            sd = math.sqrt(((u - 3.5) / 8) ** 2 + ((v - 3.5) / 8) ** 2 + 1)
            gap = sd - math.sqrt(sum(c * c for c in p))
            if gap > -0.3:
                want.append((0, *g, min(gap, 0.3), v * 8 + u, 2))
    got = seen(one, poses)
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in sorted(want)] and got
    assert np.allclose([r[4] for r in got], [r[4] for r in sorted(want)])
    assert len(seen(one + one, poses)) == 2 * len(got) == len(seen(one, poses + poses))
    assert seen([(None, *r[1:]) for r in one], poses) == [] == seen([(*r[:4], None, *r[5:]) for r in one], poses)


def test_batches_of_a_stream_are_planned_by_their_size(spark, tmp_path, monkeypatch):
    """The map is merged in the stream's session: that of a batch has adaptive execution off, 200 tasks for any exchange."""
    s = Sensor(rows=2, cols=2, fx=2.0, fy=2.0, cx=0.5, cy=0.5)
    pix = spark.range(8).selectExpr("id div 4 AS frame_id", "id % 4 AS idx", "id % 2 AS u", "id % 4 div 2 AS v", "1.0D AS depth",
                                    "id AS r", "id AS g", "id AS b", "timestamp_seconds(id div 4 + 1) AS ts")
    end = spark.range(1).selectExpr("CAST(NULL AS LONG) AS frame_id", *[f"CAST(NULL AS {k}) AS {c}" for c, k in (
        ("idx", "LONG"), ("u", "LONG"), ("v", "LONG"), ("depth", "DOUBLE"), ("r", "LONG"), ("g", "LONG"), ("b", "LONG"))], "timestamp_seconds(100) AS ts")
    pix.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    poses = spark.range(2).selectExpr("id AS frame_id", *[f"0.0D AS {c}" for c in ("tx", "ty", "tz", "qx", "qy", "qz")], "1.0D AS qw")
    adaptive, own = [], tracking.integrate

    def watched(pixels, *rest, **options):
        adaptive.append(pixels.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return own(pixels, *rest, **options)
    monkeypatch.setattr(tracking, "integrate", watched)
    store, done = tracking.MapStore(str(tmp_path / "map")), []
    tracking.fuse_stream(spark.readStream.schema(pix.schema).parquet(str(tmp_path / "in")), poses, s, CFG, store, str(tmp_path / "at"), done.append,
                         delay="10 seconds").awaitTermination()
    assert adaptive and set(adaptive) == {"true"}
    assert sorted(map(tuple, store.read(spark, "voxels", done[-1]).collect())) == sorted(map(tuple, vx.fuse(pix.drop("ts"), poses, s, CFG).collect()))
