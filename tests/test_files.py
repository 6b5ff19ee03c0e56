import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxweave.config import Sensor, Tsdf, from_mapping
from voxweave.functions.dualquat import DualQuat
from voxweave.functions.vec import V3
from voxweave.operators import raster
from voxweave.runtime import with_running
from voxweave.sinks import images, text
from voxweave.sources import frames, obj, shapes
from voxweave.sources.parameters import read_parameters
from voxweave.streaming import sync


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_round_trip(kind):
    a = np.random.default_rng(0).integers(0, np.iinfo(kind).max, (7, 9)).astype(kind)
    assert (frames.decode_png(frames.encode_png(a))[:, :, 0] == a).all()
    rgb = np.random.default_rng(1).integers(0, 255, (5, 4, 3)).astype(np.uint8)
    assert (frames.decode_png(frames.encode_png(rgb)) == rgb).all()


def test_png_filters():
    """Each row filter is undone."""
    import struct
    import zlib
    img = np.random.default_rng(2).integers(0, 255, (5, 6)).astype(np.int64)
    rows = []
    for y in range(5):
        prev = img[y - 1] if y else np.zeros(6, np.int64)
        left = np.concatenate([[0], img[y, :-1]])
        corner = np.concatenate([[0], prev[:-1]])
        est = left + prev - corner
        d = [abs(est - left), abs(est - prev), abs(est - corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], prev, corner))
        guess = [0, left, prev, (left + prev) // 2, paeth][y]
        rows.append(bytes([y]) + ((img[y] - guess) % 256).astype(np.uint8).tobytes())

    def chunk(k, b):
        return struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + \
        chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (frames.decode_png(png)[:, :, 0] == img).all()


@pytest.mark.parametrize("kind,shape", [(np.uint8, (7, 9)), (np.uint16, (6, 4)), (np.uint8, (5, 3, 3)), (np.uint16, (1, 6)), (np.uint8, (6, 1, 3))])
@pytest.mark.parametrize("modes", [(1,), (2,), (3,), (4,), (4, 0, 3, 1, 2)])
def test_filtered_png_round_trip(kind, shape, modes):
    a = np.random.default_rng(4).integers(0, np.iinfo(kind).max, shape).astype(kind)
    assert (frames.decode_png(frames.encode_png(a, modes)).reshape(shape) == a).all()


def test_large_filtered_png_in_bounded_time():
    import time
    a = np.random.default_rng(5).integers(0, 65535, (480, 640)).astype(np.uint16)
    png = frames.encode_png(a, (3, 4))
    began = time.perf_counter()
    assert (frames.decode_png(png)[:, :, 0] == a).all()
    assert time.perf_counter() - began < 3  # some 600,000 bytes


def test_write_folder_refuses_remote_roots(spark):
    with pytest.raises(ValueError, match="mounted"):
        images.write_folder(spark.range(0), "hdfs://x/y", Sensor())


def test_dataset_folder(spark, tmp_path):
    s = Sensor(rows=4, cols=5, depth_scale=5000.0)
    rng = np.random.default_rng(3)
    for kind in ("depth", "rgb"):
        os.makedirs(tmp_path / kind)
    want = {}
    for n, stem in enumerate(["2.5", "10.25", "1.0"]):
        d = rng.integers(0, 9999, (4, 5)).astype(np.uint16)
        (tmp_path / "depth" / f"{stem}.png").write_bytes(frames.encode_png(d))
        (tmp_path / "rgb" / f"{stem}.png").write_bytes(frames.encode_png(rng.integers(0, 255, (4, 5, 3)).astype(np.uint8)))
        want[stem] = d
    (tmp_path / "assoc.txt").write_text("# c\n10.25 depth/10.25.png 10.25 rgb\n1.0  x 1.0 y\n")
    ds = frames.load_dataset(spark, str(tmp_path))
    pix = frames.read_pixels(spark, ds, s, str(tmp_path / "depth"), str(tmp_path / "rgb")).toPandas()
    for fid, stem in enumerate(["1.0", "2.5", "10.25"]):
        got = pix[pix.frame_id == fid].sort_values("idx")["depth"].to_numpy()
        assert np.allclose(got, want[stem].reshape(-1) / 5000.0)
    paired = frames.load_dataset(spark, str(tmp_path), str(tmp_path / "assoc.txt")).orderBy("frame_id").collect()
    assert [os.path.basename(r["depth_path"]) for r in paired] == ["10.25.png", "1.0.png"]


def test_obj_file_round_trip(spark, tmp_path):
    v, f = shapes.uv_sphere(spark, 1.0, 8)
    path = str(tmp_path / "ball.obj")
    text.write_lines(text.obj_lines(v, f.withColumn("fid", F.col("fid"))), path)
    m = obj.read(spark, path)
    a = {r["vid"]: (r["x"], r["y"], r["z"]) for r in v.collect()}
    b = {r["vid"]: (r["x"], r["y"], r["z"]) for r in m["vertices"].collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)
    assert {tuple(r) for r in f.select("v0", "v1", "v2").collect()} == {tuple(r) for r in m["faces"].select("v0", "v1", "v2").collect()}
    with pytest.raises(ValueError):
        obj.read(spark, "mesh.ply")


def test_obj_face_forms(spark, tmp_path):
    p = tmp_path / "m.obj"
    p.write_text("# x\nv 0 0 0\nv 1 0 0 0.1 0.2 0.3\nvt 0.5 0.5\nv 0 1 0\nvn 0 0 1\nf 1 2 3\nf 1//1 2//1 3//1\nf 1/1/1 2/1/1 3/1/1\n")
    m = obj.read(spark, str(p))
    rows = m["faces"].orderBy("fid").collect()
    assert [tuple(r[c] for c in ("v0", "v1", "v2")) for r in rows] == [(0, 1, 2)] * 3
    assert [r["n0"] for r in rows] == [None, 0, 0] and [r["t0"] for r in rows] == [None, None, 0]
    assert m["vertices"].filter("vid = 1").first()["g"] == 0.2 and m["vertices"].count() == 3


def test_running_counts(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    r = with_running(df, ["k"], ordinal="n", sums={"s": F.col("k")}).collect()
    assert all(x["n"] == x["k"] and x["s"] == x["k"] * (x["k"] + 1) // 2 for x in r)


def test_parameters(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("tsdf:\n  voxel_size: 0.02 # m\n  block_size: 4\nname: \"x\"\nflag: true\n")
    d = read_parameters(str(p))
    assert d == {"voxel_size": 0.02, "block_size": 4, "name": "x", "flag": True}
    assert from_mapping(Tsdf, d).voxel_size == 0.02


def test_sphere_faces_outward_and_closed(spark):
    v, f = shapes.uv_sphere(spark, 2.0, 6)
    edges = {}
    for r in f.collect():
        for e in ((r["v0"], r["v1"]), (r["v1"], r["v2"]), (r["v2"], r["v0"])):
            edges[e] = edges.get(e, 0) + 1
    assert all(edges.get((b, a)) == 1 for a, b in edges)


def test_nearest_with_one_hot_key_equals_brute_force(spark):
    """Most rows share a key; slices of several widths, gaps wider than the slop, ties."""
    rng = np.random.default_rng(9)
    side = {n: [(0 if rng.random() < 0.8 else int(rng.integers(1, 4)), i, int(rng.integers(0, 3000))) for i in range(150)] for n in "lr"}
    frames = {n: spark.createDataFrame(v, "k long, id long, stamp long") for n, v in side.items()}
    for slop, width in ((40, None), (7, 3), (5, 100)):
        want = set()
        for k, i, at in side["l"]:
            near = [(abs(t - at), t, j) for key, j, t in side["r"] if key == k and abs(t - at) <= slop]
            if near:
                gap, _, j = min(near)
                want.add((k, i, j, gap))
        assert {tuple(r) for r in sync.nearest(frames["l"], frames["r"], "k", slop, width).collect()} == want


def test_nearest_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = 1_700_000_000

    def topic(n, first):
        return [(int(rng.integers(0, 3)), first + i, float(base + rng.uniform(0, 3000))) for i in range(n)]
    schema = "k long, id long, sec double"
    sides = {}
    for name, first in (("l", 0), ("r", 1000)):
        d = spark.createDataFrame(topic(60, first), schema).select("k", "id", F.timestamp_micros((F.col("sec") * 1e6).cast("long")).alias("ts"))
        end = spark.createDataFrame([(9, first + 999, float(base + 100000))], schema).select("k", "id", F.timestamp_micros((F.col("sec") * 1e6).cast("long")).alias("ts"))
        d.coalesce(1).write.parquet(str(tmp_path / name / "a"))
        end.coalesce(1).write.parquet(str(tmp_path / name / "b"))
        sides[name] = d
    stamped = {n: d.select("k", "id", F.unix_micros("ts").alias("stamp")) for n, d in sides.items()}
    slop = 60_000_000
    batch = {tuple(r) for r in sync.nearest(stamped["l"], stamped["r"], "k", slop).select("left_id", "right_id").collect()}
    brute = set()
    for a in stamped["l"].collect():
        c = sorted((abs(b["stamp"] - a["stamp"]), b["stamp"], b["id"]) for b in stamped["r"].collect() if b["k"] == a["k"])
        if c and c[0][0] <= slop:
            brute.add((a["id"], c[0][2]))
    assert batch == brute

    def stream(n):
        return spark.readStream.schema(sides[n].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n / "*"))
    out = sync.nearest_streams(stream("l"), stream("r"), "k", "60 seconds", "60 seconds")
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("k < 9").select("left_id", "right_id").collect()}
    assert got == batch


def test_literals_of_the_transform_examples(spark):
    d = DualQuat.from_euler(F.lit(0.1), F.lit(0.0), F.lit(0.35), V3.lit(10, 0, -2))
    r = spark.range(1).select(*d.named()).select(*DualQuat.of().translation().named("t"), *DualQuat.of().euler().named("e")).first()
    assert np.allclose([r["tx"], r["ty"], r["tz"], r["ex"], r["ey"], r["ez"]], [10, 0, -2, 0.1, 0, 0.35])
    d = DualQuat.from_euler(F.lit(0.0), F.lit(0.0), F.lit(0.0), V3.lit(10, 10, 10))
    p = spark.range(1).select(*d.transform_position(V3.lit(1, 1, 1)).named()).first()
    assert tuple(p) == (11.0, 11.0, 11.0)


def test_screen_window_fits():
    left, right, bottom, top = raster.screen_window(0.98, 0.735, 640, 480, 1.0, 20.0)
    assert np.isclose(right, 0.98 * 25.4 / 40) and np.isclose(top, 0.735 * 25.4 / 40) and left == -right and bottom == -top


def test_images(spark):
    df = spark.createDataFrame([(0, i, 0.1 * i, i, 2 * i, 3 * i) for i in range(6)], "frame_id long, idx long, depth double, r long, g long, b long")
    r = images.image_arrays(images.swap_red_blue(df), "r").first()
    assert r["r"] == [3 * i for i in range(6)]
    png = images.png_images(df, Sensor(rows=2, cols=3)).first()
    assert (frames.decode_png(bytes(png["rgb_png"]))[1, 2] == [5, 10, 15]).all()
