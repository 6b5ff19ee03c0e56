"""Frame folders: listing, association files, ground truth, PNG images to pixel rows."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Sensor
from ..runtime import with_running
from .text import is_content, numbers, words

PIXEL_SCHEMA = "frame_id long, idx long, u long, v long, depth double, r long, g long, b long"


def list_files(spark: SparkSession, folder: str, suffix: str = ".png") -> DataFrame:
    """path of each file of the folder; the content column is never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
            .select("path"))


def frame_index(paths: DataFrame, suffix: str = ".png", prefix: str = "") -> DataFrame:
    """(frame_id, path, ts): files in the order of their numeric stem, numbered from 0."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_extract(name, f"^{prefix}(.*){suffix.replace('.', chr(92) + '.')}$", 1)
    df = paths.select("path", stem.try_cast("double").alias("ts")).filter("ts is not null")
    return with_running(df, ["ts", "path"], ordinal="frame_id").select("frame_id", "path", "ts")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with the 0-based line number. Blocks of a file may be read in any order,
    so lines are ranked by their block's offset first."""
    df = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"),
                                      F.col("_metadata.file_block_start").alias("_b"))
    df = df.withColumn("_m", F.monotonically_increasing_id())
    return with_running(df, ["_f", "_b", "_m"], ordinal="line").select("line", "value")


def associations(lines: DataFrame) -> DataFrame:
    """(line, depth, rgb) from lines whose first word is the depth and third the rgb stem."""
    w = words(F.col("value"))
    return lines.filter(is_content(F.col("value"))).select(
        "line", F.get(w, 0).alias("depth"), F.get(w, 2).alias("rgb"))


def ground_truth(lines: DataFrame) -> DataFrame:
    """(line, ts, tx..tz, qx..qw) from the content lines, numbered anew from 0."""
    n = numbers(F.col("value"))
    names = ("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
    kept = lines.filter(is_content(F.col("value"))).select(
        F.col("line").alias("_l"), *[F.get(n, i).alias(c) for i, c in enumerate(names)])
    return with_running(kept, ["_l"], ordinal="line").select("line", *names)


def pair_by_position(frames: DataFrame, truth: DataFrame, offset: int = 0) -> DataFrame:
    """Frame i with ground-truth line i + offset."""
    t = truth.withColumn("frame_id", F.col("line") - offset).drop("line", "ts")
    return frames.join(t, "frame_id")


# Samples per pixel by PNG colour type; fixed values
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Non-interlaced 8- or 16-bit PNG as an array (rows, cols, channels)."""
    pos, body, head = 8, [], None
    while pos < len(data):
        size, kind = struct.unpack(">I4s", data[pos:pos + 8])
        chunk = data[pos + 8:pos + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        pos += 12 + size
    if head is None or head[3] not in _CHANNELS or head[2] not in (8, 16) or head[6]:
        raise ValueError("unsupported PNG layout")
    cols, rows, depth, ch = head[0], head[1], head[2], _CHANNELS[head[3]]
    step = ch * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, cols * step + 1)
    out = _unfiltered(raw[:, 0], raw[:, 1:].reshape(rows, cols, step))
    kind = ">u2" if depth == 16 else np.uint8
    return out.reshape(-1).view(kind).reshape(rows, cols, ch).astype(np.uint16 if depth == 16 else np.uint8)


def _guess(mode: np.ndarray, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a row's filter (0 to 4) predicts for samples from those beside, above and before the one above."""
    est = left + up - corner
    dl, du, dc = abs(est - left), abs(est - up), abs(est - corner)
    nearest = np.where((dl <= du) & (dl <= dc), left, np.where(du <= dc, up, corner))
    return np.choose(mode, [np.zeros_like(left), left, up, (left + up) >> 1, nearest])


def _unfiltered(modes: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """Samples (rows, cols, bytes of a pixel) from what the filters left. Pixels on a diagonal do not depend on each
    other, so that a step takes one from every row."""
    rows, cols, step = coded.shape
    if not modes.any():
        return np.ascontiguousarray(coded)
    if modes.max() > 4:
        raise ValueError("unknown PNG row filter")
    full, coded = np.zeros((rows + 1, cols + 1, step), np.int16), coded.astype(np.int16)
    for k in range(rows + cols - 1):
        y = np.arange(max(0, k - cols + 1), min(rows, k + 1))
        x = k - y
        guess = _guess(modes[y][:, None], full[y + 1, x], full[y, x + 1], full[y, x])
        full[y + 1, x + 1] = (coded[y, x] + guess) & 255
    return full[1:, 1:].astype(np.uint8)


def encode_png(image: np.ndarray, modes: tuple[int, ...] = (0,)) -> bytes:
    """PNG of a (rows, cols[, 3]) uint8 or uint16 array; row y is filtered by ``modes[y % len(modes)]``."""
    image = image[:, :, None] if image.ndim == 2 else image
    rows, cols, ch = image.shape
    deep = image.dtype == np.uint16
    lines = image.astype(">u2" if deep else np.uint8).reshape(rows, -1).view(np.uint8).reshape(rows, cols, -1)
    mode = np.resize(np.array(modes, np.uint8), rows)
    full = np.zeros((rows + 1, cols + 1, lines.shape[2]), np.int16)
    full[1:, 1:] = lines
    left = lines - _guess(mode[:, None, None], full[1:, :-1], full[:-1, 1:], full[:-1, :-1])
    raw = np.c_[mode, (left & 255).astype(np.uint8).reshape(rows, -1)].tobytes()

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", cols, rows, 16 if deep else 8, 0 if ch == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_pixels(spark: SparkSession, frames: DataFrame, s: Sensor, depth_folder: str,
                rgb_folder: str) -> DataFrame:
    """Pixel rows of (frame_id, depth_path, rgb_path): metres from the 16-bit depth image and
    8-bit colour. Files are decoded where they are read, one image pair at a time."""
    def load(folder, name):
        f = spark.read.format("binaryFile").load(folder).select(F.col("path").alias(f"{name}_path"),
                                                                F.col("content").alias(name))
        return frames.select("frame_id", f"{name}_path").join(f, f"{name}_path").select("frame_id", name)
    pairs = load(depth_folder, "depth").join(load(rgb_folder, "rgb"), "frame_id")
    scale, cols = s.depth_scale, s.cols

    def decode(batches):
        for b in batches:
            for fid, d, c in zip(b["frame_id"], b["depth"], b["rgb"]):
                depth, rgb = decode_png(bytes(d))[:, :, 0], decode_png(bytes(c))[:, :, :3]
                idx = np.arange(depth.size)
                flat = rgb.reshape(-1, 3).astype(np.int64)
                yield pd.DataFrame({"frame_id": fid, "idx": idx, "u": idx % cols, "v": idx // cols,
                                    "depth": depth.reshape(-1) / scale, "r": flat[:, 0],
                                    "g": flat[:, 1], "b": flat[:, 2]})
    return pairs.mapInPandas(decode, PIXEL_SCHEMA)


def load_dataset(spark: SparkSession, root: str, association: str | None = None) -> DataFrame:
    """(frame_id, depth_path, rgb_path) of a folder with depth/ and rgb/, matched by an
    association file or else by position."""
    depth = frame_index(list_files(spark, os.path.join(root, "depth")))
    rgb = frame_index(list_files(spark, os.path.join(root, "rgb")))
    if association is None:
        d = depth.select("frame_id", F.col("path").alias("depth_path"))
        return d.join(rgb.select("frame_id", F.col("path").alias("rgb_path")), "frame_id")
    a = associations(ordered_lines(spark, association)).select(
        F.col("depth").cast("double").alias("dts"), F.col("rgb").cast("double").alias("rts"), "line")
    d = depth.select(F.col("ts").alias("dts"), F.col("path").alias("depth_path"))
    r = rgb.select(F.col("ts").alias("rts"), F.col("path").alias("rgb_path"))
    j = a.join(d, "dts").join(r, "rts")
    return with_running(j, ["line"], ordinal="frame_id").select("frame_id", "depth_path", "rgb_path")


def read_folder(spark: SparkSession, root: str, s: Sensor, association: str | None = None) -> DataFrame:
    """Pixel rows of a folder of frames: listed, paired (see :func:`load_dataset`) and decoded."""
    depth, rgb = (os.path.join(root, kind) for kind in ("depth", "rgb"))
    return read_pixels(spark, load_dataset(spark, root, association), s, depth, rgb)
