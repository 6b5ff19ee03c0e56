"""Pixel rows back to images, one row per frame."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Sensor
from ..sources.frames import encode_png


def image_arrays(pixels: DataFrame, value: str = "depth") -> DataFrame:
    """(frame_id, value array in index order); a frame has at most rows x cols pixels."""
    g = pixels.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("idx", value))).alias("_p"))
    return g.select("frame_id", F.col(f"_p.{value}").alias(value))


def swap_red_blue(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"r": F.col("b"), "b": F.col("r")})


def png_images(pixels: DataFrame, s: Sensor, modes: tuple[int, ...] = (0,)) -> DataFrame:
    """(frame_id, depth_png, rgb_png), 16-bit depth in sensor units and 8-bit colour; ``modes`` are row filters."""
    g = pixels.groupBy("frame_id").agg(F.collect_list(F.struct("idx", "depth", "r", "g", "b")).alias("p"))
    flat = g.select("frame_id", *[F.col(f"p.{c}").alias(c) for c in ("idx", "depth", "r", "g", "b")])
    rows, cols, scale = s.rows, s.cols, s.depth_scale

    def encode(batches):
        for b in batches:
            depths, colours = [], []
            for idx, depth, *rgb in zip(*[b[c] for c in ("idx", "depth", "r", "g", "b")]):
                d, c = np.zeros(rows * cols, np.uint16), np.zeros((rows * cols, 3), np.uint8)
                d[idx] = np.clip(np.floor(depth * scale + 0.5), 0, 65535)
                c[idx] = np.stack(rgb, axis=1)
                depths.append(encode_png(d.reshape(rows, cols), modes)), colours.append(encode_png(c.reshape(rows, cols, 3), modes))
            yield pd.DataFrame({"frame_id": b["frame_id"], "depth_png": depths, "rgb_png": colours})
    return flat.mapInPandas(encode, "frame_id long, depth_png binary, rgb_png binary")


def write_folder(pixels: DataFrame, root: str, s: Sensor, modes: tuple[int, ...] = (0,)) -> None:
    """Write depth/<stem>.png and rgb/<stem>.png of pixel rows with a ``ts``: the stem is the frame's time. Spark has no
    sink of single files, so tasks write to ``root``, a folder mounted on every machine; each file appears whole or not
    at all, and a repeated task writes the same ones."""
    at = urlparse(root)
    if at.scheme not in ("", "file"):
        raise ValueError("frame folders are written to a mounted folder")
    folders = {k: os.path.join(at.path, k) for k in ("depth", "rgb")}
    for f in folders.values():
        os.makedirs(f, exist_ok=True)
    stems = pixels.groupBy("frame_id").agg(F.min("ts").alias("ts"))
    images = png_images(pixels, s, modes).join(stems, "frame_id").select(F.format_string("%.6f", "ts").alias("stem"), "depth_png", "rgb_png")

    def save(rows):
        for r in rows:
            for kind, folder in folders.items():
                part = os.path.join(folder, f".{r['stem']}-{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(r[f"{kind}_png"])
                os.replace(part, os.path.join(folder, f"{r['stem']}.png"))
    images.foreachPartition(save)
