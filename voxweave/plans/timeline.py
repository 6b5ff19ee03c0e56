"""Time and streaming queries (STR)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.vec import clean
from ..operators import pixels as px
from ..operators import voxels as vx
from ..runtime import ensure_checkpoint_dir
from ..streaming import evaluate, sync, tracking
from . import tables as t
from .registry import query
from .voxel import FUSED_POSED

HOUR = 3600 * 1000000
STREAM_FILES = 4
_TOPICS = """l AS (SELECT user_id, event_id AS id, epoch_us(ts) AS stamp FROM events WHERE event_type = 'click'),
  r AS (SELECT user_id, event_id AS id, epoch_us(ts) AS stamp FROM events WHERE event_type = 'view')"""


def _topic(spark, sf, kind):
    e = t.read(spark, sf, "events").filter(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp"))


@query("str4_nearest_in_time", f"""WITH {_TOPICS}, p AS (SELECT l.user_id, l.id AS left_id, r.id AS right_id, abs(r.stamp - l.stamp) AS gap, r.stamp AS rs
  FROM l JOIN r ON l.user_id = r.user_id AND abs(r.stamp - l.stamp) <= {HOUR}),
  k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY gap, rs, right_id) AS n FROM p)
SELECT user_id, left_id, right_id, gap FROM k WHERE n = 1""")
def str4(spark, sf):
    return sync.nearest(_topic(spark, sf, "click"), _topic(spark, sf, "view"), "user_id", HOUR)


@query("str5_exact_time", f"""WITH {_TOPICS}, a AS (SELECT user_id, stamp // {HOUR} AS stamp, min(id) AS left_id FROM l GROUP BY 1, 2),
b AS (SELECT user_id, stamp // {HOUR} AS stamp, min(id) AS right_id FROM r GROUP BY 1, 2) SELECT user_id, stamp, left_id, right_id FROM a JOIN b USING (user_id, stamp)""")
def str5(spark, sf):
    """Stamps cut to the hour, so that there are equal ones."""
    hour = F.floor(F.col("stamp") / HOUR)
    l, r = (_topic(spark, sf, k).withColumn("stamp", hour) for k in ("click", "view"))
    return sync.exact(l, r, "user_id")


_TRUE = "g AS (SELECT vec_id AS frame_id, embedding[11]::DOUBLE AS gx, embedding[12]::DOUBLE AS gy, embedding[13]::DOUBLE AS gz FROM embeddings)"
_ERR = f"{t.poses_sql()}, {_TRUE}, er AS (SELECT frame_id, sqrt((tx-gx)**2 + (ty-gy)**2 + (tz-gz)**2) AS error FROM poses JOIN g USING (frame_id))"


def _errors(spark, sf):
    e = t.read(spark, sf, "embeddings")
    truth = e.select(F.col("vec_id").alias("frame_id"), *[F.col("embedding")[i].cast("double").alias(f"t{a}") for i, a in enumerate("xyz", 10)])
    return evaluate.translation_error(t.poses(spark, sf), truth)


@query("str6_translation_error", f"WITH {_ERR} SELECT frame_id, {t.r6('error')} AS error FROM er")
def str6(spark, sf):
    return _errors(spark, sf).withColumn("error", clean(F.col("error")))


@query("str6_summary", f"WITH {_ERR} SELECT {t.r6('sqrt(avg(error * error))')} AS rmse, {t.r6('avg(error)')} AS mean FROM er")
def str6_summary(spark, sf):
    s = evaluate.summary(_errors(spark, sf))
    return s.select(clean(F.col("rmse")).alias("rmse"), clean(F.col("mean")).alias("mean"))


@query("str7_running_mean", "SELECT event_id, round(avg(value / 97) OVER (ORDER BY event_id), 6) + 0.0 AS mean FROM events")
def str7(spark, sf):
    r = evaluate.running_mean(t.read(spark, sf, "events").select("event_id", (F.col("value") / 97.0).alias("value")),
                              "event_id", "value")
    return r.select("event_id", clean(F.col("mean")).alias("mean"))


_PM = [f"m{i}{j}" for i in range(3) for j in range(4)]


@query("str9_pose_matrices", f"WITH {t.poses_sql()}, {t.pose_rows_sql()} SELECT frame_id, {', '.join(f'{t.r6(m)} AS {m}' for m in _PM)} FROM pm")
def str9(spark, sf):
    return px.pose_columns(t.poses(spark, sf)).select("frame_id", *[clean(F.col(m)).alias(m) for m in _PM])


@query("str1_streamed_fusion", f"WITH RECURSIVE {FUSED_POSED} SELECT gx, gy, gz, {t.r6('sdf')} AS sdf, weight, r, g, b FROM fused")
def str1(spark, sf):
    """The posed frames as a stream of several files that cut frames in two and bring a part of the rows one file late;
    the map it leaves equals the batch one."""
    folder = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    pixels = t.pixels(spark, sf, t.SMALL)
    last, total = pixels.select((F.max("frame_id")).alias("f"), F.count(F.lit(1)).alias("n")).first()
    stamped = pixels.withColumn("ts", F.timestamp_seconds(F.col("frame_id") + 1))  # a watermark starts at second 0
    at = F.col("frame_id") * (t.SMALL.rows * t.SMALL.cols) + F.col("idx")
    own = F.floor(at * STREAM_FILES / F.lit(total))
    late = F.when((F.xxhash64("frame_id", "idx") % 16 == 0) & (own < STREAM_FILES - 1), 1).otherwise(0)
    for k in range(STREAM_FILES):  # the order in which the files come is that of their times
        stamped.filter(own + late == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    span = last // STREAM_FILES + 3
    end = stamped.limit(0).unionByName(spark.range(1).select(F.timestamp_seconds(F.lit(last + 2 * span)).alias("ts")), allowMissingColumns=True)
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store, done = tracking.MapStore(os.path.join(folder, "map")), []
    tracking.fuse_stream(stream, t.poses(spark, sf), t.SMALL, t.COARSE, store, os.path.join(folder, "offsets"), done.append,
                         delay=f"{span} seconds").awaitTermination()
    out = store.read(spark, "voxels", done[-1])
    return out.select(*vx.G, clean(F.col("sdf")).alias("sdf"), "weight", "r", "g", "b")
