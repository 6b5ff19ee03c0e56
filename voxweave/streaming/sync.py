"""Pairing two timed topics, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, stamp, left_id, right_id): equal stamps; of equal stamps in a topic the lowest id."""
    l = left.groupBy(key, "stamp").agg(F.min("id").alias("left_id"))
    r = right.groupBy(key, "stamp").agg(F.min("id").alias("right_id"))
    return l.join(r, [key, "stamp"])


def nearest(left: DataFrame, right: DataFrame, key: str, slop: int, width: int | None = None) -> DataFrame:
    """(key, left_id, right_id, gap): each left row with the right row nearest in ``stamp``
    (integer units) at most ``slop`` away; the earlier stamp, then the lower id, wins a tie.

    No pairs are formed. Rows are sorted within short time slices of a key, so that a busy key
    is spread over many tasks. A match lies within ``slop``, so that a slice needs only the ends
    of the few slices around it: each slice's ends are handed to those.
    """
    width = width or max(slop // 16, 1)
    slot = F.floor(F.col("stamp") / width)
    r = right.groupBy(key, "stamp").agg(F.min("id").alias("rid"))
    both = left.select(key, "stamp", F.col("id").alias("lid"), F.lit(None).cast("long").alias("rid")).unionByName(
        r.select(key, "stamp", F.lit(None).cast("long").alias("lid"), "rid")).withColumn("slot", slot)
    hit = F.when(F.col("rid").isNotNull(), F.struct(F.col("stamp").alias("t"), F.col("rid").alias("i")))
    inside = Window.partitionBy(key, "slot").orderBy("stamp", F.col("rid").isNull())
    after = Window.partitionBy(key, "slot").orderBy(F.col("stamp").desc(), F.col("rid").isNull())
    run = Window.unboundedPreceding
    near = both.select(key, "slot", "stamp", "lid",
                       F.last(hit, ignorenulls=True).over(inside.rowsBetween(run, 0)).alias("_b"),
                       F.last(hit, ignorenulls=True).over(after.rowsBetween(run, 0)).alias("_a")).filter("lid is not null")
    ends = both.filter("rid is not null").groupBy(key, "slot").agg(F.min(hit).alias("_lo"), F.max(hit).alias("_hi"))
    reach = slop // width + 1
    handed = ends.withColumn("_o", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).filter("_o <> 0")
    around = handed.groupBy(key, (F.col("slot") + F.col("_o")).alias("slot")).agg(
        F.max(F.when(F.col("_o") > 0, F.col("_hi"))).alias("_pb"), F.min(F.when(F.col("_o") < 0, F.col("_lo"))).alias("_na"))
    j = near.join(around, [key, "slot"], "left")
    b, a = F.coalesce("_b", "_pb"), F.coalesce("_a", "_na")
    options = F.array(*[F.when(c.isNotNull(), F.struct(F.abs(c["t"] - F.col("stamp")).alias("gap"), c["t"].alias("t"), c["i"].alias("i")))
                        for c in (b, a)])
    out = j.withColumn("_m", F.array_min(F.filter(options, lambda c: c.isNotNull())))
    return out.filter(F.col("_m.gap") <= slop).select(key, F.col("lid").alias("left_id"), F.col("_m.i").alias("right_id"), F.col("_m.gap").alias("gap"))


def nearest_streams(left: DataFrame, right: DataFrame, key: str, slop: str, delay: str) -> DataFrame:
    """Streaming ``nearest`` over event-time columns ``ts``: an interval join whose state is
    bounded by the watermarks, then the closest match per left row once it is final."""
    l = left.select(F.col(key).alias("lk"), F.col("id").alias("left_id"), F.col("ts").alias("lts")).withWatermark("lts", delay)
    r = right.select(F.col(key).alias("rk"), F.col("id").alias("right_id"), F.col("ts").alias("rts")).withWatermark("rts", delay)
    cond = F.expr(f"lk = rk and rts >= lts - interval {slop} and rts <= lts + interval {slop}")
    gap = F.abs(F.unix_micros("rts") - F.unix_micros("lts"))
    pairs = l.join(r, cond).withColumn("_m", F.struct(gap.alias("gap"), F.col("rts"), F.col("right_id").alias("i")))
    best = pairs.groupBy("lk", "left_id", "lts").agg(F.min("_m").alias("_m"))
    return best.select(F.col("lk").alias(key), "left_id", "lts", F.col("_m.i").alias("right_id"), F.col("_m.gap").alias("gap"))
