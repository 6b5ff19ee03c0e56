"""Trajectory error and running timing."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import V3


def translation_error(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """(frame_id, error): distance between estimated and true positions."""
    t = truth.select("frame_id", *[F.col(f"t{a}").alias(f"g{a}") for a in "xyz"])
    return estimate.join(t, "frame_id").select("frame_id", V3.of("t").distance(V3.of("g")).alias("error"))


def summary(errors: DataFrame) -> DataFrame:
    """rmse and mean of the errors."""
    e = F.col("error")
    return errors.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean"))


def running_mean(rows: DataFrame, order: str, value: str, buckets: int | None = None) -> DataFrame:
    """Adds ``mean``: the mean of ``value`` over all rows up to and including this one, by ``order``, a unique number, date
    or timestamp; a null order comes first, null values are not counted in.

    Quantiles cut the order into ``buckets`` (four for each shuffle partition, by default) of about even size. One row of
    totals for each bucket gives the sum ahead of it, and only within a bucket are rows sorted. A row's bucket follows from
    the row and the cuts alone, so that lost tasks are repeated without a written copy of the rows.
    """
    buckets = buckets or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col(order)
    cuts = rows.agg(F.percentile_approx(at, [k / buckets for k in range(1, buckets)], 20 * buckets).alias("c")).first()["c"] if buckets > 1 else None
    ends = sorted(set(cuts or []))
    step = max(math.isqrt(len(ends)), 1)

    def below(some):
        return F.size(F.filter(some, lambda c: c < at))
    # The number of cuts below the row: first among every step-th one, then among those that follow.
    every, coarse = F.array(*map(F.lit, ends)), F.array(*map(F.lit, ends[step - 1::step]))
    skipped = (below(coarse) if ends else F.lit(0)) * step
    bucket = F.when(at.isNull(), -1).otherwise(skipped + (below(F.slice(every, skipped + 1, F.lit(step))) if ends else F.lit(0)))
    placed = rows.select("*", bucket.alias("_bucket"))
    totals = placed.groupBy("_bucket").agg(F.sum(value).alias("_t"), F.count(value).alias("_c"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = totals.select("_bucket", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}o") for c in ("_t", "_c")])
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({"_s": F.coalesce(F.sum(value).over(inside), F.lit(0)), "_n": F.count(value).over(inside)})
    out = summed.join(F.broadcast(offsets), "_bucket")
    n = F.col("_n") + F.col("_co")
    return out.withColumn("mean", F.when(n > 0, (F.col("_s") + F.col("_to")) / n)).select(*rows.columns, "mean")


class Timer:
    """Seconds since the start."""

    def __init__(self):
        self.began = time.perf_counter()

    def elapsed(self) -> float:
        return time.perf_counter() - self.began
