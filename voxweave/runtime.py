"""Lineage cuts and distributed ordinals shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a scratch one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxweave-ck-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, and the plan starts afresh here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def afresh(df: DataFrame) -> DataFrame:
    """The same rows without the planner's idea of their size. A checkpoint keeps that, and as each join multiplies the sizes
    of its sides, the number grows to millions of digits in a loop of joins. For narrow rows, as they pass Python."""
    return df.rdd.toDF(df.schema)


def computed(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns that are evaluated exactly once per row. Filters on plain projections get
    the whole expression inlined, once per use; a one-element generator stops that, which keeps
    long expressions inside the size limit of generated code."""
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*(keep if keep is not None else df.columns), F.inline(one))


def with_running(df: DataFrame, order: list, *, ordinal: str | None = None,
                 sums: dict[str, Column] | None = None) -> DataFrame:
    """Add a dense global 0-based ``ordinal`` and running ``sums`` in ``order``.

    A global window would pull every row into one task. Here rows are range-sorted, each
    sorted partition is scanned on its own, and the per-partition totals (one row per
    partition) give the offset to add. ``order`` should be unique.
    """
    sums = sums or {}
    inputs = {f"_in_{n}": c for n, c in sums.items()}
    # The sorted rows are materialised: both uses below must see the same partitions.
    ranked = cut(df.withColumns(inputs).sort(*order).withColumn("_mid", F.monotonically_increasing_id())
                 if inputs else df.sort(*order).withColumn("_mid", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("_pid", F.shiftrightunsigned("_mid", 33))
    totals = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                        *[F.sum(i).alias(f"_t{i}") for i in inputs])
    # One row per range partition: bounded by the partition count, not by the data.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}")
                              for i in inputs])
    out = ranked.join(F.broadcast(offsets), "_pid")
    extra = {}
    if ordinal:
        extra[ordinal] = F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    for name in sums:
        extra[name] = F.sum(f"_in_{name}").over(inside) + F.col(f"_o_in_{name}")
    drop = ["_mid", "_pid", "_off", *inputs, *[f"_o{i}" for i in inputs]]
    return out.withColumns(extra).drop(*drop)
