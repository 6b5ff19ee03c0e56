"""Weighted least-squares plane through points."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOMENTS = ["w", *[f"c{a}" for a in "xyz"], *[f"v{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]]]
_PAIRS = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]


def moments(points: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Weight w, centroid c* and weighted central second moments v* per key; they combine map-side.

    Nothing is taken as a difference of large sums, so that points far from the origin lose no digits. Without
    weights the moments are merged as central ones; with weights they are summed about a first estimate of the
    centroid, and what that is off by is taken off.
    """
    keys = keys or []
    if weight is None:
        w = F.count(F.lit(1)).cast("double")
        central = [(F.covar_pop(a, b) * F.count(F.col(a) + F.col(b))).alias(f"v{a}{b}") for a, b in _PAIRS]
        return points.groupBy(*keys).agg(w.alias("w"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], *central)
    w = F.col(weight)
    first = points.groupBy(*keys).agg(*[F.try_divide(F.sum(w * F.col(a)), F.sum(w)).alias(f"_c{a}") for a in "xyz"])
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_c{a}" for a in "xyz"])
    same = [points[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    # Without keys the estimate is one row.
    j = points.join(first, reduce(and_, same)) if keys else points.join(F.broadcast(first))
    j = j.select(*keys, w.alias("_w"), *[(F.col(a) - F.col(f"_c{a}")).alias(f"_d{a}") for a in "xyz"], *[f"_c{a}" for a in "xyz"])
    d = {a: F.sum(F.col("_w") * F.col(f"_d{a}")) for a in "xyz"}
    total = F.sum("_w")
    return j.groupBy(*keys).agg(
        total.alias("w"), *[(F.first(f"_c{a}") + F.try_divide(d[a], total)).alias(f"c{a}") for a in "xyz"],
        *[(F.sum(F.col("_w") * F.col(f"_d{a}") * F.col(f"_d{b}")) - F.try_divide(d[a] * d[b], total)).alias(f"v{a}{b}") for a, b in _PAIRS])


def scatter(m: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid and central second moments of ``moments`` rows."""
    return m.select(*keys, *MOMENTS[1:])


def fit(points: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """(key, nx, ny, nz, d): the plane of least spread per key, nz >= 0."""
    s = scatter(moments(points, [key], weight), [key])
    names = [f"v{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]]

    def run(batches):
        for b in batches:
            m = np.zeros((len(b), 3, 3))
            for n in names:
                i, j = "xyz".index(n[1]), "xyz".index(n[2])
                m[:, i, j] = m[:, j, i] = b[n]
            normal = np.linalg.eigh(m)[1][:, :, 0] if len(b) else np.zeros((0, 3))
            normal *= np.where(normal[:, 2:] < 0, -1.0, 1.0)
            out = b[[key]].copy()
            out["nx"], out["ny"], out["nz"] = normal.T
            out["d"] = -(normal * b[["cx", "cy", "cz"]].to_numpy()).sum(axis=1)
            yield out
    return s.mapInPandas(run, f"{key} long, nx double, ny double, nz double, d double")


def mean_residual(points: DataFrame, planes: DataFrame, key: str) -> DataFrame:
    """(key, residual): mean absolute distance of the points to their plane."""
    j = points.join(planes, key)
    e = F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d"))
    return j.groupBy(key).agg(F.avg(e).alias("residual"))
