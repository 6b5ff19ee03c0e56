import numpy as np
import pandas as pd
import pytest

from voxweave.operators import knn


def brute(q, n, k, exclude, floor=0.0):
    out = []
    for qi, (qid, *p) in enumerate(q.itertuples(index=False)):
        d = np.sqrt(((n[["x", "y", "z"]].to_numpy() - np.array(p)) ** 2).sum(axis=1))
        d = np.maximum(d, floor)
        c = sorted((dd, i) for dd, i in zip(d, n["node_id"]) if not (exclude and i == qid))[:k]
        out += [(qid, r + 1, i) for r, (dd, i) in enumerate(c)]
    return sorted(out)


def cloud(kind, n, seed):
    r = np.random.default_rng(seed)
    if kind == "uniform":
        p = r.uniform(-1, 1, (n, 3))
    elif kind == "hot":  # a third of the nodes in a tiny cluster, some of them coincident
        p = r.uniform(-1, 1, (n, 3))
        p[: n // 3] = 0.3 + r.normal(0, 1e-5, (n // 3, 3))
        p[: n // 10] = [0.3, 0.3, 0.3]
    else:  # on a line
        p = np.stack([r.uniform(-5, 5, n), np.zeros(n), np.zeros(n)], axis=1)
    return p


@pytest.mark.parametrize("kind", ["uniform", "hot", "line"])
@pytest.mark.parametrize("exclude", [False, True])
def test_matches_brute_force(spark, monkeypatch, kind, exclude):
    monkeypatch.setattr(knn, "LEAF", 8)
    monkeypatch.setattr(knn, "BOX", 32)
    p = cloud(kind, 300, 1)
    nodes = pd.DataFrame(p, columns=list("xyz"))
    nodes.insert(0, "node_id", np.arange(300))
    q = pd.DataFrame(np.vstack([p[:100], np.random.default_rng(2).uniform(-3, 3, (50, 3))]), columns=list("xyz"))
    q.insert(0, "qid", np.arange(150))
    got = knn.knn(spark.createDataFrame(q), spark.createDataFrame(nodes), 5, exclude_self=exclude).toPandas()
    assert sorted(map(tuple, got[["qid", "rank", "node_id"]].to_numpy().tolist())) == brute(q, nodes, 5, exclude)


def test_fewer_nodes_than_k(spark):
    n = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)], "node_id long, x double, y double, z double")
    q = spark.createDataFrame([(7, 0.2, 0.0, 0.0)], "qid long, x double, y double, z double")
    assert [r["node_id"] for r in knn.knn(q, n, 4).orderBy("rank").collect()] == [0, 1]


def test_known_nearest(spark):
    pts = [(2, 3), (5, 4), (9, 6), (4, 7), (8, 1), (7, 2)]
    n = spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate(pts)], "node_id long, x double, y double, z double")
    q = spark.createDataFrame([(0, 9.0, 2.0, 0.0)], "qid long, x double, y double, z double")
    r = knn.nearest(q, n).first()
    assert r["node_id"] == 4 and abs(r["dist"] - 2 ** 0.5) < 1e-12


def test_one_far_node_does_not_make_all_pairs(spark):
    """A crowded spot beside a far node is divided as if it were alone."""
    from pyspark.sql import functions as F
    near = spark.range(3000).select(F.col("id").alias("node_id"), *[(F.rand(s) * 1e-4).alias(a) for s, a in ((1, "x"), (2, "y"), (3, "z"))])
    far = spark.createDataFrame([(9999, 1000.0, 1000.0, 1000.0)], "node_id long, x double, y double, z double")
    nodes = near.unionByName(far)
    cells, placed = knn._tree(nodes, [0.0, 0.0, 0.0], 1000.0 * (1 + 1e-9))
    leaves = placed.groupBy(*knn.CELL).count()
    assert placed.count() == 3001 and leaves.agg(F.max("count")).first()[0] <= knn.LEAF


def test_sample_of_large_ids(spark):
    from voxweave.operators import graph
    ids = [5, 2**62, 4_000_000_000, -3]
    got = [r["vid"] for r in graph.sample_random(spark.createDataFrame([(i,) for i in ids], "vid long"), 4).collect()]
    assert got == sorted(ids, key=lambda i: (i * 2654435761 % 2**32, i))


def test_nodes_against_themselves_in_a_deep_tree(spark, monkeypatch):
    """Queries and nodes are one DataFrame, and the tree is built in more than one round."""
    monkeypatch.setattr(knn, "LEAF", 8)
    p = cloud("hot", 300, 3)
    nodes = pd.DataFrame(p, columns=list("xyz"))
    nodes.insert(0, "node_id", np.arange(300))
    n = spark.createDataFrame(nodes)
    got = knn.knn(n.withColumnRenamed("node_id", "qid"), n, 4, exclude_self=True).toPandas()
    assert sorted(map(tuple, got[["qid", "rank", "node_id"]].to_numpy().tolist())) == brute(nodes, nodes, 4, True)


def test_repeated_ids_are_all_skipped(spark):
    nodes = pd.DataFrame([(i // 3, float(i // 6), 0.0, 0.0) for i in range(36)], columns=["node_id", *"xyz"])
    n = spark.createDataFrame(nodes)
    got = knn.knn(n.withColumnRenamed("node_id", "qid"), n, 4, exclude_self=True).toPandas()
    assert sorted(map(tuple, got[["qid", "rank", "node_id"]].to_numpy().tolist())) == brute(nodes, nodes, 4, True)


def test_far_queries_fall_into_small_boxes(spark):
    """Queries beside the nodes' cube lie in boxes of their own, not in the cube's border cells."""
    from pyspark.sql import functions as F
    q = spark.range(20000).select(F.col("id").alias("qid"), *[(F.lit(5.0) + F.rand(s)).alias(a) for s, a in ((1, "x"), (2, "y"), (3, "z"))])
    boxes = knn._boxes(q, 64).groupBy("box").agg(F.count(F.lit(1)).alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in "xyz"]).toPandas()
    assert boxes["n"].sum() == 20000 and boxes["n"].max() <= 64 and boxes[list("xyz")].to_numpy().mean() < 0.3


def test_rows_without_a_place(spark):
    rows = [(0, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (None, 1.0, 0.0, 0.0), (4, 3.0, 0.0, 0.0)]
    n = spark.createDataFrame(rows, "node_id long, x double, y double, z double")
    got = knn.knn(n.withColumnRenamed("node_id", "qid"), n, 1, exclude_self=True).collect()
    assert sorted(((r["qid"], r["node_id"]) for r in got), key=str) == sorted([(0, None), (None, None), (4, None)], key=str)
