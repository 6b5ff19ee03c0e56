"""Exact k nearest neighbours as a distributed tree join.

Pairing every query with every node is quadratic, and a fixed grid breaks down where a cell holds
much of the data. Instead the nodes get an adaptive octree, kept as a plain table of cells with
their count and tight bounds, and the queries, sorted along a space-filling curve, are halved into
boxes of a bounded number, wherever they lie. Per box a frontier of cells descends the tree, one
equi-join per level: with the counts, the distance that surely encloses k nodes is known, and cells
farther away are dropped. What is left is a short list of leaves per box. Their nodes meet the box's
queries in one task, where the same bound holds again for small blocks of queries. Everything is
exact; ties go to the lower node id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Graph
from ..functions.weights import neighbour_weight
from ..runtime import cut

LEAF = 128          # nodes per leaf
BOX = 512           # queries per task group
BLOCK = 32          # queries compared at a time
TASK = 128          # boxes that descend the tree in one task
ROUND = 6           # levels of the tree built at a time
FINEST = 48         # here a cell is as small as the rounding of coordinates
SMALL_LEVEL = 3     # the cells of levels up to this number at most 8^3 and may be broadcast
CELL = ["level", "cx", "cy", "cz"]
BOUNDS = ["x0", "x1", "y0", "y1", "z0", "z1"]


def _cell(level: Column, lo, size: float) -> list[Column]:
    n = F.pow(F.lit(2.0), level).cast("long")
    return [F.least(F.greatest(F.floor((F.col(a) - F.lit(o)) / F.lit(size) * n), F.lit(0)), n - 1)
            .alias(f"c{a}") for a, o in zip("xyz", lo)]


def _bounds() -> list[Column]:
    return [f(a).alias(f"{a}{i}") for a in "xyz" for i, f in ((0, F.min), (1, F.max))]


def _range(lo, hi, qlo, qhi, nearest: bool) -> Column:
    if nearest:
        return F.greatest(lo - qhi, qlo - hi, F.lit(0.0))
    return F.greatest(hi - qlo, qhi - lo)


def _box_distance(nearest: bool) -> Column:
    """Least or greatest distance between the query box (b*) and a cell (plain bounds)."""
    parts = [_range(F.col(f"{a}0"), F.col(f"{a}1"), F.col(f"b{a}0"), F.col(f"b{a}1"), nearest)
             for a in "xyz"]
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def _prune(frontier: DataFrame, need: int, floor: float) -> DataFrame:
    """Drop cells that cannot hold one of the ``need`` nearest of any query in the box."""
    f = frontier.withColumns({"_near": _box_distance(True), "_far": _box_distance(False)})
    upto = Window.partitionBy("box").orderBy("_far", *CELL).rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("_cum", F.sum("n").over(upto))
    whole = Window.partitionBy("box")
    reach = F.min(F.when(F.col("_cum") >= need, F.col("_far"))).over(whole)
    f = f.withColumn("_reach", F.greatest(reach, F.lit(floor)) * (1 + 1e-9))
    return f.filter(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach"))).drop(
        "_near", "_far", "_cum", "_reach")


def _tree(nodes: DataFrame, lo, size: float):
    """(cells with a leaf flag, nodes with their leaf) of the adaptive octree.

    Some levels at a time; only the nodes of cells that are still too full go on, so that a
    crowded spot is divided until its cells are small, however deep that is.
    """
    at, left, cells, placed = 0, nodes, None, None
    while True:
        per_level = left.select("node_id", "x", "y", "z", F.explode(F.sequence(F.lit(at), F.lit(min(at + ROUND, FINEST)))).alias("level"))
        per_level = per_level.select("node_id", "x", "y", "z", "level", *_cell(F.col("level"), lo, size))
        found = per_level.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), *_bounds())
        found = found.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == FINEST))
        # Cells below a leaf are never visited; the parent's count says whether there is one above.
        parent = found.filter(~F.col("leaf")).select(
            (F.col("level") + 1).alias("level"), *[F.col(c).alias(f"p{c}") for c in ("cx", "cy", "cz")])
        keyed = found.withColumns({f"p{c}": F.shiftright(c, 1) for c in ("cx", "cy", "cz")})
        below = keyed.filter(F.col("level") > at).join(parent, ["level", "pcx", "pcy", "pcz"], "left_semi")
        fresh = cut(below.unionByName(keyed.filter(F.col("level") == 0)) if at == 0 else below)
        own = per_level.join(fresh.filter("leaf").select(*CELL), CELL)
        cells = fresh if cells is None else cells.unionByName(fresh)
        placed = own if placed is None else placed.unionByName(own)
        at += ROUND
        full = fresh.filter((F.col("level") == at) & ~F.col("leaf"))
        if at >= FINEST or full.isEmpty():
            return cells, placed
        left = cut(per_level.filter(F.col("level") == at).join(full.select(*CELL), CELL, "left_semi").select("node_id", "x", "y", "z"))


def _curve(lo, size: float):
    """Adds the place of each row on a Z-order curve, 20 bits an axis."""
    def run(batches):
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int64)
            for k, a in enumerate("xyz"):
                v = np.clip((batch[a].to_numpy() - lo[k]) / size * 2.0 ** 20, 0, 2 ** 20 - 1).astype(np.int64)
                for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F),
                                    (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
                    v = (v | (v << shift)) & mask
                at |= v << k
            yield batch.append_column("at", pa.array(at))
    return run


def _halved(xyz: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``most``: halves along the widest side."""
    todo, done = [np.arange(len(xyz))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        own = xyz[rows]
        cut_at = np.argpartition(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], len(rows) // 2)
        todo += [rows[cut_at[len(rows) // 2:]], rows[cut_at[:len(rows) // 2]]]
    return done


def _xyz(rows) -> np.ndarray:
    return np.stack([np.asarray(rows[a], float) for a in "xyz"], axis=1)


def _into_boxes(most: int):
    """Adds the number of the box to rows that are neighbours on the curve."""
    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            box = np.zeros(batch.num_rows, np.int64)
            for rows in _halved(_xyz(batch), most):
                box[rows] = number
                number += 1
            yield batch.select(["qid", "x", "y", "z"]).append_column("box", pa.array(box))
    return run


def _boxes(queries: DataFrame, most: int) -> DataFrame:
    """(qid, x, y, z, box) of the queries that have a place, at most ``most`` in a box."""
    q = _placed_rows(queries.select("qid", "x", "y", "z"))
    top = q.agg(*_bounds()).first()
    lo = [top[f"{a}0"] or 0.0 for a in "xyz"]
    size = max(max((top[f"{a}1"] or 0.0) - o for a, o in zip("xyz", lo)), 1e-300) * (1 + 1e-9)
    schema = "qid long, x double, y double, z double"
    q = q.select(F.col("qid").cast("long").alias("qid"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    q = q.mapInArrow(_curve(lo, size), f"{schema}, at long").sort("at", "x", "y", "z", "qid")
    # Written, as every use must see the same boxes.
    return cut(q.mapInArrow(_into_boxes(most), f"{schema}, box long"))


def _placed_rows(df: DataFrame) -> DataFrame:
    return df.filter(" and ".join(f"abs({a}) < double('infinity')" for a in "xyz"))


def _nearest_in_task(k: int, exclude_self: bool, floor: float):
    schema = pa.schema([("qid", pa.int64()), ("rank", pa.int32()), ("node_id", pa.int64()), ("dist", pa.float64())])

    def run(key, q: pa.Table, near: pa.Table) -> pa.Table:
        if not len(q) or not len(near):
            return schema.empty_table()
        c = pa.concat_arrays([chunk.flatten() for chunk in near["nodes"].chunks])
        order = np.argsort(c.field("node_id").fill_null(2 ** 63 - 1).to_numpy(), kind="stable")
        c = c.take(pa.array(order))
        known = {n: x.is_valid().to_numpy(zero_copy_only=False) for n, x in (("q", q["qid"].combine_chunks()), ("c", c.field("node_id")))}
        ids, qid = c.field("node_id").fill_null(2 ** 63 - 1).to_numpy(), q["qid"].fill_null(2 ** 63 - 1).to_numpy()
        cxyz, qxyz = np.stack([c.field(a).to_numpy() for a in "xyz"], axis=1), _xyz(q)
        # As many rows as carry one id may be skipped.
        need = k + (int(np.bincount(np.cumsum(np.r_[0, ids[1:] != ids[:-1]])).max()) if exclude_self else 0)
        out = []
        for block in _halved(qxyz, BLOCK):
            own = qxyz[block]
            middle = (own.min(axis=0) + own.max(axis=0)) / 2
            away = np.sqrt(((own - middle) ** 2).sum(axis=1)).max()
            gap = np.sqrt(((cxyz - middle) ** 2).sum(axis=1))
            some = np.arange(len(ids))
            if need < len(ids):
                # A query is within ``away`` of the middle, so no node beyond this can be among its nearest.
                reach = np.partition(gap, need - 1)[need - 1] + away
                some = np.nonzero(gap <= (max(reach, floor) + away) * (1 + 1e-9))[0]
            step = max(1, 2_000_000 // len(some))
            for s in range(0, len(block), step):
                rows = block[s:s + step]
                d = np.zeros((len(rows), len(some)))
                for a in range(3):
                    side = qxyz[rows, a, None] - cxyz[None, some, a]
                    d += side * side
                d = np.maximum(np.sqrt(d), floor)
                if exclude_self:
                    d[(qid[rows, None] == ids[None, some]) & known["q"][rows, None] & known["c"][None, some]] = np.inf
                m = min(k, d.shape[1])
                limit = np.partition(d, m - 1, axis=1)[:, m - 1]
                row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                order = np.lexsort((col, d[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row, side="left") + 1
                keep = rank <= k
                row, col, rank = row[keep], col[keep], rank[keep]
                out.append((rows[row], rank, some[col], d[row, col]))
        row, rank, col, dist = (np.concatenate(part) for part in zip(*out))
        return pa.table([q["qid"].take(pa.array(row)), pa.array(rank, pa.int32()), c.field("node_id").take(pa.array(col)), pa.array(dist)], schema)
    return run


def knn(queries: DataFrame, nodes: DataFrame, k: int, *, exclude_self: bool = False,
        floor: float = 0.0) -> DataFrame:
    """(qid, rank, node_id, dist) for queries (qid, x, y, z) and nodes (node_id, x, y, z).

    ``exclude_self`` skips the node whose id is the query's. Distances below ``floor`` count
    as ``floor``. Rows without a finite place are neither asked for nor found.
    """
    schema = "qid long, rank int, node_id long, dist double"
    nodes = _placed_rows(nodes.select(F.col("node_id").cast("long").alias("node_id"), *[F.col(a).cast("double").alias(a) for a in "xyz"]))
    need = k
    if exclude_self:  # every node with the query's id is skipped, and ids may repeat
        need += nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # Of coincident nodes only the lowest ids can ever be among the nearest.
    twins = Window.partitionBy("x", "y", "z").orderBy("node_id")
    nodes = cut(nodes.withColumn("_t", F.row_number().over(twins)).filter(F.col("_t") <= need).drop("_t"))
    top = nodes.agg(F.count(F.lit(1)).alias("n"), *_bounds()).first()
    if not top["n"]:
        return queries.sparkSession.createDataFrame([], schema)
    lo = [top[f"{a}0"] for a in "xyz"]
    size = max(max(top[f"{a}1"] - top[f"{a}0"] for a in "xyz"), 1e-300) * (1 + 1e-9)
    cells, placed = _tree(nodes, lo, size)
    depth = cells.agg(F.max("level")).first()[0]

    q = _boxes(queries, BOX)
    frontier = cut(q.groupBy("box").agg(*[c.alias(f"b{n}") for c, n in zip(_bounds(), BOUNDS)]))
    # A box's frontier is much larger than its row, so the size of the rows does not say how many tasks are needed.
    frontier = frontier.repartition(1 + frontier.count() // TASK, "box")
    root = {"level": F.lit(0), "cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long"),
            "cz": F.lit(0).cast("long"), "n": F.lit(top["n"]), "leaf": F.lit(depth == 0)}
    root.update({b: F.lit(top[b]) for b in BOUNDS})
    frontier = frontier.withColumns(root)
    box_cols = ["box", *[f"b{b}" for b in BOUNDS]]
    held = [*CELL[1:], "n", "leaf", *BOUNDS]
    for r in range(1, depth + 1):
        # A leaf has no kids, so it stays as it is; the left join reads the frontier only once.
        kids = cells.filter(F.col("level") == r).select(
            F.lit(r - 1).alias("level"), *[F.col(f"p{c}").alias(c) for c in CELL[1:]],
            *[F.col(c).alias(f"k{c}") for c in held])
        kids = F.broadcast(kids) if r <= SMALL_LEVEL else kids
        grown = frontier.join(kids, CELL, "left")
        inner = F.col("kn").isNotNull()
        frontier = _prune(grown.select(
            *box_cols, F.when(inner, F.lit(r)).otherwise(F.col("level")).alias("level"),
            *[F.when(inner, F.col(f"k{c}")).otherwise(F.col(c)).alias(c) for c in held]), need, floor)
        if r % ROUND == 0:
            frontier = cut(frontier)

    # The nodes of a leaf travel as one row; only a cell of the finest level can hold many, in parts.
    part = F.when(F.col("level") == FINEST, F.pmod(F.xxhash64("node_id"), F.lit(1024))).otherwise(0)
    leaves = placed.groupBy(*CELL, part.alias("part")).agg(F.collect_list(F.struct("node_id", "x", "y", "z")).alias("nodes"))
    near = frontier.select(F.col("box").alias("nbox"), *CELL).join(leaves, CELL).select("nbox", "nodes")
    run = _nearest_in_task(k, exclude_self, floor)
    return q.groupBy("box").cogroup(near.groupBy("nbox")).applyInArrow(run, schema)


def nearest(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node_id, dist) of the single nearest node."""
    return knn(queries, nodes, 1).drop("rank")


def with_weights(edges: DataFrame, cfg: Graph) -> DataFrame:
    """Edge weights exp(-d^2/r^2), or nearest * r / d."""
    first = F.first("dist").over(Window.partitionBy("qid").orderBy("rank"))
    near = F.lit(0.0) if cfg.exp_weight else first
    return edges.withColumn("weight", neighbour_weight(F.col("dist"), cfg.radius, cfg.exp_weight, near))


def node_edges(nodes: DataFrame, cfg: Graph, floor: float = 1e-4) -> DataFrame:
    """Weighted links (node_id, rank, nbr_id, dist, weight) of each node to its neighbours."""
    q = nodes.select(F.col("node_id").alias("qid"), "x", "y", "z")
    e = with_weights(knn(q, nodes, cfg.k, exclude_self=True, floor=floor), cfg)
    return e.select(F.col("qid").alias("node_id"), "rank", F.col("node_id").alias("nbr_id"), "dist", "weight")


def observation_edges(obs: DataFrame, nodes: DataFrame, cfg: Graph, *, exclude_self: bool = False,
                      floor: float = 1e-5) -> DataFrame:
    """Weighted links (obs_id, rank, node_id, dist, weight) of points or pixels to nodes."""
    q = obs.select(F.col("obs_id").alias("qid"), "x", "y", "z")
    e = with_weights(knn(q, nodes, cfg.k, exclude_self=exclude_self, floor=floor), cfg)
    return e.select(F.col("qid").alias("obs_id"), "rank", "node_id", "dist", "weight")
