"""Product codes of vectors: Lloyd's rounds over cover trees that every partition builds of its own vectors.

A tree is built once. Below a node lie the points within its radius; the centres of its children, the first of which is
its own, are at least as far from each other as any point is from the nearest of them (farthest-first order). A subtree
is a range of the points in tree order, so differences of cumulative sums give its sum. A round gives a whole subtree to
one codebook entry where the triangle inequality rules out the others, and looks deeper only where several remain.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.runtime import cut, ensure_checkpoint_dir

BLOCK = 4096  # vectors of a tree
_LEAF, _FANOUT = 16, 16
_SALTS = 64
_FILE_ROWS = 64  # trees of a file: bounds what a reader holds at a time
_EXACT = 1 << 53
_LISTS = {"points": pa.int32(), "order": pa.int32(), "nodes": pa.int32(), "centre": pa.int32(), "begin": pa.int32(), "end": pa.int32(),
          "child": pa.int32(), "children": pa.int32(), "radius": pa.float64()}


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and entries, both int64."""
    most = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    if points.shape[1] * (2 * most) ** 2 < _EXACT:  # every term and sum of the products is a whole double
        p, c = points.astype(float), entries.astype(float)
        return (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)
    if points.shape[1] * (2 * most) ** 2 >= 1 << 63:
        raise ValueError("squared distances of these vectors do not fit in 64 bits")
    out = np.empty((len(points), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        out[:, k] = ((points - entry) ** 2).sum(1)
    return out


class CoverTree:
    """Nodes in level order. ``order`` lists points so that a node holds order[begin:end]; ``child`` is its first child."""

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: dict[str, np.ndarray]):
        self.points, self.order = points, order  # points are in tree order
        self.centre, self.begin, self.end, self.child, self.children, self.radius = (nodes[k] for k in ("centre", "begin", "end", "child", "children", "radius"))
        self.running = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(points, 0, out=self.running[1:])

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = _LEAF, fanout: int = _FANOUT) -> CoverTree:
        """All nodes of a level are split together. ``centre`` is a place in tree order."""
        n = len(points)
        order = np.arange(n)
        span = lambda x, c: np.einsum("ij,ij->i", x - c, x - c)
        p = points if points.size and points.shape[1] * (2 * int(np.abs(points).max())) ** 2 >= _EXACT else points.astype(float)
        reach = span(p, p[0]) if n else np.zeros(0)
        level = {"centre": np.zeros(1, np.int64), "begin": np.zeros(1, np.int64), "end": np.full(1, n), "radius": np.sqrt(reach.max(initial=0, keepdims=True).astype(float))}
        done, count = [], 1
        while len(level["begin"]):
            size = level["end"] - level["begin"]
            parents = np.flatnonzero((size > leaf) & (level["radius"] > 0))
            level["child"], level["children"] = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            done.append(level)
            if not len(parents):
                break
            size = size[parents]
            seg = np.repeat(np.arange(len(parents)), size)
            at = np.cumsum(size) - size
            where = level["begin"][parents][seg] + np.arange(len(seg)) - at[seg]
            mine = order[where]
            x = p[mine]
            picks = [level["centre"][parents]]
            near, owner = span(x, p[picks[0]][seg]), np.zeros(len(seg), np.int64)
            goal = (level["radius"][parents] / 2) ** 2
            for t in range(1, fanout):
                far = np.maximum.reduceat(near, at)
                live = far > goal
                if not live.any():
                    break
                first = np.flatnonzero(near == far[seg])
                first = first[np.r_[True, np.diff(seg[first]) > 0]]
                picks.append(np.where(live, mine[first], -1))
                d = span(x, p[mine[first]][seg])
                closer = live[seg] & (d < near)
                near[closer], owner[closer] = d[closer], t
            again = np.argsort(seg * fanout + owner, kind="stable")
            order[where] = mine[again]
            key = (seg * fanout + owner)[again]
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            new_seg, new_owner = key[head] // fanout, key[head] % fanout
            begin = where[head]
            level["children"][parents] = np.bincount(new_seg, minlength=len(parents))
            level["child"][parents] = count + np.cumsum(level["children"][parents]) - level["children"][parents]
            count += len(head)
            level = {"centre": np.stack(picks)[new_owner, new_seg], "begin": begin, "end": begin + np.diff(np.r_[head, len(key)]),
                     "radius": np.sqrt(np.maximum.reduceat(near[again], head).astype(float))}
        nodes = {k: np.concatenate([d[k] for d in done]) for k in done[0]}
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        nodes["centre"] = place[nodes["centre"]] if n else nodes["centre"]
        return cls(points[order], order, nodes)

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes given whole and their entries; single points (in tree order) and their entries, ties to the lowest."""
        front, allowed = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        whole, given, points, masks = [], [], [], []
        while len(front):
            d = np.where(allowed, squares(self.points[self.centre[front]], entries), np.inf)
            best = d.argmin(1)
            root = np.sqrt(d)
            r = self.radius[front]
            # No point below is nearer to an entry that is further off than this; the slack is for rounded roots.
            allowed = root <= ((root[np.arange(len(front)), best] + 2 * r) * (1 + 1e-9))[:, None]
            settled = (allowed.sum(1) == 1) | (r == 0)
            whole.append(front[settled]), given.append(best[settled])
            front, allowed = front[~settled], allowed[~settled]
            leaf = self.children[front] == 0
            size = (self.end - self.begin)[front[leaf]]
            points.append(np.repeat(self.begin[front[leaf]] - (np.cumsum(size) - size), size) + np.arange(size.sum()))
            masks.append(np.repeat(allowed[leaf], size, 0))
            front, allowed = front[~leaf], allowed[~leaf]
            n = self.children[front]
            allowed = np.repeat(allowed, n, 0)
            front = np.repeat(self.child[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        points = np.concatenate(points)
        exact = np.where(np.concatenate(masks), squares(self.points[points], entries), np.inf).argmin(1) if len(points) else points
        return np.concatenate(whole), np.concatenate(given), points, exact

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the points of each entry."""
        whole, given, points, exact = self.assign(entries)
        count = np.bincount(exact, minlength=len(entries)).astype(np.int64)
        total = np.zeros(entries.shape, np.int64)
        np.add.at(count, given, (self.end - self.begin)[whole])
        np.add.at(total, given, self.running[self.end[whole]] - self.running[self.begin[whole]])
        order = np.argsort(exact, kind="stable")
        if len(order):
            head = np.flatnonzero(np.r_[True, np.diff(exact[order]) > 0])
            total[exact[order][head]] += np.add.reduceat(self.points[points[order]], head, 0)
        return count, total

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point, in the order in which the points were given."""
        whole, given, points, exact = self.assign(entries)
        size = (self.end - self.begin)[whole]
        code = np.empty(len(self.points), np.int64)
        code[np.repeat(self.begin[whole] - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.repeat(given, size)
        code[points] = exact
        error = ((self.points - entries[code]) ** 2).sum(1)
        out, far = np.empty_like(code), np.empty_like(error)
        out[self.order], far[self.order] = code, error
        return out, far


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    flat = np.floor(np.asarray(vectors.flatten(), float) * scale)
    if flat.size and np.abs(flat).max() >= 1 << 31:
        raise ValueError("a component times the scale does not fit in 32 bits")
    return flat.astype(np.int64).reshape(len(vectors), -1)


def _trees(row: dict, parts: int) -> Iterator[CoverTree]:
    counts, n = row["nodes"], len(row["order"]) // parts
    points = row["points"].astype(np.int64).reshape(parts, n, -1)
    cuts = np.r_[0, np.cumsum(counts)]
    for k in range(parts):
        nodes = {c: row[c][cuts[k]:cuts[k + 1]] for c in ("centre", "begin", "end", "child", "children", "radius")}
        yield CoverTree(points[k], row["order"][k * n:(k + 1) * n], nodes)


def _read(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield {c: np.asarray(batch[c][i].values) for c in _LISTS}


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """vectors(vec_id, embedding, label, ...) -> (vec_id, label, codes array<int>, error), codebooks[part, entry, position].

    Components become floor(scale * x). Each of ``parts`` equal parts has a codebook; it starts as that part of the
    vectors with the smallest vec_id (ties by the vector, null ids last), and is refined by ``rounds`` of Lloyd's rounds
    in whole numbers, ties to the lower entry; an entry without vectors stays. ``error`` is the squared distance, over
    all parts, to the final entries.

    Each partition's vectors go into trees of ``block`` vectors, which are written once to the shared folder. A round
    sends one row of sums per entry and task; the codebooks, ``parts * entries`` short rows, pass the driver.

    Dropped: null vectors, vectors with a null, infinite or undefined component, and vectors of another length than the
    first of the codebook's. Fewer vectors than ``entries``: as many entries. Null ids and labels are kept, repeated
    rows too, each with its own result. Empty table, or nothing left: no rows, no codebooks. Other columns are ignored.
    A length that ``parts`` does not divide, or components of 2**31 / scale and more, raise a ValueError.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema.fields if f.name in ("vec_id", "label")}
    schema = f"vec_id {fields['vec_id']}, label {fields['label']}, codes array<int>, error long"
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & sound)
    first = kept.select("vec_id", "embedding").sort(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    if not first or not first[0]["embedding"]:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    size = len(first[0]["embedding"])
    if size % parts:
        raise ValueError(f"{parts} parts do not divide {size} components")
    kept = kept.where(F.size("embedding") == size)
    first = np.array([r["embedding"] for r in first if len(r["embedding"]) == size])
    books = _matrix(pa.array(list(first), pa.list_(pa.float64())), scale).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    width = size // parts

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), block):
                some = batch.slice(at, block)
                cubes = _matrix(some["embedding"], scale).reshape(len(some), parts, width)
                trees = [CoverTree.build(np.ascontiguousarray(cubes[:, k])) for k in range(parts)]
                row = {"points": [t.points.ravel() for t in trees], "order": [t.order for t in trees], "nodes": [[len(t.begin)] for t in trees],
                       **{c: [getattr(t, c) for t in trees] for c in ("centre", "begin", "end", "child", "children", "radius")}}
                one = {c: pa.array([some[c].to_pylist()], pa.list_(some[c].type)) for c in ("vec_id", "label")}
                yield pa.record_batch(one | {c: pa.array([np.concatenate(row[c])], pa.list_(t)) for c, t in _LISTS.items()})

    lists = ", ".join(f"{c} array<{'double' if c == 'radius' else 'int'}>" for c in _LISTS)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    grown = kept.mapInArrow(grow, f"vec_id array<{fields['vec_id']}>, label array<{fields['label']}>, {lists}")
    grown.write.option("maxRecordsPerFile", _FILE_ROWS).parquet(folder)
    forest = spark.read.schema(grown.schema).parquet(folder)
    axes = [f"s{j}" for j in range(width)]

    def summed(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(shared.value.shape[:2], np.int64), np.zeros_like(shared.value)
            for batch in batches:
                for row in _read(batch):
                    for k, tree in enumerate(_trees(row, parts)):
                        c, s = tree.sums(shared.value[k])
                        count[k] += c
                        total[k] += s
            part, entry = np.nonzero(count)
            yield pa.record_batch({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": count[part, entry],
                                   **{a: total[part, entry, j] for j, a in enumerate(axes)}})
        return run

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        found = (forest.select(*_LISTS).mapInArrow(summed(shared), f"part int, entry int, n long, {', '.join(f'{a} long' for a in axes)}")
                 .groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *axes)]).collect())
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"]] = [r[a] // r["n"] for a in axes]
    final = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(_read(batch)):
                codes, errors = zip(*[t.codes(final.value[k]) for k, t in enumerate(_trees(row, parts))])
                n = len(codes[0])
                listed = pa.ListArray.from_arrays(np.arange(0, parts * n + 1, parts, dtype=np.int32), np.stack(codes, 1).ravel().astype(np.int32))
                yield pa.record_batch({"vec_id": batch["vec_id"][i].values, "label": batch["label"][i].values, "codes": listed, "error": sum(errors)})

    return forest.mapInArrow(coded, schema), books


def codes_and_errors(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together),
    codebooks_sha256 (of all entries' components in decimal, by part, entry and position). Rows and cases as in compress.

    The coded rows are written once; the sums, one row a label, are repeated over salts, so that no label's rows meet.
    """
    coded, books = compress(vectors, **parameters)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    coded = cut(coded.select("vec_id", "label", code.alias("code"), "error", F.pmod(F.xxhash64("vec_id", "code", F.monotonically_increasing_id()), F.lit(_SALTS)).cast("int").alias("salt")))
    totals = (coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
              .withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))))
    return (coded.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("way")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
