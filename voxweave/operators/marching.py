"""Iso-surface extraction. Cells come from observed voxels, so empty space costs nothing."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Tsdf
from ..runtime import computed, cut, with_running
from . import mesh

G = ["gx", "gy", "gz"]
# Corner (x, y, z) of each case bit, and the two bits each edge joins; fixed values
CORNERS = ((0, 1, 0), (1, 1, 0), (1, 0, 0), (0, 0, 0), (0, 1, 1), (1, 1, 1), (1, 0, 1), (0, 0, 1))
EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))


def edge_mask(case: int) -> int:
    """Bit k is set when edge k joins corners of different sign."""
    return sum(1 << k for k, (a, b) in enumerate(EDGES) if (case >> a & 1) != (case >> b & 1))


def _face_links(case: int):
    """Pairs of cut edges joined across each of the six faces."""
    for axis in range(3):
        for side in (0, 1):
            on = {i for i, c in enumerate(CORNERS) if c[axis] == side}
            edges = [k for k, e in enumerate(EDGES) if set(e) <= on]
            cut = [k for k in edges if edge_mask(case) >> k & 1]
            if len(cut) == 2:
                yield tuple(cut)
            elif len(cut) == 4:
                # Ambiguous face: each negative corner is cut off on its own.
                for corner in on:
                    if case >> corner & 1:
                        yield tuple(k for k in edges if corner in EDGES[k])


def _point(edge: int):
    return [(p + q) / 2 for p, q in zip(*(CORNERS[i] for i in EDGES[edge]))]


def _outward(loop, case: int) -> bool:
    """True when the loop's normal points from negative to positive corners."""
    normal, toward = [0.0] * 3, [0.0] * 3
    for a, b in zip(loop, loop[1:] + loop[:1]):
        p, q = _point(a), _point(b)
        for i in range(3):
            normal[i] += p[i - 2] * q[i - 1] - p[i - 1] * q[i - 2]
    for e in loop:
        a, b = EDGES[e]
        neg, pos = (a, b) if case >> a & 1 else (b, a)
        for i in range(3):
            toward[i] += CORNERS[pos][i] - CORNERS[neg][i]
    return sum(n * w for n, w in zip(normal, toward)) > 0


@lru_cache(maxsize=None)
def triangle_table() -> tuple[tuple[int, ...], ...]:
    """(case, tri, e0, e1, e2): walk the closed loops of linked edges and fan them."""
    rows = []
    for case in range(256):
        links: dict[int, list[int]] = {}
        for a, b in _face_links(case):
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
        tri = 0
        while links:
            loop = [min(links)]
            while links.get(loop[-1]):
                here = loop[-1]
                nxt = links[here].pop()
                links[nxt].remove(here)
                if nxt == loop[0]:
                    break
                loop.append(nxt)
            links = {k: v for k, v in links.items() if v}
            if not _outward(loop, case):
                loop.reverse()
            for i in range(1, len(loop) - 1):
                rows.append((case, tri, loop[0], loop[i], loop[i + 1]))
                tri += 1
    return tuple(rows)


def triangle_rows(spark: SparkSession) -> DataFrame:
    """The table with the corner bits (a*, b*) of each of the three vertices."""
    rows = [(c, t, *EDGES[e0], *EDGES[e1], *EDGES[e2]) for c, t, e0, e1, e2 in triangle_table()]
    return spark.createDataFrame(rows, "cube int, tri int, a0 int, b0 int, a1 int, b1 int, a2 int, b2 int")


def corner_values(voxels: DataFrame) -> DataFrame:
    """(cx, cy, cz, d) of the lattice half a voxel off the voxel centres. Such a point is the
    mean of the eight voxels around it and exists only where all are observed."""
    off = F.array(F.lit(0), F.lit(1))
    df = voxels.select(*G, "sdf")
    for a in "xyz":
        df = df.withColumn(f"_{a}", F.explode(off))
    keyed = df.select(*[(F.col(f"g{a}") + F.col(f"_{a}")).alias(f"c{a}") for a in "xyz"], "sdf")
    return (keyed.groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), F.sum("sdf").alias("s"))
            .filter("n = 8").select("cx", "cy", "cz", (F.col("s") / 8.0).alias("d")))


def surface_cells(corners: DataFrame) -> DataFrame:
    """(gx, gy, gz, cube, d): cells the surface passes, with their eight corner values."""
    bit = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(n) for n, v in zip("xyz", c)])
                    for i, c in enumerate(CORNERS)])
    df = corners.select("cx", "cy", "cz", "d", F.explode(bit).alias("_b"))
    df = df.select(*[(F.col(f"c{a}") - F.col(f"_b.{a}")).alias(f"g{a}") for a in "xyz"],
                   F.col("_b.i").alias("i"), "d")
    d = [F.max(F.when(F.col("i") == i, F.col("d"))).alias(f"d{i}") for i in range(8)]
    cells = df.groupBy(*G).agg(F.count(F.lit(1)).alias("n"), *d).filter("n = 8")
    cube = reduce(lambda a, b: a + b, [F.when(F.col(f"d{i}") < 0, 1 << i).otherwise(0) for i in range(8)])
    cells = computed(cells, {"cube": cube}, [*G, *[f"d{i}" for i in range(8)]])
    return cells.filter("cube <> 0 and cube <> 255").select(
        *G, "cube", F.array(*[f"d{i}" for i in range(8)]).alias("d"))


def _crossing(v: int, step: float, shift: float, midpoint: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    """Blend factor and position of vertex v: the zero of the linear blend along its edge."""
    a, b = F.col(f"a{v}"), F.col(f"b{v}")
    d1, d2 = F.get("d", a), F.get("d", b)
    if midpoint:
        mu = F.lit(0.5)
    else:
        mu = (F.when(F.abs(d1) < 1e-5, 0.0).when(F.abs(d2) < 1e-5, 1.0)
              .when(F.abs(d1 - d2) < 1e-5, 0.0).otherwise(F.try_divide(-d1, d2 - d1)))
    out = {}
    for n, axis in enumerate("xyz"):
        at = F.array(*[F.lit(float(c[n])) for c in CORNERS])
        p, q = F.get(at, a), F.get(at, b)
        out[f"p{v}{axis}"] = (F.col(f"g{axis}") + F.lit(shift) + p + F.col(f"_m{v}") * (q - p)) * F.lit(step)
    return {f"_m{v}": mu}, out


def triangulate(cells: DataFrame, step: float, shift: float = -0.5, midpoint: bool = False) -> DataFrame:
    """(gx, gy, gz, tri, p0x..p2z): look the case up and place the three vertices."""
    # The case table has a fixed size, about 800 rows.
    t = cells.join(F.broadcast(triangle_rows(cells.sparkSession)), "cube")
    parts = [_crossing(v, step, shift, midpoint) for v in range(3)]
    t = computed(t, {n: c for m, _ in parts for n, c in m.items()})
    pos = {n: c for _, p in parts for n, c in p.items()}
    keep = [c for c in cells.columns if c not in ("cube", "d")]
    return t.select(*keep, "tri", *[c.alias(n) for n, c in pos.items()])


def extract(voxels: DataFrame, cfg: Tsdf, lo=None, hi=None) -> DataFrame:
    """Coloured triangle soup of the observed map, optionally within a box of world points."""
    cells = surface_cells(corner_values(voxels))
    if lo is not None:
        for a, x0, x1 in zip("xyz", lo, hi):
            cells = cells.filter((F.col(f"g{a}") * cfg.voxel_size).between(x0, x1))
    colours = voxels.select(*G, *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    return triangulate(cells.join(colours, G), cfg.voxel_size)


def _lattice_vertex(v: int) -> dict[str, Column]:
    """Vertex v of a triangle named by the lattice: kx, ky, kz are twice the corner that the vertex is snapped to, or
    the sum of the two corners of its edge; m is the share of the way from the lower to the upper one."""
    a, b = F.col(f"a{v}"), F.col(f"b{v}")
    at = {x: F.array(*[F.lit(c[n]) for c in CORNERS]) for n, x in enumerate("xyz")}
    total = F.array(*[F.lit(sum(c)) for c in CORNERS])
    first = F.get(total, a) < F.get(total, b)
    low, high = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    d0, d1 = F.get("d", low), F.get("d", high)
    m = F.when(F.abs(d0) < 1e-5, 0.0).when(F.abs(d1) < 1e-5, 1.0).when(F.abs(d0 - d1) < 1e-5, 0.0).otherwise(F.try_divide(-d0, d1 - d0))
    key = {x: 2 * F.col(f"g{x}") + F.when(m == 0, 2 * F.get(at[x], low)).when(m == 1, 2 * F.get(at[x], high))
           .otherwise(F.get(at[x], low) + F.get(at[x], high)) for x in "xyz"}
    return {**{f"k{x}": c.cast("long") for x, c in key.items()}, "m": m}


def extract_indexed(voxels: DataFrame, cfg: Tsdf) -> tuple[DataFrame, DataFrame]:
    """(vertices(vid, x, y, z, r, g, b), faces(fid, gx, gy, gz, tri, v0, v1, v2)) of the observed map.

    A vertex is named by the lattice edge that it cuts, or the corner that it is snapped to, so that cells share
    vertices without a comparison of positions. vid counts the names in order, fid the cells. A vertex has the mean
    colour of the triangle corners that meet in it. Every triangle of :func:`extract` stays.
    """
    cells = surface_cells(corner_values(voxels))
    colours = voxels.select(*G, *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    t = cells.join(colours, G).join(F.broadcast(triangle_rows(cells.sparkSession)), "cube")
    named = F.array(*[F.struct(F.lit(v).alias("k"), *[c.alias(n) for n, c in _lattice_vertex(v).items()]) for v in range(3)])
    corners = cut(t.select(*G, "tri", *"rgb", F.inline(named)))  # read for the vertices and for the faces
    key = ["kx", "ky", "kz"]
    names = corners.groupBy(*key).agg(F.max("m").alias("m"), *[F.avg(c).alias(c) for c in "rgb"])
    numbered = with_running(names, key, ordinal="vid")
    # An odd name is halfway along its axis.
    place = lambda x: (F.expr(f"k{x} div 2 - if(k{x} < 0 and k{x} % 2 <> 0, 1, 0)")
                       + F.when(F.col(f"k{x}") % 2 != 0, F.col("m")).otherwise(0.0) - 0.5) * F.lit(cfg.voxel_size)
    vertices = numbered.select("vid", *[place(x).alias(x) for x in "xyz"], *"rgb")
    faces = mesh.regroup(corners.join(numbered.select(*key, "vid"), key), {"vid": "v{k}"}, [*G, "tri"])
    return vertices, with_running(faces, [*G, "tri"], ordinal="fid")


def march_field(field: DataFrame, step: float, origin: float = 0.0) -> DataFrame:
    """Surface of values on lattice points (gx, gy, gz, d), vertices at edge midpoints."""
    corners = field.select(F.col("gx").alias("cx"), F.col("gy").alias("cy"), F.col("gz").alias("cz"), "d")
    return triangulate(surface_cells(corners), step, shift=origin, midpoint=True)


def lattice(spark: SparkSession, n: int, lo: float, hi: float) -> DataFrame:
    """n^3 points of a cube: gx, gy, gz and x, y, z."""
    step = (hi - lo) / (n - 1)
    df = spark.range(n ** 3).select((F.col("id") % n).alias("gx"), F.expr(f"id div {n} % {n}").alias("gy"),
                                    F.expr(f"id div {n * n}").alias("gz"))
    return df.withColumns({a: F.lit(lo) + F.col(f"g{a}") * step for a in "xyz"})


def implicit(points: DataFrame, kind: str = "sphere") -> DataFrame:
    """Adds d, negative inside one of the three test surfaces."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    d = {"sphere": x * x + y * y + z * z - 9.0,
         "hyperboloid": x * x / 5.0 + y * y / 3.0 - z * z / 7.0 - 5.0,
         "saddle": x * x / 10.0 - y * y / 3.0 - z / 2.0}[kind]
    return points.withColumn("d", d)
