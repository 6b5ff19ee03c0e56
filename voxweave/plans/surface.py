"""Surface extraction and mesh queries (MSH, SNK mesh sinks live in files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vec import clean
from ..operators import marching as mc
from ..operators import mesh
from . import tables as t
from .registry import query

C = t.COARSE
POS = [f"p{k}{a}" for k in range(3) for a in "xyz"]


def _table_sql():
    rows = ", ".join(f"({c},{i},{mc.EDGES[a][0]},{mc.EDGES[a][1]},{mc.EDGES[b][0]},{mc.EDGES[b][1]},{mc.EDGES[d][0]},{mc.EDGES[d][1]})"
                     for c, i, a, b, d in mc.triangle_table())
    corners = ", ".join(f"({i},{x},{y},{z})" for i, (x, y, z) in enumerate(mc.CORNERS))
    return f"tt(cube, tri, a0, b0, a1, b1, a2, b2) AS (VALUES {rows}), cn(i, ox, oy, oz) AS (VALUES {corners})"


CORNER_SQL = """cv AS (SELECT v.gx + o.x AS cx, v.gy + o.y AS cy, v.gz + o.z AS cz, sum(sdf) / 8 AS d FROM lattice v,
  (SELECT a.i AS x, b.i AS y, c.i AS z FROM range(2) a(i), range(2) b(i), range(2) c(i)) o GROUP BY 1, 2, 3 HAVING count(*) = 8)"""
CELL_SQL = f"""{_table_sql()}, cc AS (SELECT cv.cx - ox AS gx, cv.cy - oy AS gy, cv.cz - oz AS gz, i, d FROM cv, cn),
  cells AS (SELECT gx, gy, gz, sum(CASE WHEN d < 0 THEN 1 << i ELSE 0 END)::INT AS cube FROM cc GROUP BY 1, 2, 3 HAVING count(*) = 8)"""


def _vertices_sql(step, shift, midpoint):
    mu = "0.5::DOUBLE" if midpoint else """CASE WHEN abs(p.d) < 1e-5 THEN 0 WHEN abs(q.d) < 1e-5 THEN 1
      WHEN abs(p.d - q.d) < 1e-5 THEN 0 ELSE -p.d / (q.d - p.d) END"""
    per = []
    for v in range(3):
        per.append(f"""v{v} AS (SELECT c.gx, c.gy, c.gz, tri, {', '.join(f"(c.g{a} + {shift}::DOUBLE + m.o{a} + ({mu}) * (n.o{a} - m.o{a})) * {step}::DOUBLE AS p{v}{a}" for a in "xyz")}
          FROM cells c JOIN tt USING (cube) JOIN cn m ON m.i = a{v} JOIN cn n ON n.i = b{v}
          JOIN cc p ON p.gx = c.gx AND p.gy = c.gy AND p.gz = c.gz AND p.i = a{v}
          JOIN cc q ON q.gx = c.gx AND q.gy = c.gy AND q.gz = c.gz AND q.i = b{v})""")
    return ", ".join(per)


_P = ", ".join(f"{t.r6(p)} AS {p}" for p in POS)
_JOINED = "v0 JOIN v1 USING (gx, gy, gz, tri) JOIN v2 USING (gx, gy, gz, tri)"


@query("msh2_corner_values", f"WITH {t.lattice_sql()}, {CORNER_SQL} SELECT cx, cy, cz, {t.r6('d')} AS d FROM cv")
def msh2(spark, sf):
    return mc.corner_values(t.lattice(spark, sf)).withColumn("d", clean(F.col("d")))


@query("msh3_surface_cells", f"WITH {t.lattice_sql()}, {CORNER_SQL}, {CELL_SQL} SELECT gx, gy, gz, cube FROM cells WHERE cube NOT IN (0, 255)")
def msh3(spark, sf):
    return mc.surface_cells(mc.corner_values(t.lattice(spark, sf))).select("gx", "gy", "gz", "cube")


@query("msh1_extract_mesh", f"""WITH {t.lattice_sql()}, {CORNER_SQL}, {CELL_SQL}, {_vertices_sql(C.voxel_size, -0.5, False)}
SELECT gx, gy, gz, tri, {_P}, {t.r6('r / 255.0::DOUBLE')} AS r, {t.r6('g / 255.0::DOUBLE')} AS g, {t.r6('b / 255.0::DOUBLE')} AS b
FROM {_JOINED} JOIN lattice USING (gx, gy, gz)""")
def msh1(spark, sf):
    out = mc.extract(t.lattice(spark, sf), C)
    return out.withColumns({c: clean(F.col(c)) for c in (*POS, "r", "g", "b")})


def _indexed_sql():
    """Corners of triangles named by the lattice edge or corner that they lie on, numbered in the order of names."""
    low, high = (f"(CASE WHEN m.ox + m.oy + m.oz {c} n.ox + n.oy + n.oz THEN p.d ELSE q.d END)" for c in "<>")
    ctes = []
    for v in range(3):
        snapped = f"abs({low}) < 1e-5 OR (abs({high}) >= 1e-5 AND abs({low} - {high}) < 1e-5)"
        name = lambda a: (f"2 * c.g{a} + CASE WHEN {snapped} THEN 2 * least(m.o{a}, n.o{a}) WHEN abs({high}) < 1e-5 "  # noqa: E731
                          f"THEN 2 * greatest(m.o{a}, n.o{a}) ELSE m.o{a} + n.o{a} END AS k{a}")
        at = lambda a: (f"(c.g{a} - 0.5::DOUBLE + least(m.o{a}, n.o{a}) + CASE WHEN {snapped} THEN 0 WHEN abs({high}) < 1e-5 THEN 1 "  # noqa: E731
                        f"ELSE -{low} / ({high} - {low}) END * abs(n.o{a} - m.o{a})) * {C.voxel_size}::DOUBLE AS {a}")
        ctes.append(f"""SELECT c.gx, c.gy, c.gz, tri, {v} AS k, {', '.join(name(a) for a in 'xyz')}, {', '.join(at(a) for a in 'xyz')}
          FROM cells c JOIN tt USING (cube) JOIN cn m ON m.i = a{v} JOIN cn n ON n.i = b{v}
          JOIN cc p ON p.gx = c.gx AND p.gy = c.gy AND p.gz = c.gz AND p.i = a{v} JOIN cc q ON q.gx = c.gx AND q.gy = c.gy AND q.gz = c.gz AND q.i = b{v}""")
    return f"""{t.lattice_sql()}, {CORNER_SQL}, {CELL_SQL}, co AS ({' UNION ALL '.join(ctes)}),
  vi AS (SELECT *, dense_rank() OVER (ORDER BY kx, ky, kz) - 1 AS vid FROM co)"""


@query("msh5_indexed_vertices", f"WITH {_indexed_sql()} SELECT vid, {', '.join(f'{t.r6(f'max({a})')} AS {a}' for a in 'xyz')} FROM vi GROUP BY vid")
def msh5_vertices(spark, sf):
    v, _ = mc.extract_indexed(t.lattice(spark, sf), C)
    return v.select("vid", *[clean(F.col(a)).alias(a) for a in "xyz"])


@query("msh5_indexed_faces", f"""WITH {_indexed_sql()} SELECT dense_rank() OVER (ORDER BY gx, gy, gz, tri) - 1 AS fid, gx, gy, gz, tri,
{', '.join(f'max(vid) FILTER (k = {k}) AS v{k}' for k in range(3))} FROM vi GROUP BY gx, gy, gz, tri""")
def msh5_faces(spark, sf):
    return mc.extract_indexed(t.lattice(spark, sf), C)[1]


@query("msh16_midpoint_surface", f"""WITH {t.lattice_sql()}, cv AS (SELECT gx AS cx, gy AS cy, gz AS cz, sdf AS d FROM lattice),
{CELL_SQL}, {_vertices_sql(0.05, 0.0, True)} SELECT gx, gy, gz, tri, {_P} FROM {_JOINED}""")
def msh16(spark, sf):
    field = t.lattice(spark, sf).select("gx", "gy", "gz", F.col("sdf").alias("d"))
    return mc.march_field(field, 0.05).withColumns({c: clean(F.col(c)) for c in POS})


# -- meshes ------------------------------------------------------------------------------
_M = f"{t.points_sql()}, {t.vertices_sql()}, {t.triangles_sql()}"
_DUP = f"{t.points_sql()}, dv AS (SELECT idx AS vid, round(x, 1) + 0.0 AS x, round(y, 1) + 0.0 AS y, round(z, 1) + 0.0 AS z FROM points), {t.triangles_sql()}"
_FIRST = "fe AS (SELECT vid, x, y, z, min(vid) OVER (PARTITION BY x, y, z) AS f FROM dv)"
_DENSE = f"{_FIRST}, de AS (SELECT *, dense_rank() OVER (ORDER BY f) - 1 AS d FROM fe)"


def _duplicated(spark, sf):
    return t.vertices(spark, sf).withColumns({a: clean(F.col(a), 1) for a in "xyz"})


def _faces_sql(src, col):
    j = " ".join(f"JOIN {src} j{k} ON j{k}.vid = v{k}" for k in range(3))
    return f"SELECT fid, {', '.join(f'j{k}.{col} AS v{k}' for k in range(3))} FROM faces {j}"


@query("msh8_compress_faces", f"WITH {_DUP}, {_DENSE} {_faces_sql('de', 'd')}")
def msh8_faces(spark, sf):
    return mesh.compress(_duplicated(spark, sf), t.triangles(spark, sf))[1]


@query("msh8_compress_vertices", f"WITH {_DUP}, {_DENSE} SELECT DISTINCT d AS vid, x, y, z FROM de")
def msh8_vertices(spark, sf):
    return mesh.compress(_duplicated(spark, sf), t.triangles(spark, sf))[0]


@query("msh9_reindex", f"WITH {_DUP}, {_FIRST} {_faces_sql('fe', 'f')}")
def msh9(spark, sf):
    return mesh.reindex(_duplicated(spark, sf), t.triangles(spark, sf))


FACE_POS = f"""fp AS (SELECT fid, v0, v1, v2, {', '.join(f'j{k}.{a} AS p{k}{a}' for k in range(3) for a in 'xyz')}
  FROM faces {' '.join(f'JOIN vertices j{k} ON j{k}.vid = v{k}' for k in range(3))})"""
_E = {a: (f"(p1{a} - p0{a})", f"(p2{a} - p0{a})") for a in "xyz"}


def _cross(a, b):
    return f"({_E[a][0]} * {_E[b][1]} - {_E[b][0]} * {_E[a][1]})"


FACE_N = f"fn AS (SELECT *, {_cross('y', 'z')} AS nx, {_cross('z', 'x')} AS ny, {_cross('x', 'y')} AS nz FROM fp)"
_UNION = " UNION ALL ".join(f"SELECT v{k} AS vid, nx, ny, nz FROM fn" for k in range(3))
VERTEX_N = f"""vs AS (SELECT vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM ({_UNION}) GROUP BY vid),
  vn AS (SELECT vid, {', '.join(f'n{a} / nullif(sqrt(nx*nx + ny*ny + nz*nz), 0) AS n{a}' for a in 'xyz')} FROM vs)"""
_N = ", ".join(f"{t.r6('n' + a)} AS n{a}" for a in "xyz")


def _normals(df, key):
    return df.select(key, *[clean(F.col(f"n{a}")).alias(f"n{a}") for a in "xyz"])


_SHARED = f"""{_DUP}, {_FIRST}, sf AS ({_faces_sql('fe', 'f')})"""
_SHARED_N = f"""{_SHARED}, {FACE_POS.replace('faces', 'sf').replace('vertices', 'dv')}, {FACE_N}, {VERTEX_N}"""


@query("msh11_vertex_normals", f"WITH {_SHARED_N} SELECT vid, {_N} FROM vn WHERE nx IS NOT NULL")
def msh11(spark, sf):
    v = _duplicated(spark, sf)
    n = mesh.vertex_normals(v, mesh.reindex(v, t.triangles(spark, sf)))
    return _normals(n.filter("nx is not null"), "vid")


@query("msh12_face_normals", f"""WITH {_SHARED_N}, fs AS (SELECT fid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM
  ({' UNION ALL '.join(f'SELECT fid, nx, ny, nz FROM sf JOIN vn ON vid = v{k}' for k in range(3))}) GROUP BY fid),
  fu AS (SELECT fid, {', '.join(f'n{a} / nullif(sqrt(nx*nx + ny*ny + nz*nz), 0) AS n{a}' for a in 'xyz')} FROM fs)
  SELECT fid, {_N} FROM fu WHERE nx IS NOT NULL""")
def msh12(spark, sf):
    v = _duplicated(spark, sf)
    f = mesh.reindex(v, t.triangles(spark, sf))
    return _normals(mesh.face_normals(f, mesh.vertex_normals(v, f)).filter("nx is not null"), "fid")


@query("msh13_normal_indices", f"WITH {_M} SELECT fid, v0, v1, v2, v0 AS n0, v1 AS n1, v2 AS n2 FROM faces")
def msh13(spark, sf):
    return mesh.normal_indices(t.triangles(spark, sf))


@query("msh14_mesh_info", f"WITH {_M} SELECT 'vertices' AS what, count(*) AS n FROM vertices UNION ALL SELECT 'faces', count(*) FROM faces")
def msh14(spark, sf):
    return mesh.info(t.vertices(spark, sf), t.triangles(spark, sf))


_BND = ", ".join(f"{t.r6(f'{f}({a})')} AS {n}_{a}" for a in "xyz" for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))


@query("msh15_boundary", f"WITH {_M} SELECT {_BND}, {t.r6('greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z))')} AS scale FROM vertices")
def msh15(spark, sf):
    b = mesh.boundary(t.vertices(spark, sf))
    return b.select(*[clean(F.col(c)).alias(c) for c in b.columns])


@query("msh15_normalize", f"""WITH {_M}, s AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz,
greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS sc FROM vertices)
SELECT vid, {t.r6('(x - mx) / sc')} AS x, {t.r6('(y - my) / sc')} AS y, {t.r6('(z - mz) / sc - 2')} AS z FROM vertices, s""")
def msh15_normalize(spark, sf):
    v = mesh.normalize_pose(t.vertices(spark, sf))
    return v.select("vid", *[clean(F.col(a)).alias(a) for a in "xyz"])


_SOUP = " UNION ALL ".join(f"SELECT fid * 3 + {k} AS vid, p{k}x AS x, p{k}y AS y, p{k}z AS z FROM fp" for k in range(3))


@query("msh7_append_soup", f"""WITH {_M}, {FACE_POS}, s AS ({_SOUP}) SELECT 2 * vid AS vid, {t.r6('x')} AS x, {t.r6('y')} AS y, {t.r6('z')} AS z FROM s
UNION ALL SELECT 2 * vid + 1, {t.r6('x + 1')}, {t.r6('y')}, {t.r6('z')} FROM s""")
def msh7(spark, sf):
    """Two soups put together: the mesh and a copy moved by one in x."""
    v, _ = mesh.soup(mesh.face_positions(t.triangles(spark, sf), t.vertices(spark, sf)))
    even = v.select((F.col("vid") * 2).alias("vid"), "x", "y", "z")
    both = mesh.append(even, v.select((F.col("vid") * 2 + 1).alias("vid"), (F.col("x") + 1.0).alias("x"), "y", "z"))
    return both.select("vid", *[clean(F.col(a)).alias(a) for a in "xyz"])


@query("src9_face_vertices", f"WITH {_M}, {FACE_POS} SELECT fid, {_P} FROM fp")
def src9(spark, sf):
    p = mesh.face_positions(t.triangles(spark, sf), t.vertices(spark, sf))
    return p.select("fid", *[clean(F.col(c)).alias(c) for c in POS])
