"""Voxel-map queries (VOX) over the event frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vec import V3, clean
from ..operators import pixels as px
from ..operators import voxelray
from ..operators import voxels as vx
from . import tables as t
from .registry import query

S, M, C = t.BIG, t.SMALL, t.COARSE
H, B, TAU = C.voxel_size, C.block_size, C.truncation
EDGE = C.block_edge


def _origin(spark, sf, s=S):
    """Every frame seen from the origin."""
    one = t.pixels(spark, sf, s).select("frame_id").distinct()
    zero = {f"{p}{a}": F.lit(0.0) for p, a in ("tx", "ty", "tz", "qx", "qy", "qz")}
    return one.withColumns({**zero, "qw": F.lit(1.0)})


ORIGIN_PM = """pm AS (SELECT DISTINCT frame_id, 1.0::DOUBLE AS m00, 0.0::DOUBLE AS m01, 0.0::DOUBLE AS m02,
  0.0::DOUBLE AS m03, 0.0::DOUBLE AS m10, 1.0::DOUBLE AS m11, 0.0::DOUBLE AS m12, 0.0::DOUBLE AS m13,
  0.0::DOUBLE AS m20, 0.0::DOUBLE AS m21, 1.0::DOUBLE AS m22, 0.0::DOUBLE AS m23 FROM pixels)"""


def _round_sql(e):
    return f"(floor(abs({e}) + 0.5) * sign({e}))::BIGINT"


def alloc_sql(s):
    """CTE alloc(frame_id, bx, by, bz), independent of the array formulation: crossings are
    rows, ordered by a window."""
    x, y, z = t.xyz_sql(s)
    w = [f"(m{i}0 * {x} + m{i}1 * {y} + m{i}2 * {z} + m{i}3)" for i in range(3)]
    planes = " UNION ALL ".join(
        f"""SELECT frame_id, idx, (k * {EDGE!r}::DOUBLE - o{a}) / (e{a} - o{a}) AS tt FROM rays,
        LATERAL (SELECT unnest(generate_series((floor(least(o{a}, e{a}) / {EDGE!r}::DOUBLE) + 1)::BIGINT,
        (ceil(greatest(o{a}, e{a}) / {EDGE!r}::DOUBLE) - 1)::BIGINT)) AS k)""" for a in "xyz")
    return f"""wp AS (SELECT frame_id, idx, {w[0]} AS px, {w[1]} AS py, {w[2]} AS pz, m03 AS ox, m13 AS oy, m23 AS oz
      FROM pixels JOIN pm USING (frame_id) WHERE depth BETWEEN {C.min_depth} AND {C.max_depth}),
    rl AS (SELECT *, sqrt((px-ox)*(px-ox) + (py-oy)*(py-oy) + (pz-oz)*(pz-oz)) AS len FROM wp),
    rays AS (SELECT frame_id, idx, ox, oy, oz, px + (px-ox) * ({TAU}::DOUBLE / len) AS ex,
      py + (py-oy) * ({TAU}::DOUBLE / len) AS ey, pz + (pz-oz) * ({TAU}::DOUBLE / len) AS ez FROM rl WHERE len > 0),
    ts AS ({planes} UNION ALL SELECT frame_id, idx, 0.0::DOUBLE FROM rays UNION ALL SELECT frame_id, idx, 1.0::DOUBLE FROM rays),
    mid AS (SELECT frame_id, idx, (tt + lead(tt) OVER (PARTITION BY frame_id, idx ORDER BY tt)) / 2 AS tm FROM ts),
    alloc AS (SELECT DISTINCT r.frame_id, floor((ox + (ex-ox)*tm) / {EDGE!r}::DOUBLE)::BIGINT AS bx,
      floor((oy + (ey-oy)*tm) / {EDGE!r}::DOUBLE)::BIGINT AS by, floor((oz + (ez-oz)*tm) / {EDGE!r}::DOUBLE)::BIGINT AS bz
      FROM mid JOIN rays r USING (frame_id, idx) WHERE tm IS NOT NULL)"""


def obs_sql(s):
    """CTE obs: every frame against every block that exists by then."""
    def cam(px_, py, pz):
        d = [f"({p} - m{i}3)" for i, p in enumerate((px_, py, pz))]
        return [f"(m0{j} * {d[0]} + m1{j} * {d[1]} + m2{j} * {d[2]})" for j in range(3)]
    k = cam(*[f"(b{a} * {EDGE!r}::DOUBLE)" for a in "xyz"])
    v = cam(*[f"(g{a} * {H!r}::DOUBLE)" for a in "xyz"])
    half = 0.5 * EDGE

    def proj(f, c, a, z):
        return _round_sql(f"({f}::DOUBLE * {a} / nullif({z}, 0) + {c}::DOUBLE)")
    x, y, z = t.xyz_sql(s)
    return f"""born AS (SELECT bx, by, bz, min(frame_id) AS born FROM alloc GROUP BY 1, 2, 3),
    fb AS (SELECT pm.*, bx, by, bz, {k[0]} AS kx, {k[1]} AS ky, {k[2]} AS kz FROM pm JOIN born ON born <= pm.frame_id),
    fv AS (SELECT * FROM fb WHERE kz >= 0 AND {proj(s.fx, s.cx, f'(kx + {half!r})', f'(kz + {half!r})')} BETWEEN 0 AND {s.cols - 1}
      AND {proj(s.fy, s.cy, f'(ky + {half!r})', f'(kz + {half!r})')} BETWEEN 0 AND {s.rows - 1}),
    vox AS (SELECT fv.*, bx * {B} + i // {B * B} AS gx, by * {B} + i // {B} % {B} AS gy, bz * {B} + i % {B} AS gz
      FROM fv, range({B ** 3}) AS l(i)),
    vc AS (SELECT frame_id, gx, gy, gz, {v[0]} AS x, {v[1]} AS y, {v[2]} AS z FROM vox),
    vp AS (SELECT *, {proj(s.fx, s.cx, 'x', 'z')} AS pu, {proj(s.fy, s.cy, 'y', 'z')} AS pv, sqrt(x*x + y*y + z*z) AS vd FROM vc WHERE z >= 0),
    sd AS (SELECT frame_id, u, v, r, g, b, sqrt({x}*{x} + {y}*{y} + {z}*{z}) AS sd FROM pixels WHERE depth BETWEEN {C.min_depth} AND {C.max_depth}),
    obs AS (SELECT vp.frame_id, gx, gy, gz, r, g, b, CASE WHEN vd > sd - {TAU} AND vd < sd + {TAU} THEN sd - vd ELSE {TAU}::DOUBLE END AS sdf
      FROM vp JOIN sd ON sd.frame_id = vp.frame_id AND sd.u = pu AND sd.v = pv
      WHERE (vd > sd - {TAU} AND vd < sd + {TAU}) OR vd < sd - {TAU})"""


# The merge, one recursion step per observation of a voxel.
FOLD_SQL = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY frame_id) AS n,
    count(*) OVER (PARTITION BY gx, gy, gz) AS total FROM obs),
  steps AS (SELECT gx, gy, gz, n, total, sdf, 1 AS weight, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b FROM ranked WHERE n = 1
    UNION ALL SELECT s.gx, s.gy, s.gz, o.n, s.total, (s.sdf * s.weight + o.sdf) / (s.weight + 1),
      least(s.weight + 1, {C.max_weight}), (s.r * s.weight + o.r) // (s.weight + 1), (s.g * s.weight + o.g) // (s.weight + 1),
      (s.b * s.weight + o.b) // (s.weight + 1)
    FROM steps s JOIN ranked o ON o.gx = s.gx AND o.gy = s.gy AND o.gz = s.gz AND o.n = s.n + 1),
  fused AS (SELECT gx, gy, gz, sdf, weight, r, g, b FROM steps WHERE n = total)"""

FUSED_BIG = f"{t.pixels_sql()}, {ORIGIN_PM}, {alloc_sql(S)}, {obs_sql(S)}, {FOLD_SQL}"
FUSED_POSED = f"{t.pixels_sql(M)}, {t.poses_sql()}, {t.pose_rows_sql()}, {alloc_sql(M)}, {obs_sql(M)}, {FOLD_SQL}"
_OUT = f"gx, gy, gz, {t.r6('sdf')} AS sdf, weight, r, g, b"


def fused(spark, sf):
    return vx.fuse(t.pixels(spark, sf), _origin(spark, sf), S, C)


def _out(df):
    return df.select(*vx.G, clean(F.col("sdf")).alias("sdf"), "weight", "r", "g", "b")


def _wrap_sql(e):
    return f"(xor(({e}) & 4294967295, 2147483648) - 2147483648)"


_HP = [_wrap_sql(f"(vec_id + {o}) * {p}") for o, p in zip((-250, -249, -248), vx.HASH_PRIMES)]
_HX = f"xor(xor({_HP[0]}, {_HP[1]}), {_HP[2]})"


@query("vox2_block_hash", f"SELECT vec_id, ((({_HX}) % 2500 + 2500) % 2500) * 10 AS slot FROM embeddings")
def vox2(spark, sf):
    i = F.col("vec_id")
    return t.read(spark, sf, "embeddings").select("vec_id", vx.block_hash(i - 250, i - 249, i - 248, C).alias("slot"))


_POSED_ALLOC = f"{t.pixels_sql(M)}, {t.poses_sql()}, {t.pose_rows_sql()}, {alloc_sql(M)}"


def _posed(spark, sf):
    return vx.allocate(t.pixels(spark, sf, M), t.poses(spark, sf), M, C)


@query("vox3_insert_blocks", f"""WITH {_POSED_ALLOC} SELECT DISTINCT bx, by, bz FROM alloc WHERE frame_id % 2 = 1
EXCEPT SELECT bx, by, bz FROM alloc WHERE frame_id % 2 = 0""")
def vox3(spark, sf):
    a = _posed(spark, sf)
    return vx.insert_blocks(a.filter("frame_id % 2 = 0").select(*vx.BLOCK), a.filter("frame_id % 2 = 1"))


@query("vox4_delete_blocks", f"""WITH {_POSED_ALLOC} SELECT bx, by, bz, min(frame_id) AS born FROM alloc GROUP BY 1, 2, 3
HAVING min(frame_id) > 0""")
def vox4(spark, sf):
    a = _posed(spark, sf)
    return vx.delete_blocks(vx.blocks(a), a.filter("frame_id = 0").select(*vx.BLOCK))


@query("vox5_find_blocks", f"""WITH {_POSED_ALLOC}, q AS (SELECT DISTINCT bx, by, bz FROM alloc WHERE frame_id % 2 = 1),
e AS (SELECT DISTINCT bx, by, bz FROM alloc WHERE frame_id % 2 = 0)
SELECT bx, by, bz, CASE WHEN e.bx IS NULL THEN 0 ELSE 1 END AS found FROM q LEFT JOIN e USING (bx, by, bz)"""
       .replace("SELECT bx, by, bz, CASE WHEN e.bx", "SELECT q.bx, q.by, q.bz, CASE WHEN e.bx"))
def vox5(spark, sf):
    a = _posed(spark, sf)
    q = a.filter("frame_id % 2 = 1").select(*vx.BLOCK).distinct()
    return vx.find_blocks(q, a.filter("frame_id % 2 = 0"))


@query("vox5_count_blocks", f"WITH {_POSED_ALLOC} SELECT frame_id, count(*) AS blocks FROM alloc GROUP BY frame_id")
def vox5_count(spark, sf):
    return _posed(spark, sf).groupBy("frame_id").agg(F.count(F.lit(1)).alias("blocks"))


_GQ = [_round_sql(f"({a} / {H!r}::DOUBLE)") for a in "xyz"]


@query("vox7_voxel_keys", f"""WITH {t.points_sql()}, q AS (SELECT idx, {', '.join(f'{e} AS g{a}' for a, e in zip('xyz', _GQ))} FROM points)
SELECT idx, gx, gy, gz, {', '.join(f'floor(g{a} / {B}.0)::BIGINT AS b{a}, ((g{a} % {B}) + {B}) % {B} AS l{a}' for a in 'xyz')},
(((gx % 8) + 8) % 8) * 64 + (((gy % 8) + 8) % 8) * 8 + (((gz % 8) + 8) % 8) AS li FROM q""")
def vox7(spark, sf):
    df = vx.with_voxel_keys(t.points(spark, sf), V3.of(), C)
    return df.select("idx", *vx.G, *vx.BLOCK, "lx", "ly", "lz", vx.local_index(V3.of("l"), C).alias("li"))


@query("vox10_array_index", f"""WITH q AS (SELECT event_id AS id, event_id % 64 AS gx, event_id % 4096 // 64 AS gy, event_id // 4096 AS gz FROM events)
SELECT id, gx + gy * 64 + gz * 4096 AS ai, {', '.join(t.r6(f'g{a} * {H!r}::DOUBLE') + f' AS {a}' for a in 'xyz')} FROM q""")
def vox10(spark, sf):
    df = t.read(spark, sf, "events").select(F.col("event_id").alias("id"), *vx.array_voxel(F.col("event_id"), 64).named("g"))
    p = vx.voxel_to_world(V3.of("g"), C)
    return df.select("id", vx.array_index(V3.of("g"), 64).alias("ai"), *[clean(c).alias(a) for a, c in zip("xyz", p)])


@query("vox13_merge", f"WITH RECURSIVE {FUSED_POSED} SELECT {_OUT} FROM fused")
def vox13(spark, sf):
    """Merging by composable chunk summaries (four frames per chunk here)."""
    pix, pos = t.pixels(spark, sf, M), t.poses(spark, sf)
    a = vx.allocate(pix, pos, M, C)
    obs = vx.observations(vx.frame_blocks(a, vx.blocks(a), M, C), pix, pos, M, C)
    return _out(vx.fold_chunked(obs, C, chunk=4, fan=2))


@query("vox14_ray_blocks", f"WITH {t.pixels_sql()}, {ORIGIN_PM}, {alloc_sql(S)} SELECT frame_id, bx, by, bz FROM alloc")
def vox14(spark, sf):
    return vx.allocate(t.pixels(spark, sf), _origin(spark, sf), S, C)


@query("vox15_observations", f"""WITH {t.pixels_sql()}, {ORIGIN_PM}, {alloc_sql(S)}, {obs_sql(S)}
SELECT frame_id, gx, gy, gz, {t.r6('sdf')} AS sdf, r, g, b FROM obs""")
def vox15(spark, sf):
    pix, pos = t.pixels(spark, sf), _origin(spark, sf)
    a = vx.allocate(pix, pos, S, C)
    obs = vx.observations(vx.frame_blocks(a, vx.blocks(a), S, C), pix, pos, S, C)
    return obs.select("frame_id", *vx.G, clean(F.col("sdf")).alias("sdf"), "r", "g", "b")


@query("vox16_fuse", f"WITH RECURSIVE {FUSED_BIG} SELECT {_OUT} FROM fused")
def vox16(spark, sf):
    return _out(fused(spark, sf))


@query("str3_fuse_given_poses", f"WITH RECURSIVE {FUSED_POSED} SELECT {_OUT} FROM fused")
def str3(spark, sf):
    return _out(vx.fuse(t.pixels(spark, sf, M), t.poses(spark, sf), M, C))


def _lookup_sql(body):
    x, y, z = t.xyz_sql(S)
    return f"""WITH RECURSIVE {FUSED_BIG}, q AS (SELECT frame_id * 10000 + idx AS id, {x} AS x, {y} AS y, {z} AS z FROM pixels
      WHERE depth BETWEEN {C.min_depth} AND {C.max_depth}), {body}"""


def _query_points(spark, sf):
    df = px.back_project(px.depth_filter(t.pixels(spark, sf), C.min_depth, C.max_depth), S)
    return df.select((F.col("frame_id") * 10000 + F.col("idx")).alias("id"), "x", "y", "z")


@query("vox11_get_voxel", _lookup_sql(f"""k AS (SELECT id, {', '.join(f'{e} AS g{a}' for a, e in zip('xyz', _GQ))} FROM q)
SELECT id, coalesce({t.r6('sdf')}, 0) AS sdf, coalesce(weight, 0) AS weight, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b
FROM k LEFT JOIN fused USING (gx, gy, gz)"""))
def vox11(spark, sf):
    out = vx.get_voxels(_query_points(spark, sf), fused(spark, sf), C)
    return out.select("id", clean(F.col("sdf")).alias("sdf"), "weight", "r", "g", "b")


@query("vox12_set_voxel", f"""WITH RECURSIVE {FUSED_BIG}, {t.points_sql()},
up AS (SELECT {', '.join(f'{e} AS g{a}' for a, e in zip('xyz', _GQ))}, min(idx) AS i FROM points GROUP BY 1, 2, 3),
ok AS (SELECT gx, gy, gz, i / 1000.0::DOUBLE AS sdf, 1 AS weight, i AS r, i AS g, i AS b FROM up
  SEMI JOIN (SELECT bx, by, bz FROM alloc) e ON floor(up.gx / 8.0) = e.bx AND floor(up.gy / 8.0) = e.by AND floor(up.gz / 8.0) = e.bz)
SELECT {_OUT} FROM ok UNION ALL SELECT {_OUT} FROM fused f WHERE NOT EXISTS
  (SELECT 1 FROM ok WHERE ok.gx = f.gx AND ok.gy = f.gy AND ok.gz = f.gz)""")
def vox12(spark, sf):
    a = vx.allocate(t.pixels(spark, sf), _origin(spark, sf), S, C)
    m = vx.fuse(t.pixels(spark, sf), _origin(spark, sf), S, C, allocated=a)
    up = t.points(spark, sf).select("idx", *vx.voxel_of(V3.of(), C).named("g")).groupBy(*vx.G).agg(F.min("idx").alias("i"))
    up = up.select(*vx.G, (F.col("i") / 1000.0).alias("sdf"), F.lit(1).alias("weight"),
                   *[F.col("i").alias(c) for c in "rgb"])
    return _out(vx.set_voxels(m, a, up, C))


def _interp_ctes(q="q", out="it", voxels="fused", extra=""):
    """Trilinear lookup as eight joins; q has id, x, y, z."""
    def key(off):
        return " AND ".join(f"v.g{a} = {_round_sql(f'(({a} + ({(o - 0.5) * H!r}::DOUBLE)) / {H!r}::DOUBLE)')}"
                            for a, o in zip("xyz", off))
    f = {a: f"({a} / {H!r}::DOUBLE - floor({a} / {H!r}::DOUBLE))" for a in "xyz"}
    parts = []
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                w = " * ".join(f[a] if o else f"(1 - {f[a]})" for a, o in zip("xyz", (i, j, k)))
                parts.append(f"""SELECT c.id, {w} AS w, coalesce(v.sdf, c.sdf0) AS s, coalesce(v.r, c.r0) AS vr,
                  coalesce(v.g, c.g0) AS vg, coalesce(v.b, c.b0) AS vb FROM c LEFT JOIN {voxels} v ON {key((i, j, k))}""")
    centre = " AND ".join(f"v.g{a} = {_round_sql(f'({a} / {H!r}::DOUBLE)')}" for a in "xyz")
    return f"""c AS (SELECT {q}.*, v.sdf AS sdf0, v.weight AS w0, v.r AS r0, v.g AS g0, v.b AS b0 FROM {q} LEFT JOIN {voxels} v ON {centre}),
      taps AS ({' UNION ALL '.join(parts)}),
      {out} AS (SELECT c.id, any_value(coalesce(w0, 0)) AS weight, CASE WHEN any_value(w0) IS NULL THEN 0 ELSE sum(w * s) END AS sdf,
        CASE WHEN any_value(w0) IS NULL THEN 0 ELSE trunc(round(sum(w * vr), 9))::BIGINT END AS r, CASE WHEN any_value(w0) IS NULL THEN 0 ELSE trunc(round(sum(w * vg), 9))::BIGINT END AS g,
        CASE WHEN any_value(w0) IS NULL THEN 0 ELSE trunc(round(sum(w * vb), 9))::BIGINT END AS b FROM c JOIN taps USING (id) GROUP BY c.id)"""


@query("vox17_interpolate", _lookup_sql(f"{_interp_ctes()} SELECT id, {t.r6('sdf')} AS sdf, weight, r, g, b FROM it"))
def vox17(spark, sf):
    out = vx.interpolate(_query_points(spark, sf), fused(spark, sf), C, "id")
    return out.select("id", clean(F.col("sdf")).alias("sdf"), "weight", "r", "g", "b")


# A camera a little off the voxel lattice, so that no step lands on a voxel border.
_EYE = (0.011, 0.007, 0.0123)
_POSE = [[1.0, 0.0, 0.0, _EYE[0]], [0.0, 1.0, 0.0, _EYE[1]], [0.0, 0.0, 1.0, _EYE[2]], [0.0, 0.0, 0.0, 1.0]]


def _at_sql(d):
    return (f"((u - {S.cx}::DOUBLE) * {d} / {S.fx}::DOUBLE + {_EYE[0]}::DOUBLE)",
            f"((v - {S.cy}::DOUBLE) * {d} / {S.fy}::DOUBLE + {_EYE[1]}::DOUBLE)", f"({d} + {_EYE[2]}::DOUBLE)")


def _sample_sql(vals):
    """Nine left joins at (x, y, z) of p, and the blended value per column."""
    def on(alias, off):
        return f"LEFT JOIN fused {alias} ON " + " AND ".join(
            f"{alias}.g{a} = {_round_sql(f'((p.{a} + {o!r}::DOUBLE) / {H!r}::DOUBLE)')}" for a, o in zip("xyz", off))
    f = {a: f"(p.{a} / {H!r}::DOUBLE - floor(p.{a} / {H!r}::DOUBLE))" for a in "xyz"}
    joins, terms = [on("c", (0.0, 0.0, 0.0))], {v: [] for v in vals}
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                o = (i, j, k)
                al = f"c{i}{j}{k}"
                joins.append(on(al, [(q - 0.5) * H for q in o]))
                w = " * ".join(f[a] if q else f"(1 - {f[a]})" for a, q in zip("xyz", o))
                for v in vals:
                    terms[v].append(f"{w} * coalesce({al}.{v}, c.{v})")
    return " ".join(joins), {v: " + ".join(x) for v, x in terms.items()}


_J, _T = _sample_sql(["sdf", "r", "g", "b"])
_AT = _at_sql("d")
TRACE_SQL = f"""fz AS MATERIALIZED (SELECT * FROM fused),
  tr AS (SELECT i AS idx, i % {S.cols} AS u, i // {S.cols} AS v, 0.0::DOUBLE AS d, 0 AS it, FALSE AS stop FROM range({S.rows * S.cols}) AS q(i)
    UNION ALL SELECT p.idx, p.u, p.v, p.d + CASE WHEN c.weight IS NULL THEN {TAU}::DOUBLE ELSE {_T['sdf']} END, p.it + 1,
      coalesce({_T['sdf']} < {H!r}, FALSE) FROM (SELECT *, {_AT[0]} AS x, {_AT[1]} AS y, {_AT[2]} AS z FROM tr WHERE NOT stop AND d < {C.max_depth}) p
      {_J.replace('fused', 'fz')}),
  hit AS (SELECT idx, u, v, max_by(d, it) AS d FROM tr GROUP BY idx, u, v)"""


@query("vox18_generate_depth", f"WITH RECURSIVE {FUSED_BIG}, {TRACE_SQL} SELECT idx, {t.r6('d')} AS depth FROM hit")
def vox18(spark, sf):
    out = voxelray.generate_depth(fused(spark, sf), _POSE, S, C)
    return out.select("idx", clean(F.col("depth")).alias("depth"))


def _rgb_sql(c):
    return f"CASE WHEN d < {C.max_depth} THEN coalesce(trunc(round({_T[c]}, 9)), 0)::BIGINT ELSE 0 END AS {c}"


@query("vox19_generate_rgb", f"""WITH RECURSIVE {FUSED_BIG}, {TRACE_SQL} SELECT p.idx, {_rgb_sql('r')}, {_rgb_sql('g')}, {_rgb_sql('b')}
FROM (SELECT *, {_AT[0]} AS x, {_AT[1]} AS y, {_AT[2]} AS z FROM hit) p {_J}""")
def vox19(spark, sf):
    return voxelray.generate_rgb(fused(spark, sf), _POSE, S, C)
