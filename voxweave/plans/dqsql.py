"""SQL text for quaternion and dual-quaternion terms, used by the SQL twins."""

from __future__ import annotations

PARTS = ("rw", "rx", "ry", "rz", "dw", "dx", "dy", "dz")


def cross(a, b):
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})",
            f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


def dot(a, b):
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def rotate(q, v):
    """q, v: lists of SQL terms."""
    w, r = q[0], q[1:]
    inner = [f"({c} + {w} * {x})" for c, x in zip(cross(r, v), v)]
    return [f"({x} + 2 * {c})" for x, c in zip(v, cross(r, inner))]


def position(p, v):
    """Transform point v by the unit dual quaternion with SQL terms p (8)."""
    r, d = p[:4], p[4:]
    c = cross(r[1:], d[1:])
    shift = [f"2 * ({r[0]} * {d[i + 1]} - {d[0]} * {r[i + 1]} + {c[i]})" for i in range(3)]
    return [f"({a} + {s})" for a, s in zip(rotate(r, v), shift)]


def unit_cte(src, name, ident="qid"):
    n = "sqrt(rw*rw + rx*rx + ry*ry + rz*rz)"
    return f"{name} AS (SELECT {ident}, {', '.join(f'{p} / {n} AS {p}' for p in PARTS)} FROM {src})"


def sums_cte(edges="edges", nodes="nodes", name="bs", ident="qid"):
    cols = ", ".join(f"{'1 + ' if p == 'rw' else ''}sum(weight * {p}) AS {p}" for p in PARTS)
    return f"{name} AS (SELECT {ident}, {cols} FROM {edges} JOIN {nodes} USING (node_id) GROUP BY {ident})"


def hamilton(a, b):
    return [f"({a[0]}*{b[0]} - {a[1]}*{b[1]} - {a[2]}*{b[2]} - {a[3]}*{b[3]})",
            f"({a[0]}*{b[1]} + {a[1]}*{b[0]} + {a[2]}*{b[3]} - {a[3]}*{b[2]})",
            f"({a[0]}*{b[2]} - {a[1]}*{b[3]} + {a[2]}*{b[0]} + {a[3]}*{b[1]})",
            f"({a[0]}*{b[3]} + {a[1]}*{b[2]} - {a[2]}*{b[1]} + {a[3]}*{b[0]})"]
