"""Small dense matrices whose entries are Columns, for poses and per-row algebra."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import V3, as_col, div


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


@dataclass(frozen=True)
class Mat:
    rows: tuple[tuple[Column, ...], ...]

    @staticmethod
    def build(values) -> "Mat":
        return Mat(tuple(tuple(as_col(v) for v in r) for r in values))

    @staticmethod
    def cols(names, n: int) -> "Mat":
        """Row-major matrix with ``n`` columns read from the named columns."""
        c = [F.col(x) for x in names]
        return Mat(tuple(tuple(c[i:i + n]) for i in range(0, len(c), n)))

    @staticmethod
    def zeros(n: int, m: int | None = None) -> "Mat":
        return Mat.build([[0.0] * (m or n) for _ in range(n)])

    @staticmethod
    def diagonal(values) -> "Mat":
        v = list(values)
        return Mat.build([[v[i] if i == j else 0.0 for j in range(len(v))] for i in range(len(v))])

    @staticmethod
    def identity(n: int) -> "Mat":
        return Mat.diagonal([1.0] * n)

    @staticmethod
    def outer(a, b) -> "Mat":
        return Mat(tuple(tuple(x * y for y in b) for x in a))

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rows), len(self.rows[0])

    def __getitem__(self, ij) -> Column:
        return self.rows[ij[0]][ij[1]]

    def map(self, f) -> "Mat":
        return Mat(tuple(tuple(f(x) for x in r) for r in self.rows))

    def zip(self, o: "Mat", f) -> "Mat":
        return Mat(tuple(tuple(f(x, y) for x, y in zip(a, b)) for a, b in zip(self.rows, o.rows)))

    def __add__(self, o):
        return self.zip(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self.zip(o, lambda a, b: a - b)

    def scale(self, s) -> "Mat":
        return self.map(lambda x: x * as_col(s))

    @property
    def T(self) -> "Mat":
        return Mat(tuple(zip(*self.rows)))

    def __matmul__(self, o):
        if isinstance(o, V3):
            return self.apply(o)
        return Mat(tuple(tuple(_sum([x * y for x, y in zip(r, c)]) for c in zip(*o.rows))
                         for r in self.rows))

    def apply(self, p: V3, w: float = 1.0) -> V3:
        """Transform a point (w=1) or a direction (w=0)."""
        out = []
        for r in self.rows[:3]:
            t = r[0] * p.x + r[1] * p.y + r[2] * p.z
            out.append(t + r[3] if len(r) > 3 and w else t)
        return V3(*out)

    def minor(self, i: int, j: int) -> "Mat":
        return Mat(tuple(tuple(x for b, x in enumerate(r) if b != j)
                         for a, r in enumerate(self.rows) if a != i))

    def block(self, i: int, j: int, n: int, m: int) -> "Mat":
        return Mat(tuple(r[j:j + m] for r in self.rows[i:i + n]))

    def with_block(self, i: int, j: int, o: "Mat") -> "Mat":
        g = [list(r) for r in self.rows]
        for a, r in enumerate(o.rows):
            g[i + a][j:j + len(r)] = r
        return Mat(tuple(map(tuple, g)))

    def det(self) -> Column:
        n = len(self.rows)
        if n == 1:
            return self.rows[0][0]
        if n == 2:
            (a, b), (c, d) = self.rows
            return a * d - b * c
        return _sum([self.rows[0][j] * self.minor(0, j).det() * F.lit(float((-1) ** j))
                     for j in range(n)])

    def inverse(self) -> "Mat":
        """Adjugate over determinant; NULL entries when singular."""
        d, n = self.det(), len(self.rows)
        if n == 1:
            return Mat(((div(1.0, d),),))
        return Mat(tuple(tuple(div(self.minor(j, i).det() * F.lit(float((-1) ** (i + j))), d)
                               for j in range(n)) for i in range(n)))

    def trace(self) -> Column:
        return _sum([self.rows[i][i] for i in range(len(self.rows))])

    def norm(self, kind: str = "fro") -> Column:
        flat = [x for r in self.rows for x in r]
        if kind == "fro":
            return F.sqrt(_sum([x * x for x in flat]))
        if kind == "max":
            return F.greatest(*[F.abs(x) for x in flat])
        groups = zip(*self.rows) if kind == "1" else self.rows
        sums = [_sum([F.abs(x) for x in g]) for g in groups]
        return F.greatest(*sums) if len(sums) > 1 else sums[0]

    def finite(self) -> Column:
        """False when any entry is NULL, NaN or infinite."""
        flat = [x for r in self.rows for x in r]
        ok = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in flat]
        return reduce(lambda a, b: a & b, ok)

    # Rigid 3x4 / 4x4 helpers -------------------------------------------------------
    def rotation(self) -> "Mat":
        return self.block(0, 0, 3, 3)

    def translation(self) -> V3:
        return V3(*[r[3] for r in self.rows[:3]])

    @staticmethod
    def rigid(rot: "Mat", t: V3, square: bool = True) -> "Mat":
        rows = [(*r, x) for r, x in zip(rot.rows, t)]
        if square:
            rows.append(tuple(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))
        return Mat(tuple(rows))

    def rigid_inverse(self) -> "Mat":
        rt = self.rotation().T
        return Mat.rigid(rt, -(rt @ self.translation()), square=len(self.rows) == 4)

    def named(self, prefix: str) -> list[Column]:
        return [x.alias(f"{prefix}{i}{j}") for i, r in enumerate(self.rows) for j, x in enumerate(r)]


def pose_literal(matrix) -> Mat:
    """A 4x4 NumPy pose as literals (one fixed camera, no join needed)."""
    return Mat.build([[float(v) for v in r] for r in matrix])


def sum_rows(v: V3) -> Column:
    return v.x + v.y + v.z


def idx2c(i, j, ld):
    """Column-major 0-based linear index."""
    return as_int(j) * as_int(ld) + as_int(i)


def idx2f(i, j, ld):
    """Column-major index with 1-based i and j."""
    return (as_int(j) - 1) * as_int(ld) + as_int(i) - 1


def as_int(v) -> Column:
    return v if isinstance(v, Column) else F.lit(int(v))
