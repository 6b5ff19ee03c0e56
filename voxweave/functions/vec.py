"""Three-component vectors of Columns and a few scalar helpers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def div(a, b) -> Column:
    """a / b, NULL where b is zero. Guarded in place: ANSI division raises and filters
    may be reordered past a projection."""
    return F.try_divide(as_col(a), as_col(b))


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(as_col(x), as_col(lo)), as_col(hi))


def lerp(a, b, t) -> Column:
    return as_col(a) + (as_col(b) - as_col(a)) * as_col(t)


def round_away(x: Column) -> Column:
    """Nearest integer, halves away from zero, as bigint."""
    return F.floor(F.abs(x) + F.lit(0.5)) * F.signum(x).cast("long")


def trunc(x: Column) -> Column:
    """Drop the fraction (toward zero), as bigint."""
    return F.floor(F.abs(x)) * F.signum(x).cast("long")


def clean(x, places: int = 6) -> Column:
    """Round for comparison and turn -0.0 into 0.0."""
    return F.round(as_col(x), places) + F.lit(0.0)


@dataclass(frozen=True)
class V3:
    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(prefix: str = "", suffix: str = "") -> "V3":
        return V3(*[F.col(f"{prefix}{a}{suffix}") for a in "xyz"])

    @staticmethod
    def lit(x: float, y: float, z: float) -> "V3":
        return V3(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    @staticmethod
    def field(struct: str) -> "V3":
        return V3(*[F.col(f"{struct}.{a}") for a in "xyz"])

    def __iter__(self):
        return iter((self.x, self.y, self.z))

    def _with(self, other, op) -> "V3":
        o = tuple(other) if isinstance(other, V3) else (as_col(other),) * 3
        return V3(*[op(a, b) for a, b in zip(self, o)])

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self._with(o, div)

    def __neg__(self):
        return V3(-self.x, -self.y, -self.z)

    def dot(self, o: "V3") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "V3") -> "V3":
        return V3(self.y * o.z - self.z * o.y,
                  self.z * o.x - self.x * o.z,
                  self.x * o.y - self.y * o.x)

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def distance(self, o: "V3") -> Column:
        return (self - o).length()

    def normalize(self) -> "V3":
        """Unit vector; NULL components for the zero vector."""
        return self / self.length()

    def min(self, o: "V3") -> "V3":
        return self._with(o, F.least)

    def max(self, o: "V3") -> "V3":
        return self._with(o, F.greatest)

    def abs(self) -> "V3":
        return V3(*[F.abs(a) for a in self])

    def floor(self) -> "V3":
        return V3(*[F.floor(a) for a in self])

    def clamp(self, lo, hi) -> "V3":
        return V3(*[clamp(a, lo, hi) for a in self])

    def lerp(self, o: "V3", t) -> "V3":
        return V3(*[lerp(a, b, t) for a, b in zip(self, o)])

    def reflect(self, normal: "V3") -> "V3":
        return self - normal * (self.dot(normal) * 2.0)

    def less(self, o: "V3") -> Column:
        return (self.x < o.x) & (self.y < o.y) & (self.z < o.z)

    def equals(self, o: "V3") -> Column:
        return (self.x == o.x) & (self.y == o.y) & (self.z == o.z)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def named(self, prefix: str = "", suffix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{a}{suffix}") for a, c in zip("xyz", self)]

    def as_map(self, prefix: str = "", suffix: str = "") -> dict[str, Column]:
        return {f"{prefix}{a}{suffix}": c for a, c in zip("xyz", self)}
