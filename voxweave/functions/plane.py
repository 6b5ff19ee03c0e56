"""Planes in Hessian form n.p + d = 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import V3, div


@dataclass(frozen=True)
class Plane:
    n: V3
    d: Column

    @staticmethod
    def from_point_normal(p: V3, n: V3) -> "Plane":
        u = n.normalize()
        return Plane(u, -u.dot(p))

    @staticmethod
    def from_points(a: V3, b: V3, c: V3) -> "Plane":
        return Plane.from_point_normal(a, (b - a).cross(c - a))

    def normalize(self) -> "Plane":
        m = self.n.length()
        return Plane(self.n / m, div(self.d, m))

    def signed_distance(self, p: V3) -> Column:
        return self.n.dot(p) + self.d

    def closest_point(self, p: V3) -> V3:
        return p - self.n * self.signed_distance(p)

    def intersect_line(self, a: V3, b: V3) -> V3:
        """Point where the line a-b meets the plane; NULL when parallel."""
        step = b - a
        return a + step * div(-self.signed_distance(a), self.n.dot(step))

    def intersect_plane(self, o: "Plane") -> tuple[V3, V3]:
        """(point, direction) of the common line; NULL when parallel."""
        direction = self.n.cross(o.n)
        den = direction.dot(direction)
        point = (o.n.cross(direction) * (-self.d) + direction.cross(self.n) * (-o.d)) / den
        return point, direction / F.sqrt(den)
