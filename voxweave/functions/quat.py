"""Quaternions (Hamilton product, active rotations), Euler angles and axis-angle."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mat import Mat
from .vec import V3, as_col, div


@dataclass(frozen=True)
class Quat:
    w: Column
    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(prefix: str = "q") -> "Quat":
        return Quat(*[F.col(f"{prefix}{a}") for a in "wxyz"])

    @staticmethod
    def lit(w, x, y, z) -> "Quat":
        return Quat(*[F.lit(float(v)) for v in (w, x, y, z)])

    @staticmethod
    def pure(v: V3) -> "Quat":
        return Quat(F.lit(0.0), v.x, v.y, v.z)

    @staticmethod
    def from_euler(roll, pitch, yaw) -> "Quat":
        """Rotation Rz(yaw) Ry(pitch) Rx(roll)."""
        angles = [as_col(a) * 0.5 for a in (roll, pitch, yaw)]
        return Quat.from_half_angles([F.cos(a) for a in angles], [F.sin(a) for a in angles])

    @staticmethod
    def from_half_angles(c, s) -> "Quat":
        """Cosines and sines of half the roll, pitch and yaw."""
        return Quat(c[2] * c[1] * c[0] + s[2] * s[1] * s[0],
                    c[2] * c[1] * s[0] - s[2] * s[1] * c[0],
                    s[2] * c[1] * s[0] + c[2] * s[1] * c[0],
                    s[2] * c[1] * c[0] - c[2] * s[1] * s[0])

    @staticmethod
    def from_axis_angle(axis: V3, theta) -> "Quat":
        h = as_col(theta) * 0.5
        v = axis.normalize() * F.sin(h)
        return Quat(F.cos(h), v.x, v.y, v.z)

    @staticmethod
    def from_matrix(m: Mat) -> "Quat":
        """Branch on the largest of trace and diagonal, so the divisor is never small."""
        r = m.rows
        t = r[0][0] + r[1][1] + r[2][2]
        biggest = F.greatest(t, r[0][0], r[1][1], r[2][2])

        def branch(w, x, y, z):
            n = F.sqrt(w * w + x * x + y * y + z * z)
            return [div(c, n) for c in (w, x, y, z)]

        d21, d02, d10 = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]
        s01, s02, s12 = r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
        by_w = branch(1.0 + t, d21, d02, d10)
        by_x = branch(d21, 1.0 + r[0][0] - r[1][1] - r[2][2], s01, s02)
        by_y = branch(d02, s01, 1.0 + r[1][1] - r[0][0] - r[2][2], s12)
        by_z = branch(d10, s02, s12, 1.0 + r[2][2] - r[0][0] - r[1][1])
        out = [F.when(biggest == t, a).when(biggest == r[0][0], b)
                .when(biggest == r[1][1], c).otherwise(d)
               for a, b, c, d in zip(by_w, by_x, by_y, by_z)]
        return Quat(*out)

    def __iter__(self):
        return iter((self.w, self.x, self.y, self.z))

    @property
    def vector(self) -> V3:
        return V3(self.x, self.y, self.z)

    def __add__(self, o):
        return Quat(*[a + b for a, b in zip(self, o)])

    def __sub__(self, o):
        return Quat(*[a - b for a, b in zip(self, o)])

    def __mul__(self, o):
        if not isinstance(o, Quat):
            return Quat(*[a * as_col(o) for a in self])
        return Quat(self.w * o.w - self.x * o.x - self.y * o.y - self.z * o.z,
                    self.w * o.x + self.x * o.w + self.y * o.z - self.z * o.y,
                    self.w * o.y - self.x * o.z + self.y * o.w + self.z * o.x,
                    self.w * o.z + self.x * o.y - self.y * o.x + self.z * o.w)

    def __truediv__(self, o):
        if isinstance(o, Quat):
            return self * o.inverse()
        return Quat(*[div(a, o) for a in self])

    def equals(self, o: "Quat") -> Column:
        return (self.w == o.w) & (self.x == o.x) & (self.y == o.y) & (self.z == o.z)

    def dot(self, o: "Quat") -> Column:
        return self.w * o.w + self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "Quat") -> V3:
        return self.vector.cross(o.vector)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def normalize(self) -> "Quat":
        return self / self.norm()

    unit = normalize

    def conjugate(self) -> "Quat":
        return Quat(self.w, -self.x, -self.y, -self.z)

    def inverse(self) -> "Quat":
        return self.conjugate() / self.dot(self)

    def rotate(self, v: V3) -> V3:
        q = self.vector
        return v + q.cross(q.cross(v) + v * self.w) * 2.0

    def matrix(self) -> Mat:
        w, x, y, z = self
        return Mat.build([
            [1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y)],
            [2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x)],
            [2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y)]])

    def euler(self) -> V3:
        """(roll, pitch, yaw); pitch saturates at a quarter turn."""
        w, x, y, z = self
        sp = 2.0 * (w * y - z * x)
        pitch = F.when(F.abs(sp) >= 1.0, F.signum(sp) * (math.pi / 2)).otherwise(
            F.asin(F.least(F.greatest(sp, F.lit(-1.0)), F.lit(1.0))))
        return V3(F.atan2(2.0 * (w * x + y * z), 1.0 - 2.0 * (x * x + y * y)), pitch,
                  F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z)))

    def axis_angle(self) -> tuple[V3, Column]:
        n = self.vector.length()
        return self.vector / n, 2.0 * F.atan2(n, self.w)

    def named(self, prefix: str = "q") -> list[Column]:
        return [c.alias(f"{prefix}{a}") for a, c in zip("wxyz", self)]


def euler_from_matrix(m: Mat) -> V3:
    """ZYX Euler angles (roll, pitch, yaw) of a rotation matrix."""
    r = m.rows
    return V3(F.atan2(r[2][1], r[2][2]),
              F.atan2(-r[2][0], F.sqrt(r[2][1] * r[2][1] + r[2][2] * r[2][2])),
              F.atan2(r[1][0], r[0][0]))
