"""Unit dual quaternions: real = rotation r, dual = (0, t) r / 2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mat import Mat
from .quat import Quat
from .vec import V3, div

PARTS = ("rw", "rx", "ry", "rz", "dw", "dx", "dy", "dz")


@dataclass(frozen=True)
class DualQuat:
    real: Quat
    dual: Quat

    @staticmethod
    def of(prefix: str = "") -> "DualQuat":
        c = [F.col(f"{prefix}{p}") for p in PARTS]
        return DualQuat(Quat(*c[:4]), Quat(*c[4:]))

    @staticmethod
    def identity() -> "DualQuat":
        return DualQuat(Quat.lit(1, 0, 0, 0), Quat.lit(0, 0, 0, 0))

    @staticmethod
    def rigid(q: Quat, t: V3) -> "DualQuat":
        return DualQuat(q, Quat.pure(t) * q * 0.5)

    @staticmethod
    def from_euler(roll, pitch, yaw, t: V3) -> "DualQuat":
        return DualQuat.rigid(Quat.from_euler(roll, pitch, yaw), t)

    @staticmethod
    def from_matrix(m: Mat) -> "DualQuat":
        return DualQuat.rigid(Quat.from_matrix(m), m.translation())

    def __iter__(self):
        return iter((*self.real, *self.dual))

    def __add__(self, o):
        return DualQuat(self.real + o.real, self.dual + o.dual)

    def __mul__(self, o):
        if not isinstance(o, DualQuat):
            return DualQuat(self.real * o, self.dual * o)
        return DualQuat(self.real * o.real, self.real * o.dual + self.dual * o.real)

    def __truediv__(self, o):
        return self * o.inverse()

    def dot(self, o: "DualQuat") -> Column:
        return self.real.dot(o.real)

    def equals(self, o: "DualQuat") -> Column:
        return self.real.equals(o.real) & self.dual.equals(o.dual)

    def scale_to_unit(self) -> "DualQuat":
        """Divide both parts by |real|."""
        n = self.real.norm()
        return DualQuat(Quat(*[div(a, n) for a in self.real]), Quat(*[div(a, n) for a in self.dual]))

    normalize = scale_to_unit

    def conjugate(self) -> "DualQuat":
        return DualQuat(self.real.conjugate(), self.dual.conjugate())

    def inverse(self) -> "DualQuat":
        r = self.real.inverse()
        d = r * self.dual * r
        return DualQuat(r, d * -1.0)

    def rotation(self) -> Quat:
        return self.real

    def translation(self) -> V3:
        return (self.dual * self.real.conjugate() * 2.0).vector

    def add_translation(self, t: V3) -> "DualQuat":
        """Move by t after this transform."""
        return DualQuat(self.real, self.dual + Quat.pure(t) * self.real * 0.5)

    def add_rotation(self, q: Quat) -> "DualQuat":
        """Rotate by q after this transform."""
        return DualQuat(q * self.real, q * self.dual)

    def rotate(self, v: V3) -> V3:
        return self.real.rotate(v)

    def matrix(self) -> Mat:
        return Mat.rigid(self.real.matrix(), self.translation())

    def transform_position(self, p: V3) -> V3:
        r, d = self.real, self.dual
        shift = (d.vector * r.w - r.vector * d.w + r.vector.cross(d.vector)) * 2.0
        return r.rotate(p) + shift

    def transform_normal(self, n: V3) -> V3:
        return self.real.rotate(n)

    def euler(self) -> V3:
        return self.real.euler()

    def axis_angle(self) -> tuple[V3, Column]:
        return self.real.axis_angle()

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{p}") for p, c in zip(PARTS, self)]

    def as_map(self, prefix: str = "") -> dict[str, Column]:
        return {f"{prefix}{p}": c for p, c in zip(PARTS, self)}
