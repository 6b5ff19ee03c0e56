"""Immutable run settings. Defaults follow the 640x480 sensor set-up of the mapping program."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Sensor:
    rows: int = 480
    cols: int = 640
    fx: float = 525.0
    fy: float = 525.0
    cx: float = 319.5
    cy: float = 239.5
    depth_scale: float = 5000.0

    def resized(self, rows: int, cols: int) -> "Sensor":
        """The same optics at another resolution: f and c follow the size ratio."""
        sx, sy = cols / self.cols, rows / self.rows
        return replace(self, rows=rows, cols=cols, fx=self.fx * sx, fy=self.fy * sy,
                       cx=self.cx * sx, cy=self.cy * sy)


@dataclass(frozen=True)
class Tsdf:
    voxel_size: float = 0.01
    block_size: int = 8
    truncation: float = 0.05
    max_weight: int = 64
    min_depth: float = 0.15
    max_depth: float = 2.0
    buckets: int = 2500
    bucket_size: int = 10

    @property
    def block_edge(self) -> float:
        return self.voxel_size * self.block_size


@dataclass(frozen=True)
class Rigid:
    """Gauss-Newton settings; ``iterations`` are per pyramid level, coarse to fine."""

    scales: tuple[int, ...] = (4, 2, 1)
    iterations: tuple[int, ...] = (0, 0, 19)
    regularization: float = 0.02
    min_increment: float = 0.001
    max_increment: float = 0.3
    min_depth: float = 0.15
    max_depth: float = 2.0
    normal_angle: float = math.pi / 10
    robust: str = "none"
    robust_k: float = 1.345
    checkpoint_every: int = 4


@dataclass(frozen=True)
class Graph:
    nodes: int = 273
    k: int = 4
    radius: float = 0.015
    exp_weight: bool = True


@dataclass(frozen=True)
class NonRigid:
    iterations: int = 4
    regularization: float = 0.0
    epsilon: float = 1e-6
    converged: float = 1e-6
    damping: float = 1e-9
    leaf: int = 64      # nodes of a cell that is eliminated at once
    normal_angle: float = math.pi / 10   # of a warped vertex and the live pixel that it falls on
    max_distance: float = 0.1


def from_mapping(cls, values: dict):
    """Build a settings object from a parsed parameter file; unknown keys are ignored."""
    names = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in values.items() if k in names})
