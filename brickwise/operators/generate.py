"""Generated volumes: the box phantom, hash noise and wound cells. Every voxel depends on its index only."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators.volume import lattice


@dataclass
class Phantom:
    """A hollow box with spherical pores; lengths in mm, coordinates from the centre of the volume."""

    size: int = 128
    pitch: float = 0.1
    outer: float = 8.0
    wall: float = 1.5
    air: int = 1000
    material: int = 20000
    #: Fixed values of the default scene: centre and radius of each pore.
    pores: list = field(default_factory=lambda: [(3.25, 0.0, 0.0, 0.40), (-3.25, 1.5, -1.0, 0.30), (0.5, -0.5, 3.25, 0.20)])


def box_distance(at: list[Column], half: float) -> Column:
    """Signed distance to a cube around the origin, negative inside."""
    d = [F.abs(c) - half for c in at]
    zero = F.lit(0.0)
    outside = F.sqrt(sum((F.greatest(x, zero) * F.greatest(x, zero) for x in d[1:]), F.greatest(d[0], zero) * F.greatest(d[0], zero)))
    return outside + F.least(F.greatest(*d), zero)


def box_phantom(spark: SparkSession, p: Phantom) -> DataFrame:
    """(x, y, z, grey): the linear partial volume clamp(0.5 - distance / pitch) between air and material."""
    at = [(F.col(c) + 0.5 - p.size / 2) * p.pitch for c in "xyz"]
    d = F.greatest(box_distance(at, p.outer / 2), -box_distance(at, p.outer / 2 - p.wall))
    for cx, cy, cz, r in p.pores:
        away = [(a - c) * (a - c) for a, c in zip(at, (cx, cy, cz), strict=True)]
        d = F.greatest(d, r - F.sqrt(away[0] + away[1] + away[2]))
    share = F.least(F.greatest(0.5 - d / p.pitch, F.lit(0.0)), F.lit(1.0))
    grid = lattice(spark, ((0, 0, 0), (p.size, p.size, p.size)))
    return grid.select("x", "y", "z", F.floor(p.air + share * (p.material - p.air) + 0.5).cast("int").alias("grey"))


def phantom_volume(p: Phantom) -> float:
    """The analytic material volume in mm3."""
    return p.outer**3 - (p.outer - 2 * p.wall) ** 3 - sum(4 / 3 * math.pi * r**3 for *_, r in p.pores)


def _mix(v: np.ndarray) -> np.ndarray:
    v = v + np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def gaussian_noise(seed: int, index: np.ndarray) -> np.ndarray:
    """Standard normal values that depend on seed and index only: two hashed uniforms by Box-Muller."""
    index = index.astype(np.uint64)
    seed = np.uint64(seed)
    h1, h2 = (_mix(seed ^ _mix(np.uint64(2) * index + np.uint64(k))) for k in (0, 1))
    scale = 2.0**-53
    u1 = ((h1 >> np.uint64(11)).astype(np.float64) + 1) * scale
    u2 = (h2 >> np.uint64(11)).astype(np.float64) * scale
    return np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)


def add_noise(voxels: DataFrame, nx: int, ny: int, sigma: float, seed: int) -> DataFrame:
    """Grey values with hash noise, clamped to 16 bits; the same however the rows are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, z, g = (b.column(k).to_numpy().astype(np.int64) for k in range(4))
            value = g + sigma * gaussian_noise(seed, x + nx * (y + ny * z))
            grey = np.clip(np.floor(value + 0.5), 0, 65535).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(grey)], names=["x", "y", "z", "grey"])

    return voxels.select("x", "y", "z", "grey").mapInArrow(run, "x int, y int, z int, grey int")


def wound_cell(spark: SparkSession, size: int = 64, turns: int = 5, pitch: float = 5.0, core: float = 4.0, levels: tuple[int, int, int, int] = (500, 9000, 3000, 14000)) -> DataFrame:
    """A spiral of alternating layers around the z axis inside a can: air, anode, separator gap, cathode."""
    air, anode, gap, cathode = levels
    c = size / 2 - 0.5
    dx, dy = F.col("x") - c, F.col("y") - c
    r = F.sqrt(dx * dx + dy * dy)
    turn = (F.atan2(dy, dx) / (2 * math.pi) + 1) % 1
    along = (r - core) / pitch - turn
    part = along - F.floor(along)
    grey = F.when((along < 0) | (along >= turns), F.lit(air)).when(part < 0.3, F.lit(anode)).when((part >= 0.5) & (part < 0.8), F.lit(cathode)).otherwise(F.lit(gap))
    can = core + pitch * (turns + 1)
    grey = F.when((r >= can) & (r < can + 2), F.lit(cathode)).otherwise(grey)
    return lattice(spark, ((0, 0, 0), (size, size, 4))).select("x", "y", "z", grey.cast("int").alias("grey"))
