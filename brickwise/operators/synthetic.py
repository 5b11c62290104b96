"""Synthetic scans: parts by signed distances, defects with a known volume, blur, cupping, rings and correlated noise, and
battery cells with known layers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from brickwise.operators import bricks
from brickwise.operators.generate import gaussian_noise

Place = tuple[np.ndarray, np.ndarray, np.ndarray]
Distance = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def box(half: tuple[float, float, float], at: tuple[float, float, float] = (0, 0, 0)) -> Distance:
    def distance(x, y, z):
        d = [np.abs(c - o) - h for c, o, h in zip((x, y, z), at, half, strict=True)]
        out = sum(np.maximum(c, 0.0) ** 2 for c in d)
        return np.sqrt(out) + np.minimum(np.maximum(np.maximum(d[0], d[1]), d[2]), 0.0)

    return distance


def cylinder(radius: float, half: float, axis: int = 2, at: tuple[float, float, float] = (0, 0, 0)) -> Distance:
    def distance(x, y, z):
        p = [c - o for c, o in zip((x, y, z), at, strict=True)]
        along = p.pop(axis)
        d = [np.sqrt(p[0] ** 2 + p[1] ** 2) - radius, np.abs(along) - half]
        return np.sqrt(np.maximum(d[0], 0.0) ** 2 + np.maximum(d[1], 0.0) ** 2) + np.minimum(np.maximum(d[0], d[1]), 0.0)

    return distance


def ball(radius: float, at: tuple[float, float, float] = (0, 0, 0)) -> Distance:
    return lambda x, y, z: np.sqrt((x - at[0]) ** 2 + (y - at[1]) ** 2 + (z - at[2]) ** 2) - radius


def union(*parts: Distance) -> Distance:
    def distance(x, y, z):
        out = parts[0](x, y, z)
        for p in parts[1:]:
            out = np.minimum(out, p(x, y, z))
        return out

    return distance


def less(part: Distance, *holes: Distance) -> Distance:
    def distance(x, y, z):
        out = part(x, y, z)
        for h in holes:
            out = np.maximum(out, -h(x, y, z))
        return out

    return distance


def sample_part(name: str, scale: float = 1.0) -> Distance:
    """Parts to test with, about 20 mm wide: housing, bracket, hub and bellhousing, of walls, bores and ribs."""
    s = scale
    if name == "housing":
        shell = less(box((10 * s, 8 * s, 5 * s)), box((8.5 * s, 6.5 * s, 4 * s), (0, 0, 1.5 * s)))
        posts = [cylinder(1.5 * s, 4 * s, 2, (x * 7 * s, y * 5 * s, 0)) for x in (-1, 1) for y in (-1, 1)]
        return less(union(shell, *posts), *[cylinder(0.7 * s, 6 * s, 2, (x * 7 * s, y * 5 * s, 0)) for x in (-1, 1) for y in (-1, 1)])
    if name == "bracket":
        legs = union(box((10 * s, 4 * s, 1 * s), (0, 0, -5 * s)), box((1 * s, 4 * s, 6 * s), (-9 * s, 0, 0)), box((4 * s, 0.6 * s, 4 * s), (-5 * s, 0, -1 * s)))
        return less(legs, cylinder(1.2 * s, 2 * s, 2, (5 * s, 0, -5 * s)), cylinder(1.2 * s, 2 * s, 0, (-9 * s, 0, 3 * s)))
    if name == "hub":
        body = union(cylinder(9 * s, 1.2 * s, 2, (0, 0, -3 * s)), cylinder(4 * s, 5 * s))
        holes = [cylinder(0.8 * s, 2 * s, 2, (6.5 * s * math.cos(a), 6.5 * s * math.sin(a), -3 * s)) for a in np.arange(6) * math.pi / 3]
        return less(body, cylinder(2.4 * s, 6 * s), *holes)
    if name == "bellhousing":
        return less(union(cylinder(9 * s, 4 * s, 2, (0, 0, -2 * s)), cylinder(4 * s, 6 * s)), cylinder(7.8 * s, 4 * s, 2, (0, 0, -3.2 * s)), cylinder(2.5 * s, 7 * s))
    raise ValueError(f"no sample part {name!r}")


def ball_overlap(x: np.ndarray, y: np.ndarray, z: np.ndarray, at: tuple[float, float, float], radius: float, pitch: float, parts: int = 6) -> np.ndarray:
    """The share of each voxel, a cube of a pitch around (x, y, z), that a ball takes. A voxel wholly inside or outside is
    known by its distance; the others are cut into parts, each of which counts by its own distance, so that balls smaller
    than a voxel keep their volume: shares are scaled to the ball's exact volume."""
    d = np.sqrt((x - at[0]) ** 2 + (y - at[1]) ** 2 + (z - at[2]) ** 2)
    corner = pitch * math.sqrt(3) / 2
    share = (d <= radius - corner).astype(float)
    mixed = np.nonzero(np.abs(d - radius) < corner) if radius >= corner else np.nonzero(d < radius + corner)
    if len(mixed[0]):
        wide = np.broadcast_arrays(x, y, z)
        centre = np.stack([c[mixed] for c in wide], -1)
        sub = (np.arange(parts) + 0.5) / parts - 0.5
        grid = np.stack(np.meshgrid(sub, sub, sub, indexing="ij"), -1).reshape(-1, 3) * pitch
        away = np.sqrt(((centre[:, None] + grid[None] - np.array(at)) ** 2).sum(-1))
        share[mixed] = np.clip(0.5 - (away - radius) * parts / pitch, 0, 1).mean(1)
    total, exact = share.sum() * pitch**3, 4 / 3 * math.pi * radius**3
    inside = all((np.min(c) - pitch / 2 <= o - radius) and (np.max(c) + pitch / 2 >= o + radius) for c, o in zip((x, y, z), at, strict=True))
    return share * (exact / total) if total > 0 and inside else share


@dataclass
class Scan:
    """A part scanned into a cube of voxels; lengths in mm from its centre, grey values of air and material."""

    part: Distance
    size: int = 96
    pitch: float = 0.25
    air: float = 1000.0
    material: float = 20000.0
    balls: list[tuple[tuple[float, float, float], float]] = field(default_factory=list)
    zones: list[tuple[tuple[float, float, float], float, float]] = field(default_factory=list)
    noise: float = 0.0
    correlation: int = 0
    cupping: float = 0.0
    rings: float = 0.0
    blur: float = 0.0
    seed: int = 42


def _correlated(seed: int, x: np.ndarray, y: np.ndarray, z: np.ndarray, size: int, radius: int) -> np.ndarray:
    """Hash noise averaged over neighbours along x and scaled back to unit variance, so that it needs no exchange."""
    index = lambda dx: (x + dx) % size + size * (y + size * z.astype(np.int64))
    total = sum(gaussian_noise(seed, index(d)) for d in range(-radius, radius + 1))
    return total / math.sqrt(2 * radius + 1)


def scan(spark: SparkSession, s: Scan) -> DataFrame:
    """The bricks of a synthetic scan. Blur widens the linear transition at surfaces, cupping darkens by depth, rings wave
    around the axis of rotation; balls are cut out with their exact volume and zones lose a share of their material."""

    def values(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        at = [(c + 0.5 - s.size / 2) * s.pitch for c in (x, y, z)]
        d = np.broadcast_to(s.part(*at), np.broadcast_shapes(x.shape, y.shape, z.shape))
        width = s.pitch * (1 + 2 * s.blur)
        share = np.clip(0.5 - d / width, 0, 1)
        for centre, radius in s.balls:
            if all(np.abs(a - c).min() <= radius + 2 * s.pitch for a, c in zip(at, centre, strict=True)):
                share = share - np.minimum(share, ball_overlap(*at, centre, radius, s.pitch))
        for centre, radius, lost in s.zones:
            away = np.sqrt(sum((a - c) ** 2 for a, c in zip(at, centre, strict=True)))
            share = share * (1 - lost * np.clip(1 - away / radius, 0, 1))
        contrast = s.material - s.air
        if s.cupping:
            contrast = contrast * (1 - s.cupping * (1 - np.exp(np.minimum(d, 0) / (8 * s.pitch))))
        got = s.air + share * contrast
        if s.rings:
            got = got + s.rings * np.sin(2 * math.pi * np.sqrt(at[0] ** 2 + at[1] ** 2) / (6 * s.pitch))
        if s.noise:
            got = got + s.noise * (_correlated(s.seed, x, y, z, s.size, s.correlation) if s.correlation else gaussian_noise(s.seed, x + s.size * (y + s.size * z.astype(np.int64))))
        return got

    return bricks.generate(spark, (s.size,) * 3, values)


def ground_truth(s: Scan) -> pd.DataFrame:
    """The defects of a scan: type, centre, radius and void volume in mm3; a zone's void is its share over its ball."""
    rows = [("pore", *c, r, 4 / 3 * math.pi * r**3) for c, r in s.balls] + [("zone", *c, r, lost * math.pi / 3 * r**3) for c, r, lost in s.zones]
    return pd.DataFrame(rows, columns=["type", "x", "y", "z", "radius_mm", "void_volume_mm3"])


def stacked_cell(spark: SparkSession, size: tuple[int, int, int] = (64, 56, 48), cathodes: int = 5, overhang: int = 6, margin: int = 6, levels: tuple[int, int, int, int] = (500, 9000, 3000, 14000), voids: list | None = None, particles: list | None = None) -> DataFrame:
    """The bricks of a stacked battery cell: sheets square to z in turn anode, separator, cathode, separator, anodes at
    both ends; cathodes are shorter by the overhang at every edge. Voids and particles are (x, y, z, radius) in voxels."""
    air, anode, gap, cathode = levels
    sheets = 2 * cathodes + 1
    room = size[2] - 2 * margin
    thick = room / (2 * sheets - 1)

    def values(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        k = np.floor((z + 0.5 - margin) / thick)
        inside = (k >= 0) & (k < 2 * sheets - 1)
        sheet = k // 2
        edge = np.minimum(np.minimum(x - margin, size[0] - 1 - margin - x), np.minimum(y - margin, size[1] - 1 - margin - y))
        got = np.where(k % 2 == 1, gap, np.where(sheet % 2 == 0, anode, np.where(edge >= overhang, cathode, gap)))
        got = np.where(inside & (edge >= 0), got, air).astype(float)
        for some, level in ((voids or [], air), (particles or [], 2 * cathode)):
            for cx, cy, cz, r in some:
                got = np.where((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2 <= r * r, level, got)
        return got

    return bricks.generate(spark, size, values)
