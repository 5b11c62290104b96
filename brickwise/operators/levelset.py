"""Distances to the iso surface as codes around it, and the surface back from the codes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.operators.filters import with_halo
from brickwise.operators.surface import decoded, encode, extract_surface, iso_triangles

#: Pairs of a triangle and a voxel whose distance is taken at once.
PAIRS = 400_000


def squared_distances(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Exact squared distances of points (n, 3) to triangles (n, 3, 3), one of each: to the plane where the foot of the
    perpendicular lies in the triangle, else to the nearest of its three sides."""
    normal = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    size = (normal**2).sum(1)
    within = size > 0
    best = np.full(len(p), np.inf)
    for k in range(3):
        a, side = t[:, k], t[:, (k + 1) % 3] - t[:, k]
        away = p - a
        within &= (np.cross(side, away) * normal).sum(1) >= 0
        share = np.clip((away * side).sum(1) / np.maximum((side**2).sum(1), 1e-300), 0, 1)
        best = np.minimum(best, ((away - share[:, None] * side) ** 2).sum(1))
    height = ((p - t[:, 0]) * normal).sum(1) ** 2 / np.maximum(size, 1e-300)
    return np.where(within, height, best)


def band_distances(triangles: np.ndarray, shape: tuple[int, int, int], band: float) -> np.ndarray:
    """Distances of the voxels [x, y, z] of a box to the nearest of the triangles, infinite where it is band or more. A triangle meets
    the voxels of its own box, band wider, only."""
    out = np.full(shape, np.inf)
    flat = out.reshape(-1)
    lo, hi = np.ceil(triangles.min(1) - band).astype(int), np.floor(triangles.max(1) + band).astype(int)
    lo, hi = np.maximum(lo, 0), np.minimum(hi, np.array(shape) - 1)
    sides = np.maximum(hi - lo + 1, 0)
    counts = sides.prod(1)
    ends = counts.cumsum()
    at = 0
    while at < len(triangles):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = counts[at:stop]
        own = np.repeat(np.arange(at, stop), n)
        k = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        s = sides[own]
        place = lo[own] + np.stack([k // (s[:, 1] * s[:, 2]), k // s[:, 2] % s[:, 1], k % s[:, 2]], 1)
        np.minimum.at(flat, np.ravel_multi_index(tuple(place.T), shape), squared_distances(place.astype(float), triangles[own]))
        at = stop
    np.sqrt(flat, out=flat)
    flat[flat >= band] = np.inf
    return out


def signed_distances(voxels: DataFrame, iso: float, band: float = 3.0, brick: int = 32, fill: float = 0.0) -> DataFrame:
    """(x, y, z, distance), in voxels, of every voxel, given or not, that is less than band from the iso surface: the exact
    distance to the nearest of its triangles, negative where the value is iso or more. Bricks with a halo of the band and
    one cell more are kernels. A volume without the surface gives no rows."""
    halo = int(math.ceil(band)) + 1

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = brick + 2 * halo
        base = np.array(key) * brick - halo
        grey = np.full((n, n, n), fill, dtype=float)
        grey[tuple(pdf[c].to_numpy() - b for c, b in zip("xyz", base, strict=True))] = pdf["grey"]
        inner = (slice(halo, halo + brick),) * 3
        d = band_distances(iso_triangles(grey, iso) - halo, (brick,) * 3, band)
        at = np.argwhere(np.isfinite(d))
        distance = np.where(grey[inner] >= iso, -d, d)[tuple(at.T)]
        place = at + base + halo
        return pd.DataFrame({"x": place[:, 0], "y": place[:, 1], "z": place[:, 2], "distance": distance})

    return with_halo(voxels.select("x", "y", "z", "grey"), brick, halo).groupBy("tx", "ty", "tz").applyInPandas(run, "x int, y int, z int, distance double")


def surface_codes(voxels: DataFrame, iso: float, band: float = 3.0, bits: int = 8, brick: int = 32, fill: float = 0.0) -> DataFrame:
    """(x, y, z, code): the surface as a mask. Codes of the band are its distances; 0 is the material inside of it. What has no row is outside."""
    near = encode(signed_distances(voxels, iso, band, brick, fill), "distance", band, bits).select("x", "y", "z", "code")
    deep = voxels.where(F.col("grey") >= iso).select("x", "y", "z").join(near.select("x", "y", "z"), ["x", "y", "z"], "left_anti")
    return near.unionByName(deep.withColumn("code", F.lit(0)))


def level_set(codes: DataFrame, band: float = 3.0, bits: int = 8) -> DataFrame:
    """(x, y, z, distance) of the codes; the two codes beyond the band are its ends."""
    d = F.when(F.col("code") == 0, F.lit(-band)).when(F.col("code") == 2**bits - 1, F.lit(band)).otherwise(decoded(F.col("code"), band, bits))
    return codes.select("x", "y", "z", d.alias("distance"))


def surface_of_codes(codes: DataFrame, band: float = 3.0, bits: int = 8, brick: int = 32) -> DataFrame:
    """The triangles (x1 .. z3) of the surface that codes tell, where the distance is zero; they wind outward."""
    return extract_surface(level_set(codes, band, bits).select("x", "y", "z", (-F.col("distance")).alias("grey")), 0.0, brick, -band)
