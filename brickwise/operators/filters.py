"""Noise, gradients, denoising and beam-hardening statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.operators.distance import squared_transform
from brickwise.operators.histogram import upper_median
from brickwise.operators.volume import neighbours


def mad_sigma(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """1.4826 times the upper median of the distances to the upper median."""
    centre = upper_median(values, value, by)
    away = values.join(centre, by).select(*by, F.abs(F.col(value) - F.col("median")).alias("d"))
    return upper_median(away, "d", by).select(*by, (1.4826 * F.col("median")).alias("sigma"))


def pair_variances(voxels: DataFrame) -> DataFrame:
    """(dx, dy, dz, n, variance): mean squared differences of voxels and their neighbours, one of each opposite pair."""
    pairs = neighbours(voxels, 26).join(voxels, ["x", "y", "z"])
    ahead = F.struct("dz", "dy", "dx") > F.struct(F.lit(0), F.lit(0), F.lit(0))
    d = (F.col("grey") - F.col("other")).cast("long")
    return pairs.where(ahead).groupBy("dx", "dy", "dz").agg(F.count("*").alias("n"), (F.sum(d * d) / F.count("*")).alias("variance"))


def structure_tensors(voxels: DataFrame, size: int = 16) -> DataFrame:
    """Sums of products of central differences (twice the gradient) in each block, over voxels with all six neighbours."""
    n = neighbours(voxels, 6)
    pick = lambda c, d: F.max(F.when(F.col(f"d{c}") == d, F.col("other")))
    g = n.groupBy("x", "y", "z").agg(F.count("*").alias("n"), *[(pick(c, 1) - pick(c, -1)).cast("long").alias(f"g{c}") for c in "xyz"]).where("n = 6")
    keys = [F.floor(F.col(c) / size).cast("int").alias(f"b{c}") for c in "xyz"]
    return g.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col(f"g{a}") * F.col(f"g{b}")).alias(a + b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])


def fibre_directions(tensors: DataFrame, least: int) -> DataFrame:
    """tensors with direction (eigenvector of the least eigenvalue, its largest component positive) and coherence."""

    def run(batches):
        for pdf in batches:
            m = np.stack([pdf[["xx", "xy", "xz"]].to_numpy(float), pdf[["xy", "yy", "yz"]].to_numpy(float), pdf[["xz", "yz", "zz"]].to_numpy(float)], axis=1)
            values, vectors = np.linalg.eigh(m)
            v = vectors[:, :, 0]
            sign = np.sign(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1))
            yield pdf[["bx", "by", "bz", "n"]].assign(direction=list(v * np.where(sign == 0, 1, sign)), coherence=1 - values[:, 0] / np.maximum(values[:, 1], 1e-12))

    return tensors.where(F.col("n") >= least).mapInPandas(run, "bx int, by int, bz int, n long, direction array<double>, coherence double")


def orientation_tensor(directions: DataFrame) -> DataFrame:
    """The weighted mean of p p^T over blocks."""
    p = [F.get("direction", F.lit(k)) for k in range(3)]
    w = F.col("coherence") * F.col("n")
    return directions.agg(*[(F.sum(w * p[a] * p[b]) / F.sum(w)).alias(f"a{a}{b}") for a in range(3) for b in range(a, 3)])


def cupping_profile(rows: DataFrame, value: str, depth: str, width: float, least: int = 8) -> DataFrame:
    """(bin, level, relative): upper medians by depth bin, and by the core: the median level of the deepest fifth."""
    tagged = rows.select(F.floor(F.col(depth) / width + 0.5).cast("int").alias("bin"), F.col(value).cast("double").alias("v"))
    enough = tagged.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    levels = upper_median(tagged.join(enough, "bin", "left_semi"), "v", ["bin"]).select("bin", F.col("median").alias("level"))
    top = levels.agg(F.max("bin").alias("top"))
    deep = levels.join(F.broadcast(top)).where(F.col("bin") > 0.8 * F.col("top")).select("level", F.lit(1).alias("one"))
    core = upper_median(deep, "level", ["one"]).select(F.col("median").alias("core"))
    return levels.join(F.broadcast(core)).select("bin", "level", (F.col("level") / F.col("core")).alias("relative"))


def depth_correction(rows: DataFrame, value: str, depth: str, width: float, levels: DataFrame, floor: float = 0.1) -> DataFrame:
    """rows with value scaled by the level at the surface over the level at its depth, by no less than a floor. The
    level table has a row for each depth bin."""
    surface = levels.agg(F.min_by("level", "bin").alias("surface"))
    tagged = rows.withColumn("bin", F.floor(F.col(depth) / width + 0.5).cast("int")).join(F.broadcast(surface))
    both = tagged.join(levels.select("bin", "level"), "bin", "left")
    scale = F.greatest(F.col("surface") / F.coalesce("level", "surface"), F.lit(floor))
    return both.withColumn("value", F.col(value) * scale)


def score(rows: DataFrame) -> DataFrame:
    """Mean absolute error, RMSE, and RMSE over material, of (found, truth, material)."""
    d = (F.col("found") - F.col("truth")).cast("double")
    return rows.agg(F.avg(F.abs(d)).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"), F.sqrt(F.avg(F.when(F.col("material"), d * d))).alias("rmse_material"))


def with_halo(voxels: DataFrame, brick: int, halo: int) -> DataFrame:
    """Voxels dealt to every brick that needs them: their own and those whose halo reaches them. (tx, ty, tz) names the
    brick; about 6 halo / brick of the data is copied."""
    df = voxels
    for c in "xyz":
        lo, hi = F.floor((F.col(c) - halo) / brick).cast("int"), F.floor((F.col(c) + halo) / brick).cast("int")
        df = df.withColumn(f"t{c}", F.explode(F.sequence(lo, hi)))
    return df


def _box_sums(a: np.ndarray, radius: int) -> np.ndarray:
    """Sums over boxes of 2 radius + 1 values a side around every place; what lies outside is zero."""
    for axis in range(a.ndim):
        line = np.moveaxis(a, axis, 0)
        out = line.copy()
        for k in range(1, radius + 1):
            out[k:] += line[:-k]
            out[:-k] += line[k:]
        a = np.moveaxis(out, 0, axis)
    return a


def patch_means(grey: np.ndarray, active: np.ndarray, sigma: float, strength: float, search: int, patch: int, cut: float) -> np.ndarray:
    """Non-local means of the values of a box, right where search + patch places around lie in the box. A pair of places is
    compared once and weighs the same for both, so half of the offsets do."""
    total, weight, top = np.zeros_like(grey), np.zeros_like(grey), np.zeros_like(grey)
    full = bool(active.all())
    reach = range(-search, search + 1)
    for offset in [(i, j, k) for i in reach for j in reach for k in reach if (i, j, k) > (0, 0, 0)]:
        here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(offset, grey.shape, strict=True))
        there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(offset, grey.shape, strict=True))
        d = grey[here] - grey[there]
        d *= d
        if full:
            m, ok = float((2 * patch + 1) ** 3), True
        else:
            both = active[here] * active[there]
            d *= both
            m, ok = np.maximum(_box_sums(both, patch), 1), both > 0
        r = _box_sums(d, patch)
        r /= m
        r /= 2 * sigma * sigma
        r = np.where((r <= cut) & ok, r, np.inf)
        w = np.exp(-r / strength)
        for own, other in ((here, there), (there, here)):
            total[own] += w * grey[other]
            weight[own] += w
            np.maximum(top[own], w, out=top[own])
    own = np.where(top > 0, top, 1.0)
    return (total + own * grey) / (weight + own)


def non_local_means(voxels: DataFrame, sigma: float, strength: float = 1.0, search: int = 3, patch: int = 1, cut: float = 1.3, brick: int = 32) -> DataFrame:
    """(x, y, z, value): each active voxel as the mean of the voxels around it, weighted by how alike their patches are.
    Weights are exp(-r / strength) for r, the mean squared patch difference over twice the noise variance, up to
    a cut; a voxel's own weight is the largest of the others. Bricks with a halo of search + patch are kernels."""
    halo = search + patch

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base = [k * brick - halo for k in key]
        n = brick + 2 * halo
        grey = np.zeros((n, n, n))
        active = np.zeros((n, n, n))
        at = tuple(pdf[c].to_numpy() - b for c, b in zip("xyz", base, strict=True))
        grey[at], active[at] = pdf["grey"].to_numpy(), 1.0
        value = patch_means(grey, active, sigma, strength, search, patch, cut)
        inner = np.ones(len(pdf), dtype=bool)
        for a in at:
            inner &= (a >= halo) & (a < brick + halo)
        out = pdf[inner][["x", "y", "z"]]
        return out.assign(value=value[tuple(a[inner] for a in at)])

    return with_halo(voxels, brick, halo).groupBy("tx", "ty", "tz").applyInPandas(run, "x int, y int, z int, value double")


def project_slice(image: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Parallel-beam ray sums of a square image, bilinear, one row for each angle."""
    n = image.shape[0]
    c = (n - 1) / 2
    s, t = np.meshgrid(np.arange(n) - c, np.arange(n) - c, indexing="ij")
    padded = np.pad(image, 1)
    out = np.zeros((len(angles), n))
    for k, a in enumerate(angles):
        x, y = s * np.cos(a) - t * np.sin(a) + c + 1, s * np.sin(a) + t * np.cos(a) + c + 1
        x, y = np.clip(x, 0, n + 0.999), np.clip(y, 0, n + 0.999)
        i, j = x.astype(int), y.astype(int)
        fx, fy = x - i, y - j
        v = padded[i, j] * (1 - fx) * (1 - fy) + padded[i + 1, j] * fx * (1 - fy) + padded[i, j + 1] * (1 - fx) * fy + padded[i + 1, j + 1] * fx * fy
        out[k] = v.sum(axis=1)
    return out


def back_project(sinogram: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Filtered back projection with the Ram-Lak ramp."""
    n = sinogram.shape[1]
    size = 2 ** int(np.ceil(np.log2(2 * n)))
    kernel = np.zeros(size)
    kernel[0] = 0.25
    odd = np.arange(1, size // 2, 2)
    kernel[odd] = kernel[-odd] = -1 / (np.pi * odd) ** 2
    rows = np.fft.irfft(np.fft.rfft(sinogram, size, axis=1) * np.fft.rfft(kernel), size, axis=1)[:, :n]
    c = (n - 1) / 2
    x, y = np.meshgrid(np.arange(n) - c, np.arange(n) - c, indexing="ij")
    out = np.zeros((n, n))
    for a, row in zip(angles, rows, strict=True):
        out += np.interp(x * np.cos(a) + y * np.sin(a) + c, np.arange(n), row, left=0, right=0)
    return out * np.pi / len(angles)


def reproject(voxels: DataFrame, size: int, order: int = 1) -> DataFrame:
    """(x, y, z, value): slices projected, the ray sums raised to a power, and reconstructed; one kernel for each slice."""
    angles = np.pi * np.arange(int(np.ceil(np.pi / 2 * size))) / int(np.ceil(np.pi / 2 * size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((size, size))
        image[pdf["x"], pdf["y"]] = pdf["grey"]
        back = back_project(project_slice(image, angles) ** order, angles)
        return pdf[["x", "y", "z"]].assign(value=back[pdf["x"], pdf["y"]])

    return voxels.groupBy("z").applyInPandas(run, "x int, y int, z int, value double")


def gaussian_weights(sigma: float, radius: int) -> list[float]:
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def gaussian_smooth(voxels: DataFrame, sigma: float, radius: int) -> DataFrame:
    """Active voxels as means of the active ones around them, separable weights normalised: each voxel sends its value
    along an axis, so sums are made before the shuffle; three times."""
    w = gaussian_weights(sigma, radius)
    now = voxels.select("x", "y", "z", F.col("grey").cast("double").alias("value"), F.lit(1.0).alias("weight"))
    for c in "xyz":
        sent = F.array(*[F.struct(F.lit(k - radius).alias("d"), F.lit(v).alias("w")) for k, v in enumerate(w)])
        each = now.select(*[a for a in "xyz"], "value", "weight", F.explode(sent).alias("o")).withColumn(c, F.col(c) + F.col("o.d"))
        now = each.groupBy("x", "y", "z").agg(F.sum(F.col("value") * F.col("o.w")).alias("value"), F.sum(F.col("weight") * F.col("o.w")).alias("weight"))
    return voxels.select("x", "y", "z").join(now, ["x", "y", "z"]).select("x", "y", "z", (F.col("value") / F.col("weight")).alias("value"))


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of the voxels of a mask to the nearest one outside it, infinite where there is none:
    lower envelopes, one axis at a time."""
    return squared_transform(mask)


def thickness_map(voxels: DataFrame, radius: int, brick: int = 32) -> DataFrame:
    """(x, y, z, thickness): the diameter of the largest ball inside the material that covers the voxel, up to a radius.
    Bricks with a halo of 2 (radius + 1) are kernels: distances, then balls drawn from the largest down."""
    halo = 2 * (radius + 1)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = brick + 2 * halo
        at = tuple(pdf[c].to_numpy() - k * brick + halo for c, k in zip("xyz", key, strict=True))
        mask = np.zeros((n, n, n), dtype=bool)
        mask[at] = True
        d = np.minimum(np.sqrt(distance_transform(mask)), radius)
        out = np.zeros_like(d)
        r = int(np.ceil(radius))
        grid = np.mgrid[-r : r + 1, -r : r + 1, -r : r + 1]
        away = np.sqrt((grid**2).sum(axis=0))
        for value in np.unique(d[d > 0])[::-1]:
            seeds = d == value
            grown = np.zeros_like(seeds)
            for o in np.argwhere(away < value) - r:
                grown |= np.roll(seeds, tuple(o), (0, 1, 2))
            out = np.where((out == 0) & grown & mask, 2 * value - 0.5, out)
        inner = np.ones(len(pdf), dtype=bool)
        for a in at:
            inner &= (a >= halo) & (a < brick + halo)
        return pdf[inner][["x", "y", "z"]].assign(thickness=out[tuple(a[inner] for a in at)])

    return with_halo(voxels.select("x", "y", "z"), brick, halo).groupBy("tx", "ty", "tz").applyInPandas(run, "x int, y int, z int, thickness double")


