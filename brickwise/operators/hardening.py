"""Beam hardening by reprojection: powers of the ray sums are reconstructed and mixed so that material gets one level."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.operators.filters import back_project, project_slice


def power_images(voxels: DataFrame, size: int, order: int, air: float, material: float, neighbours: int = 1) -> DataFrame:
    """(x, y, z, grey, p2 .. p_order): each slice's mean with its neighbours is projected as multiples of the material's
    contrast, and the ray sums' powers are reconstructed; a slice is a kernel that gets its neighbours' voxels."""
    angles = np.pi * np.arange(int(np.ceil(np.pi / 2 * size))) / int(np.ceil(np.pi / 2 * size))
    shift = F.array(*[F.lit(k) for k in range(-neighbours, neighbours + 1)])
    dealt = voxels.select("x", "y", "z", "grey", F.explode(shift).alias("k")).withColumn("slice", F.col("z") + F.col("k"))
    names = [f"p{k}" for k in range(2, order + 1)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["z"] == key[0]]
        total, count = np.zeros((size, size)), np.zeros((size, size))
        np.add.at(total, (pdf["y"], pdf["x"]), pdf["grey"] - air)
        np.add.at(count, (pdf["y"], pdf["x"]), 1)
        image = total / np.maximum(count, 1) / (material - air)
        rays = project_slice(image, angles)
        top = max(float(np.abs(rays).max()), 1e-12)
        out = own[["x", "y", "z", "grey"]].reset_index(drop=True)
        for k, name in enumerate(names, 2):
            out[name] = back_project((rays / top) ** k * top, angles)[own["y"].to_numpy(), own["x"].to_numpy()]
        return out

    schema = "x int, y int, z int, grey int, " + ", ".join(f"{n} double" for n in names)
    return dealt.groupBy("slice").applyInPandas(run, schema)


def fit_powers(images: DataFrame, order: int, air: float, material: float, rounds: int = 4, sigmas: float = 3.0) -> np.ndarray:
    """The factors of the power images that bring voxels to the air or material level that they are nearer to: least
    squares, a few times without what is off by more than so many sigmas. Sums come to the driver."""
    names = [f"p{k}" for k in range(2, order + 1)]
    target = F.when(F.col("grey") > (air + material) / 2, F.lit(material)).otherwise(F.lit(air))
    rows = images.withColumn("r", target - F.col("grey"))
    factors, limit = np.zeros(len(names)), None
    for _ in range(rounds):
        left = F.col("r") - sum((F.col(n) * float(f) for n, f in zip(names, factors, strict=True)), F.lit(0.0))
        some = rows if limit is None else rows.where(F.abs(left) <= limit)
        s = some.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in names for b in names], *[F.sum(F.col(a) * F.col("r")).alias(f"r{a}") for a in names]).first()
        m = np.array([[s[f"{a}{b}"] for b in names] for a in names], dtype=float)
        factors = np.linalg.lstsq(m + 1e-9 * np.trace(m) * np.eye(len(names)), np.array([s[f"r{a}"] for a in names], dtype=float), rcond=None)[0]
        left = F.col("r") - sum((F.col(n) * float(f) for n, f in zip(names, factors, strict=True)), F.lit(0.0))
        limit = sigmas * float(rows.agg(F.sqrt(F.avg(left * left)).alias("s")).first()["s"])
    return factors


def correct(voxels: DataFrame, size: int, order: int = 3, air: float = 0.0, material: float = 1.0, level: int = 0) -> DataFrame:
    """(x, y, z, grey, value) of the corrected volume. The factors are estimated on a coarser level of the pyramid if one
    is given, its corrections interpolated to the voxels: each takes that of the coarse voxel around it and of those next
    to it, weighted by how near they are along each axis."""
    from brickwise.operators.blocks import pyramid_level

    coarse = voxels
    for _ in range(level):
        coarse = pyramid_level(coarse)
    small = -(-size // 2**level)
    images = power_images(coarse, small, order, air, material)
    factors = fit_powers(images, order, air, material)
    names = [f"p{k}" for k in range(2, order + 1)]
    shift = sum((F.col(n) * float(f) for n, f in zip(names, factors, strict=True)), F.lit(0.0))
    moved = images.select("x", "y", "z", "grey", shift.alias("shift"))
    if not level:
        return moved.withColumn("value", F.col("grey") + F.col("shift")).drop("shift")
    step = 2**level
    at = [(F.col(c) + 0.5) / step - 0.5 for c in "xyz"]
    corner = voxels.select("x", "y", "z", "grey", *[F.floor(a).cast("int").alias(f"l{c}") for c, a in zip("xyz", at, strict=True)], *[(a - F.floor(a)).alias(f"t{c}") for c, a in zip("xyz", at, strict=True)])
    picks = F.array(*[F.struct(*[F.lit(k >> n & 1).alias(c) for n, c in enumerate("xyz")]) for k in range(8)])
    each = corner.select("*", F.explode(picks).alias("o"))
    weight = F.lit(1.0)
    for c in "xyz":
        weight = weight * F.when(F.col(f"o.{c}") == 1, F.col(f"t{c}")).otherwise(1 - F.col(f"t{c}"))
    each = each.select("x", "y", "z", "grey", weight.alias("w"), *[(F.col(f"l{c}") + F.col(f"o.{c}")).alias(f"q{c}") for c in "xyz"])
    table = moved.select(*[F.col(c).alias(f"q{c}") for c in "xyz"], "shift")
    both = each.join(table, ["qx", "qy", "qz"], "left")
    near = both.groupBy("x", "y", "z", "grey").agg((F.sum(F.col("w") * F.col("shift")) / F.sum(F.when(F.col("shift").isNotNull(), F.col("w")))).alias("shift"))
    return near.select("x", "y", "z", "grey", (F.col("grey") + F.coalesce("shift", F.lit(0.0))).alias("value"))
