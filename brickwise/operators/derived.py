"""Derived volumes: a user's function over bricks with a halo, and quick previews."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.operators.filters import with_halo

BrickFunction = Callable[[np.ndarray, tuple[int, int, int]], np.ndarray]


def derive(voxels: DataFrame, function: BrickFunction, brick: int = 64, halo: int = 0, integer: bool = True) -> DataFrame:
    """The same active voxels with new values: function(values, corner) gets a brick with its halo as an array indexed
    [x, y, z], inactive voxels NaN, and the voxel at its corner, and returns an array of the same shape. NaN removes a
    voxel; integers are rounded half up and clamped to 16 bits."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = brick + 2 * halo
        base = tuple(int(k) * brick - halo for k in key)
        values = np.full((n, n, n), np.nan)
        at = tuple(pdf[c].to_numpy() - b for c, b in zip("xyz", base, strict=True))
        values[at] = pdf["grey"]
        out = np.asarray(function(values, base), dtype=float)
        if out.shape != values.shape:
            raise ValueError(f"the function returned shape {out.shape}, not {values.shape}")
        inner = np.ones(len(pdf), dtype=bool)
        for a in at:
            inner &= (a >= halo) & (a < brick + halo)
        new = out[at]
        keep = inner & ~np.isnan(new)
        new = np.clip(np.floor(new[keep] + 0.5), 0, 65535) if integer else new[keep]
        return pdf[keep][["x", "y", "z"]].assign(grey=new.astype(np.int32) if integer else new)

    kind = "int" if integer else "double"
    return with_halo(voxels.select("x", "y", "z", "grey"), brick, halo).groupBy("tx", "ty", "tz").applyInPandas(run, f"x int, y int, z int, grey {kind}")


def preview(voxels: DataFrame, nz: int, slices: int = 64, stride: int = 4) -> DataFrame:
    """(x, y, z, mean) of slices spread evenly over the depth, in cells of a stride; the slice list is a predicate that
    reaches the scan."""
    chosen = sorted({int((k + 0.5) * nz / slices) for k in range(min(slices, nz))} if nz > slices else set(range(nz)))
    part = voxels.where(F.col("z").isin(chosen))
    return part.groupBy(F.floor(F.col("x") / stride).cast("int").alias("x"), F.floor(F.col("y") / stride).cast("int").alias("y"), "z").agg((F.sum("grey") / F.count("*")).alias("mean"))


def pyramid(voxels: DataFrame, levels: int) -> list[DataFrame]:
    """The volume and its coarser levels."""
    from brickwise.operators.blocks import pyramid_level

    out = [voxels]
    for _ in range(levels):
        out.append(pyramid_level(out[-1]))
    return out


def level_for_pixel(voxel_mm: float, pixel_mm: float, levels: int) -> int:
    """The coarsest level whose voxels aren't larger than a pixel."""
    level = 0
    while level < levels and voxel_mm * 2 ** (level + 1) <= pixel_mm:
        level += 1
    return level


def write_dataset(voxels: DataFrame, folder: str, levels: int = 2, brick: int = 64) -> None:
    """A bricked dataset: Parquet by level, rows in the order of the bricks' Morton keys, so that files cover compact
    regions and box predicates skip most of them."""
    from brickwise.functions.keys import morton

    for level, df in enumerate(pyramid(voxels, levels)):
        keyed = df.select("x", "y", "z", "grey", *[F.floor(F.col(c) / brick).cast("int").alias(f"b{c}") for c in "xyz"]).withColumn("brick", morton("bx", "by", "bz"))
        keyed.repartitionByRange("brick").sortWithinPartitions("brick", "z", "y", "x").write.mode("overwrite").parquet(f"{folder}/level={level}")


def read_box(spark, folder: str, level: int, box, brick: int = 64) -> DataFrame:
    """The voxels of a half-open box of a level; predicates on brick and voxel columns both reach the scan."""
    df = spark.read.parquet(f"{folder}/level={level}")
    for c, a, b in zip("xyz", *box, strict=True):
        df = df.where((F.col(f"b{c}") >= a // brick) & (F.col(f"b{c}") <= (b - 1) // brick) & (F.col(c) >= a) & (F.col(c) < b))
    return df.select("x", "y", "z", "grey")
