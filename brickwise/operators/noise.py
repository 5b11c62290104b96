"""The noise of a scan: its deviation, and how values of near voxels differ by offset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.functions.keys import offsets
from brickwise.operators.blocks import BLOCK, BX, block_columns, block_statistics
from brickwise.operators.graph import stage

#: Blocks clear of any surface that are enough to leave the others out.
INNER = 32
#: Blocks a side of what one kernel call gets.
TILE = 4


def material_blocks(voxels: DataFrame, threshold: float, least: int = INNER) -> DataFrame:
    """(bx, by, bz, mean, variance) of the blocks that tell the noise: full ones with a mean of the threshold or more whose six
    neighbours are such too, so that no surface crosses them; if these are fewer than `least`, all full ones with that mean."""
    full = stage(block_statistics(voxels, threshold).where((F.col("n") == BLOCK**3) & (F.col("mean") >= threshold)).select(*BX, "mean", "variance"), "noise-blocks")
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, BX, strict=True)]) for o in offsets(6)])
    around = full.select(F.explode(shifts).alias("o"), *BX).select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in BX]).groupBy(*BX).agg(F.count("*").alias("k")).where("k = 6")
    inner = full.join(around.select(*BX), BX, "left_semi")
    return inner if inner.limit(least).count() == least else full


def noise_model(voxels: DataFrame, threshold: float, radius: int = 3, least: int = INNER) -> DataFrame:
    """(dx, dy, dz, n, variance, sigma, correlation) for every offset up to a radius along each axis, one of each opposite pair: the mean
    squared difference of the n pairs of voxels that lie so in one block; sigma, the same in all rows, is the noise's deviation, and
    correlation is 1 - variance / 2 sigma^2.

    All blocks of material_blocks count. One kernel takes whole blocks and makes all offsets' sums, which are added before their
    shuffle. sigma is the root of half the mean variance of the offsets as long as the radius, where noise of a shorter reach has no
    correlation left: within a block the mean follows correlated noise, so the blocks' own variances would be too small. A volume without such a block gives no rows."""
    if not 1 <= radius < BLOCK:
        raise ValueError(f"the noise model reaches 1 to {BLOCK - 1} voxels")
    reach = range(-radius, radius + 1)
    half = [(x, y, z) for z in reach for y in reach for x in reach if (z, y, x) > (0, 0, 0)]
    chosen = material_blocks(voxels, threshold, least).select(*BX)
    tile = [F.floor(F.col(b) / TILE).cast("int").alias(f"t{b[1]}") for b in BX]
    dealt = voxels.select("x", "y", "z", "grey", *block_columns()).join(chosen, BX).select("*", *tile)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, own = np.unique(pdf[BX].to_numpy(), axis=0, return_inverse=True)
        cubes = np.zeros((len(names), BLOCK, BLOCK, BLOCK))
        cubes[(own.ravel(), *(pdf[c].to_numpy() % BLOCK for c in "xyz"))] = pdf["grey"]
        rows = []
        for o in half:
            here = tuple(slice(max(0, -d), BLOCK - max(0, d)) for d in o)
            there = tuple(slice(max(0, d), BLOCK - max(0, -d)) for d in o)
            d = cubes[(slice(None), *here)] - cubes[(slice(None), *there)]
            rows.append((*o, d.size, float((d * d).sum())))
        return pd.DataFrame(rows, columns=["dx", "dy", "dz", "n", "s"])

    sums = dealt.groupBy("tx", "ty", "tz").applyInPandas(run, "dx int, dy int, dz int, n long, s double")
    found = stage(sums.groupBy("dx", "dy", "dz").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("variance")), "noise-pairs")
    far = found.where(F.greatest(*[F.abs(c) for c in ("dx", "dy", "dz")]) == radius).agg(F.sqrt(F.sum(F.col("variance") * F.col("n")) / F.sum("n") / 2).alias("sigma"))
    # One row for each offset, (2 radius + 1)^3 / 2 at most, and one with sigma.
    return found.join(F.broadcast(far)).withColumn("correlation", F.when(F.col("sigma") > 0, 1 - F.col("variance") / (2 * F.col("sigma") * F.col("sigma"))).otherwise(0.0))
