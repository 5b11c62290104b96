"""Materials: segmentation, growth, counts, comparison of labels and measured objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from brickwise.functions.keys import offsets
from brickwise.operators.components import component_statistics


def segment(voxels: DataFrame, threshold: float, cuts: list[float], least: int = 6) -> DataFrame:
    """(x, y, z, material): voxels above the threshold of whose 27 neighbours (themselves included) so many are above
    too; the class is that of the neighbours' mean. Each voxel above sends its value to its neighbours, so the
    sums are made before the one shuffle."""
    above = voxels.where(F.col("grey") > threshold)
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in [(0, 0, 0), *offsets(26)]])
    sent = above.select("grey", F.explode(shifts).alias("o"), "x", "y", "z").select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"], "grey", ((F.col("o.x") == 0) & (F.col("o.y") == 0) & (F.col("o.z") == 0)).alias("own"))
    sums = sent.groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.sum("grey").alias("s"), F.bool_or("own").alias("own")).where(F.col("own") & (F.col("n") >= least))
    mean = F.col("s") / F.col("n")
    material = F.lit(1)
    for k, cut in enumerate(cuts):
        material = F.when(mean > cut, F.lit(k + 2)).otherwise(material)
    return sums.select("x", "y", "z", material.cast("int").alias("material"))


def grow(start: DataFrame, into: DataFrame, steps: int) -> DataFrame:
    """The start voxels and those of `into` within so many face steps over voxels of `into`."""
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in offsets(6)])
    now, allowed = start.select("x", "y", "z"), into.select("x", "y", "z")
    for _ in range(steps):
        moved = now.select("x", "y", "z", F.explode(shifts).alias("o")).select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"])
        now = now.union(moved.join(allowed, ["x", "y", "z"], "left_semi")).distinct()
    return now


def counts(labels: DataFrame, voxel_mm3: float) -> DataFrame:
    return labels.groupBy("material").agg(F.count("*").alias("voxels")).withColumn("volume_mm3", F.col("voxels") * voxel_mm3)


def component_truth(rows: DataFrame, lowers: list[float], width: int = 16) -> DataFrame:
    """(label, n, truth) of the true components of rows (label, grey), label 0 left out: the class of a component is that of its
    median grey value, to the middle of bins of a width; class k begins at the k-th of the ascending lower values, 0 is what lies below them all.

    Counts by label and bin are made before the shuffle and add up whatever way a component is dealt; a label has a row for each
    of 65536 / width bins at most."""
    grey = F.least(F.greatest(F.col("grey").cast("double"), F.lit(0.0)), F.lit(65535.0))
    counts = rows.where("label > 0").groupBy("label", F.floor(grey / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    by_label = Window.partitionBy("label")
    seen = F.sum("n").over(by_label.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    half = counts.select("label", "bin", "n", seen.alias("seen"), F.sum("n").over(by_label).alias("total")).where(2 * F.col("seen") >= F.col("total"))
    middle = half.groupBy("label", F.col("total").alias("n")).agg(((F.min("bin") + 0.5) * width).alias("median"))
    truth = sum((F.when(F.col("median") >= low, 1).otherwise(0) for low in lowers), F.lit(0))
    return middle.select("label", "n", truth.alias("truth"))


def scored(rows: DataFrame, lowers: list[float]) -> DataFrame:
    """rows (label, grey, found, ...) with truth, the class of their component; label 0 is class 0."""
    truth = component_truth(rows, lowers).select("label", "truth")
    return rows.join(truth, "label", "left").withColumn("truth", F.coalesce("truth", F.lit(0)))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "found").agg(F.count("*").alias("n"))


def dice(matrix: DataFrame, classes: int) -> DataFrame:
    """(class, dice) of a confusion matrix: 2 overlap / (row + column), 1 where both are empty."""
    each = matrix.select("*", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("class"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    t, f = F.col("truth") == F.col("class"), F.col("found") == F.col("class")
    got = each.groupBy("class").agg(n(t & f).alias("both"), n(t).alias("row"), n(f).alias("column"))
    total = F.col("row") + F.col("column")
    return got.select("class", F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.col("both") / total).alias("dice"))


def measure(labelled: DataFrame, pitch: float, least: int = 1) -> DataFrame:
    """Volume, centroid, bounds, second moments and principal lengths of each component."""
    s = component_statistics(labelled).where(F.col("n") >= least)
    n = F.col("n")
    mean = {c: F.col(f"sum_{c}") / n for c in "xyz"}
    cov = lambda a, b: (F.col(f"sum_{a}{b}") / n - mean[a] * mean[b]) * pitch * pitch

    @pandas_udf("array<double>")
    def spread(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.Series:
        m = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
        return pd.Series(list(np.sqrt(np.maximum(np.linalg.eigvalsh(m)[:, ::-1], 0) * 12)))

    ends = [f for c in "xyz" for f in (((F.col(f"min_{c}") - 0.5) * pitch).alias(f"min_{c}_mm"), ((F.col(f"max_{c}") + 0.5) * pitch).alias(f"max_{c}_mm"))]
    return s.select("component", n.alias("voxels"), (n * pitch**3).alias("volume_mm3"), *[(mean[c] * pitch).alias(f"c{c}") for c in "xyz"], *ends, spread(*[cov(a, b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]).alias("principal_lengths_mm"))
