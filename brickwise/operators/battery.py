"""Battery cells: profiles and their peaks, splits, circles, gaps, overhangs, particles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from brickwise.functions.keys import offsets
from brickwise.operators.components import components
from brickwise.operators.ranking import running


def radial_profiles(voxels: DataFrame, centre: tuple[float, float], angles: int, radii: int) -> DataFrame:
    """(z, angle, r, grey): values of the nearest voxels along rays from the centre; only the lattice of samples is
    generated, and joined by its voxel."""
    spark = voxels.sparkSession
    rays = spark.range(angles * radii).select((F.col("id") % angles).cast("int").alias("angle"), F.floor(F.col("id") / angles).cast("int").alias("r"))
    a = F.col("angle") * (2 * math.pi / angles)
    at = rays.select("angle", "r", F.floor(centre[0] + F.col("r") * F.cos(a) + 0.5).cast("int").alias("x"), F.floor(centre[1] + F.col("r") * F.sin(a) + 0.5).cast("int").alias("y"))
    return voxels.join(at, ["x", "y"]).select("z", "angle", "r", "grey")


def smooth(rows: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """rows with smooth: (before + 2 v + after) / 4, the ends unchanged."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    b, a = F.lag(value).over(w), F.lead(value).over(w)
    return rows.withColumn("smooth", F.when(b.isNull() | a.isNull(), F.col(value)).otherwise((b + 2 * F.col(value) + a) / 4))


def peaks(rows: DataFrame, by: list[str], order: str, value: str, least: float) -> DataFrame:
    """Local maxima (of a plateau the last) with their prominence over the higher of the two valleys towards the next
    higher value or the end; a profile, one group, at a time in numpy."""
    schema = rows.select(*by, order, value).schema.add("prominence", "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        v = pdf[value].to_numpy(float)
        n = len(v)
        keep, out = [], []
        for i in range(n):
            if (i == 0 or v[i] > v[i - 1]) and (i == n - 1 or v[i] >= v[i + 1]):
                left = np.flatnonzero(v[:i] > v[i])
                right = np.flatnonzero(v[i + 1 :] > v[i])
                lo = v[(left[-1] + 1 if len(left) else 0) : i]
                hi = v[i + 1 : (i + 1 + right[0] if len(right) else n)]
                p = v[i] - max(lo.min() if len(lo) else v[i], hi.min() if len(hi) else v[i])
                if p >= least:
                    keep.append(i)
                    out.append(p)
        return pdf.iloc[keep][[*by, order, value]].assign(prominence=out)

    return rows.select(*by, order, value).groupBy(*by).applyInPandas(run, schema)


def two_classes(rows: DataFrame, value: str) -> DataFrame:
    """One row (low_count, low_mean, high_mean, distinct): the split of the sorted values with the least sum of squares
    within; distinct if the smaller share, the gap and the gap by the high mean are large enough."""
    v = F.col(value)
    every = rows.agg(F.count("*").alias("n"), F.sum(v).alias("sa"), F.sum(v * v).alias("qa"))
    c = running(rows.select(v.alias("v")), [F.col("v")], {"k": F.lit(1), "s": F.col("v"), "q": F.col("v") * F.col("v")}).join(F.broadcast(every)).where("k < n")
    rest = F.col("n") - F.col("k")
    ss = F.round(F.col("q") - F.col("s") ** 2 / F.col("k") + F.col("qa") - F.col("q") - (F.col("sa") - F.col("s")) ** 2 / rest, 3)
    best = c.withColumn("ss", ss).agg(F.min_by(F.struct("k", "n", "s", "sa", "ss"), F.struct("ss", "k")).alias("m"))
    low, high = F.col("m.s") / F.col("m.k"), (F.col("m.sa") - F.col("m.s")) / (F.col("m.n") - F.col("m.k"))
    share = F.least(F.col("m.k"), F.col("m.n") - F.col("m.k")) / F.col("m.n")
    sd = F.sqrt(F.greatest(F.col("m.ss"), F.lit(0.0)) / F.col("m.n"))
    return best.select(F.col("m.k").alias("low_count"), low.alias("low_mean"), high.alias("high_mean"), ((share >= 0.15) & (high - low >= 3 * sd) & (high - low >= 0.1 * high)).alias("distinct"))


def circle_sums(points: DataFrame, by: list[str]) -> DataFrame:
    """The sums of an algebraic circle fit for each section."""
    x, y = F.col("x"), F.col("y")
    r = x * x + y * y
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(e).alias(n) for n, e in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y), ("sxr", x * r), ("syr", y * r), ("sr", r))])


def fit_circles(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, cx, cy, radius) from the sums, by Cramer's rule on the 3x3 normal equations."""
    n, sx, sy, sxx, syy, sxy, sxr, syr, sr = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "sxr", "syr", "sr"))

    def det(m):
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    a = [[sxx, sxy, sx], [sxy, syy, sy], [sx, sy, n]]
    b = [sxr, syr, sr]
    base = det(a)
    d, e, f = (det([[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]) / base for k in range(3))
    return sums.select(*by, (d / 2).alias("cx"), (e / 2).alias("cy"), F.sqrt(f + d * d / 4 + e * e / 4).alias("radius"))


def gaps(rows: DataFrame, by: list[str], at: str, tie: str, factor: float) -> DataFrame:
    """Rows whose distance to the one before is over a factor times the usual (upper median) distance of the group."""
    w = Window.partitionBy(*by).orderBy(at, tie)
    d = rows.withColumn("gap", F.col(at) - F.lag(at).over(w)).where("gap is not null")
    from brickwise.operators.histogram import upper_median

    usual = upper_median(d, "gap", by).withColumnRenamed("median", "usual")
    return d.join(usual, by).where(F.col("gap") > factor * F.col("usual"))


def edge_summary(samples: DataFrame, edge: str, value: str, name: str) -> DataFrame:
    v = F.col(value)
    return samples.groupBy(edge).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.min_by(name, F.struct(value, name)).alias("worst"))


def particles(mask: DataFrame, least: int, pitch: float = 1.0) -> DataFrame:
    """(component, n, equivalent_diameter) of 6-connected pieces of so many voxels at least."""
    n = components(mask, 6).groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("equivalent_diameter", F.pow(6 * F.col("n") * pitch**3 / math.pi, F.lit(1 / 3)))


def inside_structures(small: DataFrame, large: DataFrame, largest: float) -> DataFrame:
    """Small pieces (id, x, y, z, size) nearer to the centre of a large one than half its size. Both sides meet by grid
    cells as wide as half the largest size, the small side in the 27 cells around."""
    cell = largest / 2
    g = lambda c: F.floor(F.col(c) / cell).cast("int")
    big = large.select(F.col("size").alias("reach"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[g(c).alias(f"g{c}") for c in "xyz"])
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in [(0, 0, 0), *offsets(26)]])
    dealt = small.select("*", F.explode(shifts).alias("o")).select("id", "x", "y", "z", *[(g(c) + F.col(f"o.{c}")).alias(f"g{c}") for c in "xyz"])
    d = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 + (F.col("z") - F.col("oz")) ** 2)
    return dealt.join(big, ["gx", "gy", "gz"]).where(d < 0.5 * F.col("reach")).select("id").distinct()
