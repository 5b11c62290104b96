"""Connected components of voxel masks: labelled inside bricks, joined over their faces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from brickwise.functions.keys import offsets, voxel_key
from brickwise.operators.graph import connected_components, stage

BRICK = 64


def label_brick(x: np.ndarray, y: np.ndarray, z: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
    """Labels of the voxels of one brick: the least index of each component of equal values."""
    lo = [int(a.min()) for a in (x, y, z)]
    shape = tuple(int(a.max()) - b + 3 for a, b in zip((x, y, z), lo, strict=True))
    at = tuple(a - b + 1 for a, b in zip((x, y, z), lo, strict=True))
    index = np.full(shape, -1, dtype=np.int64)
    index[at] = np.arange(len(x))
    pairs = []
    for o in offsets(count):
        if o > (0, 0, 0):
            other = index[tuple(a + d for a, d in zip(at, o, strict=True))]
            ok = other >= 0
            ok[ok] &= value[other[ok]] == value[ok]
            pairs.append(np.c_[np.flatnonzero(ok), other[ok]])
    up = np.arange(len(x))
    links = np.concatenate(pairs) if pairs else np.zeros((0, 2), dtype=np.int64)
    while len(links):
        a, b = up[links[:, 0]], up[links[:, 1]]
        apart = a != b
        if not apart.any():
            break
        links = links[apart]
        np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up[up] != up).any():
            up = up[up]
    return up


def components(mask: DataFrame, count: int = 6, value: str | None = None, brick: int = BRICK) -> DataFrame:
    """mask's (x, y, z), its value column if given, and component: the least voxel key of each connected set of
    equal values. Bricks are labelled in numpy, a brick's voxels at a time; only pairs of labels that
    touch over a brick's faces, edges and corners reach the distributed union of components."""
    col = F.lit(0) if value is None else F.col(value)
    keyed = mask.select("x", "y", "z", col.cast("long").alias("v"), voxel_key().alias("key"), *[F.floor(F.col(c) / brick).cast("int").alias(f"b{c}") for c in "xyz"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        up = label_brick(*(pdf[c].to_numpy() for c in "xyz"), pdf["v"].to_numpy(), count)
        return pdf[["x", "y", "z", "v", "key"]].assign(local=pdf["key"].to_numpy()[up])

    local = stage(keyed.groupBy("bx", "by", "bz").applyInPandas(run, "x int, y int, z int, v long, key long, local long"), "labels")
    border = F.lit(False)
    for c in "xyz":
        border = border | (F.col(c) % brick == 0) | (F.col(c) % brick == brick - 1)
    rim = local.where(border)
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in offsets(count) if o > (0, 0, 0)])
    moved = rim.select(F.col("local").alias("a"), "v", "x", "y", "z", F.explode(shifts).alias("o")).select("a", "v", *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"])
    edges = moved.join(rim.select("x", "y", "z", "v", F.col("local").alias("b")), ["x", "y", "z", "v"]).select("a", "b").distinct()
    roots = connected_components(edges).select(F.col("node").alias("local"), "root")
    out = local.join(roots, "local", "left").select("x", "y", "z", "v", F.coalesce("root", "local").alias("component"))
    return out.drop("v") if value is None else out.withColumnRenamed("v", value)


def component_statistics(labelled: DataFrame, value: Column | None = None, box=None) -> DataFrame:
    """Count, bounding box, coordinate sums and products, value sum and border flag of each component."""
    v = F.lit(0) if value is None else value
    x, y, z = (F.col(c).cast("long") for c in "xyz")
    aggs = [F.count("*").alias("n")]
    for name, c in zip("xyz", (x, y, z), strict=True):
        aggs += [F.min(c).cast("int").alias(f"min_{name}"), F.max(c).cast("int").alias(f"max_{name}"), F.sum(c).alias(f"sum_{name}")]
    for a, b, name in ((x, x, "xx"), (y, y, "yy"), (z, z, "zz"), (x, y, "xy"), (x, z, "xz"), (y, z, "yz")):
        aggs.append(F.sum(a * b).alias(f"sum_{name}"))
    aggs.append(F.sum(v.cast("long")).alias("sum_value"))
    if box is not None:
        face = F.lit(False)
        for c, lo, hi in zip("xyz", *box, strict=True):
            face = face | (F.col(c) == lo) | (F.col(c) == hi - 1)
        aggs.append(F.bool_or(face).alias("touches_border"))
    return labelled.groupBy("component").agg(*aggs)


def keep_largest(labelled: DataFrame, k: int) -> DataFrame:
    """The voxels of the k components with the most voxels, the smaller name first among equals."""
    top = labelled.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(k)
    return labelled.join(top.select("component"), "component", "left_semi")


def faces(labelled: DataFrame, label: str = "component") -> DataFrame:
    """(label, axis, faces): a component's open faces along each axis, twice its voxels less the neighbours of its
    own, by a window along the axis instead of a join."""
    out = None
    for axis in "xyz":
        rest = [c for c in "xyz" if c != axis]
        w = Window.partitionBy(label, *rest).orderBy(axis)
        inner = (F.lag(axis).over(w) == F.col(axis) - 1).cast("int")
        part = labelled.select(label, F.coalesce(inner, F.lit(0)).alias("inner")).groupBy(label).agg((2 * F.count("*") - 2 * F.sum("inner")).alias("faces")).select(label, F.lit(axis).alias("axis"), "faces")
        out = part if out is None else out.union(part)
    return out
