"""Exact Euclidean distances inside a volume of any size: one pass over lines for each axis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.operators.graph import stage


def lower_envelope(f: np.ndarray, pitch: float = 1.0) -> np.ndarray:
    """Of every line (a row of f) and place p the least of f[q] + (pitch (p - q))^2 over all places q. All lines grow their
    envelopes of parabolas side by side; each place is put on its line's stack once and taken off once at most. Infinite values are no parabolas; a
    line of them stays infinite."""
    lines, n = f.shape
    place = np.zeros((lines, n), dtype=np.int64)
    start = np.full((lines, n + 1), np.inf)
    top = np.full(lines, -1)
    row = np.arange(lines)
    square = pitch * pitch
    for q in range(n):
        todo = row[np.isfinite(f[:, q])]
        begins = np.full(lines, -np.inf)
        while len(todo):
            has = todo[top[todo] >= 0]
            begins[todo[top[todo] < 0]] = -np.inf
            if not len(has):
                break
            r = place[has, top[has]]
            begins[has] = (f[has, q] - f[has, r]) / (2 * square * (q - r)) + (q + r) / 2
            todo = has[begins[has] <= start[has, top[has]]]
            top[todo] -= 1
        put = np.isfinite(f[:, q])
        top[put] += 1
        place[put, top[put]] = q
        start[put, top[put]] = begins[put]
        start[put, top[put] + 1] = np.inf
    out = np.full_like(f, np.inf)
    at = np.zeros(lines, dtype=np.int64)
    some = row[top >= 0]
    for p in range(n):
        late = some[start[some, at[some] + 1] < p]
        while len(late):
            at[late] += 1
            late = late[start[late, at[late] + 1] < p]
        r = place[some, at[some]]
        out[some, p] = f[some, r] + square * (p - r) ** 2
    return out


def squared_transform(mask: np.ndarray, pitch: tuple[float, ...] | None = None) -> np.ndarray:
    """Squared distances of the voxels of a mask to the nearest one outside it; infinite where there is none."""
    d = np.where(mask, np.inf, 0.0)
    for axis in range(mask.ndim):
        line = np.moveaxis(d, axis, -1)
        d = np.moveaxis(lower_envelope(line.reshape(-1, line.shape[-1]), 1.0 if pitch is None else pitch[axis]).reshape(line.shape), -1, axis)
    return d


def distance_map(voxels: DataFrame, pitch: tuple[float, float, float] = (1.0, 1.0, 1.0), strip: int = 32) -> DataFrame:
    """(x, y, z, distance) of every voxel given (x, y, z) to the nearest place that isn't given, wherever that is: there is
    no radius. Places beyond the volume count as not given.

    Each axis is one shuffle of the voxels into strips of strip^2 parallel lines, on which a kernel takes lower envelopes; a
    line's stretch between the outermost voxels of its strip, one place more at both ends, is all that it holds. A task's memory grows with the
    length of the volume's longest side times strip^2, never with the volume."""

    def along(axis: str, other: str, size: float):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            low = pdf[axis].min() - 1
            line = (pdf[other[0]].to_numpy() % strip) * strip + pdf[other[1]].to_numpy() % strip
            at = pdf[axis].to_numpy() - low
            used, own = np.unique(line, return_inverse=True)
            f = np.zeros((len(used), at.max() + 2))
            f[own, at] = pdf["d"]
            return pdf.assign(d=lower_envelope(f, size)[own, at])

        return run

    now = voxels.select("x", "y", "z", F.lit(float("inf")).alias("d"))
    for (axis, other), size in zip((("x", "yz"), ("y", "xz"), ("z", "xy")), pitch, strict=True):
        keys = [F.floor(F.col(c) / strip).cast("int").alias(f"t{c}") for c in other]
        now = now.groupBy(*keys).applyInPandas(along(axis, other, size), "x int, y int, z int, d double")
    return stage(now.select("x", "y", "z", F.sqrt("d").alias("distance")), "distances")


def ridge(distances: DataFrame) -> DataFrame:
    """The voxels (x, y, z, distance) whose ball no neighbour's ball holds: none of the 26 around is farther from the outside
    by as much as it is away. Their balls cover what all balls cover."""
    from brickwise.functions.keys import offsets

    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)], F.lit(float(np.sqrt(sum(d * d for d in o)))).alias("w")) for o in offsets(26)])
    # What each voxel's ball still reaches around its neighbours.
    held = distances.select("x", "y", "z", "distance", F.explode(shifts).alias("o")).select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"], (F.col("distance") - F.col("o.w")).alias("left"))
    most = held.where("left > 0").groupBy("x", "y", "z").agg(F.max("left").alias("left"))
    return distances.join(most, ["x", "y", "z"], "left").where("left is null or left < distance - 1e-9").select("x", "y", "z", "distance")
