"""Battery cells as a whole: their type and axis, stacked cells, and cells from section images alone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overview(voxels: DataFrame, threshold: float, round_share: float = 0.9) -> DataFrame:
    """One row (type, axis, cx .. cz, extents): the cell's axis is the one across which the section is roundest, as the
    area over that of its circumscribed box, pi / 4 for a circle; a cell whose best section is no circle is stacked, and
    its axis the shortest. Sums over sections, coarse rows, are all that is gathered."""
    cell = voxels.where(F.col("grey") > threshold)
    ends = cell.agg(*[F.min(c).alias(f"lo{c}") for c in "xyz"], *[(F.max(c) - F.min(c) + 1).alias(f"n{c}") for c in "xyz"], *[F.avg(c).alias(f"c{c}") for c in "xyz"])
    shadows = None
    for axis in "xyz":
        a, b = (c for c in "xyz" if c != axis)
        rows = cell.groupBy(b).agg(F.min(a).alias("lo"), F.max(a).alias("hi"))
        # The outline's area: from the first to the last voxel of each line, so that the inside needn't be dense.
        part = rows.agg(F.lit(axis).alias("axis"), F.sum(F.col("hi") - F.col("lo") + 1).alias("area"), (F.max("hi") - F.min("lo") + 1).alias("w"), F.count("*").alias("h"))
        shadows = part if shadows is None else shadows.union(part)
    share = F.col("area") / (F.col("w") * F.col("h"))
    square = F.least(F.col("w") / F.col("h"), F.col("h") / F.col("w"))
    rated = shadows.withColumn("round", F.when((square > round_share) & (F.abs(share - math.pi / 4) < 0.06), 1 - F.abs(share - math.pi / 4)).otherwise(0.0))
    best = rated.agg(F.max(F.struct("round", "axis")).alias("m"))
    shortest = F.array_min(F.array(*[F.struct(F.col(f"n{c}").alias("n"), F.lit(c).alias("axis")) for c in "xyz"]))["axis"]
    round_ = F.col("m.round") > 0
    return ends.join(F.broadcast(best)).select(F.when(round_, "cylindrical").otherwise("stacked").alias("type"), F.when(round_, F.col("m.axis")).otherwise(shortest).alias("axis"), *[f"{k}{c}" for k in ("c", "lo", "n") for c in "xyz"])


def stacked_layers(voxels: DataFrame, anode: float, cathode: float, tolerance: float, along: str = "x") -> DataFrame:
    """(section, z, kind, lo, hi) of the layers of a stacked cell: in each section across `along`, the runs of voxels at the
    anode's or the cathode's level in each layer, from their first to their last voxel."""
    across = next(c for c in "xy" if c != along)
    kind = F.when(F.abs(F.col("grey") - anode) <= tolerance, "anode").when(F.abs(F.col("grey") - cathode) <= tolerance, "cathode")
    rows = voxels.select(F.col(along).alias("section"), "z", F.col(across).alias("at"), kind.alias("kind")).where("kind is not null")
    return rows.groupBy("section", "z", "kind").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))


def stacked_overhang(layers: DataFrame, reach: int, pitch: float = 1.0) -> DataFrame:
    """(section, layer, edge, overhang) for each cathode of each section: how far the nearer of the anodes above and below
    it, within a reach, stands out at either edge; negative where the cathode does. Neighbouring slices of a sheet are
    one layer."""
    w = Window.partitionBy("section", "kind").orderBy("z")
    new = F.coalesce((F.col("z") - F.lag("z").over(w) > 1).cast("int"), F.lit(1))
    marked = layers.withColumn("layer", F.sum(new).over(w))
    sheets = marked.groupBy("section", "kind", "layer").agg(F.avg("z").alias("z"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    c = sheets.where("kind = 'cathode'").select("section", "layer", "z", "lo", "hi")
    a = sheets.where("kind = 'anode'").select("section", F.col("z").alias("az"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    both = c.join(a, "section").where(F.abs(F.col("az") - F.col("z")) <= reach)
    ends = F.array(F.struct(F.lit("low").alias("edge"), (F.col("lo") - F.col("alo")).alias("d")), F.struct(F.lit("high").alias("edge"), (F.col("ahi") - F.col("hi")).alias("d")))
    each = both.select("section", "layer", F.explode(ends).alias("e"))
    return each.groupBy("section", "layer", F.col("e.edge").alias("edge")).agg((F.min("e.d") * pitch).alias("overhang"))


def image_cells(images: DataFrame, threshold: float, anode: float, cathode: float, tolerance: float) -> DataFrame:
    """(cell, section, type, width, height, layers, cathodes, least_overhang) of cells of which there are only section
    images (cell, section, x, y, value): a section's outline tells the type, its middle column the layers. An image is a
    kernel."""
    schema = "cell string, section int, type string, width int, height int, layers int, cathodes int, least_overhang double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = (pdf[c].to_numpy() for c in ("x", "y", "value"))
        image = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
        image[y, x] = v
        there = image > threshold
        if not there.any():
            return pd.DataFrame([(key[0], key[1], "empty", 0, 0, 0, 0, None)], columns=[c.split()[0] for c in schema.split(", ")])
        rows, cols = np.flatnonzero(there.any(1)), np.flatnonzero(there.any(0))
        h, w = int(np.ptp(rows)) + 1, int(np.ptp(cols)) + 1
        first, last = there.argmax(1), there.shape[1] - 1 - there[:, ::-1].argmax(1)
        share = (last - first + 1)[rows].sum() / (w * h)
        kind = "cylindrical" if abs(share - math.pi / 4) < 0.06 and min(w / h, h / w) > 0.9 else "stacked"
        middle = image[:, cols[0] + w // 2]
        is_c, is_a = np.abs(middle - cathode) <= tolerance, np.abs(middle - anode) <= tolerance
        starts = lambda m: np.flatnonzero(m & ~np.r_[False, m[:-1]])
        cathodes, anodes = starts(is_c), starts(is_a)
        least = None
        for k in cathodes if kind == "stacked" else ():
            line = np.flatnonzero(np.abs(image[k] - cathode) <= tolerance)
            for j in anodes[np.argsort(np.abs(anodes - k))[:2]]:
                other = np.flatnonzero(np.abs(image[j] - anode) <= tolerance)
                d = float(min(line[0] - other[0], other[-1] - line[-1]))
                least = d if least is None else min(least, d)
        return pd.DataFrame([(key[0], key[1], kind, w, h, len(cathodes) + len(anodes), len(cathodes), least)], columns=[c.split()[0] for c in schema.split(", ")])

    return images.groupBy("cell", "section").applyInPandas(run, schema)
