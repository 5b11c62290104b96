"""Blocks of 8^3 voxels, the removal of outside air, dilation, and the resolution pyramid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from brickwise.functions.keys import BLOCK, offsets, unkey, voxel_key
from brickwise.operators.graph import connected_components, stage

BX = ["bx", "by", "bz"]
#: Blocks a side of the tiles in which ways between blocks are solved whole.
TILE = 16


def block_columns(size: int = BLOCK) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("int").alias(f"b{c}") for c in "xyz"]


def block_statistics(voxels: DataFrame, threshold: float, size: int = BLOCK) -> DataFrame:
    """Count, mean, population variance, largest value and values below and above the threshold of each block, from
    sums of integers that are made before the shuffle."""
    g = F.col("grey").cast("long")
    sums = voxels.groupBy(*block_columns(size)).agg(
        F.count("*").alias("n"), F.sum(g).alias("s"), F.sum(g * g).alias("q"), F.max("grey").alias("top"), F.sum((F.col("grey") > threshold).cast("long")).alias("above"), F.sum((F.col("grey") < threshold).cast("long")).alias("below")
    )
    mean = F.col("s") / F.col("n")
    return sums.select(*BX, "n", "top", "above", "below", mean.alias("mean"), ((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n"))).alias("variance"))


def classify_blocks(voxels: DataFrame, threshold: float, least: int = 1, size: int = BLOCK) -> DataFrame:
    """(bx, by, bz, material): material if the least-th largest value of the block is above the threshold, that is if
    so many are."""
    return block_statistics(voxels, threshold, size).select(*BX, (F.col("above") >= least).alias("material"))


def outside_air(blocks: DataFrame, counts: tuple[int, int, int], open_axes: str = "xyz") -> DataFrame:
    """The air blocks that reach the faces of the open axes over face-connected air blocks. The flood is the
    connected components of the air blocks, those with a block at an open face: no frontier loop, and the
    block table has 512 times fewer rows than the volume."""
    air = blocks.where("not material").select(*BX)
    keyed = air.select(*BX, voxel_key(*BX).alias("a"))
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, BX, strict=True)]) for o in offsets(6) if sum(o) > 0])
    moved = keyed.select("a", *BX, F.explode(shifts).alias("o")).select("a", *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in BX])
    edges = moved.join(keyed.select(*BX, F.col("a").alias("b")), BX).select("a", "b")
    roots = connected_components(edges)
    face = F.lit(False)
    for axis, c, n in zip("xyz", BX, counts, strict=True):
        if axis in open_axes:
            face = face | (F.col(c) == 0) | (F.col(c) == n - 1)
    named = keyed.join(roots.withColumnRenamed("node", "a"), "a", "left").select(*BX, F.coalesce("root", "a").alias("root"), face.alias("face"))
    reached = named.groupBy("root").agg(F.bool_or("face").alias("face")).where("face").select("root")
    return named.join(reached, "root", "left_semi").select(*BX)


def dilate(mask: DataFrame, steps: int, count: int, box) -> DataFrame:
    """Voxels (x, y, z) of a mask and all within so many steps of 6, 18 or 26 neighbours, clipped to the box."""
    lo, hi = box
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in [(0, 0, 0), *offsets(count)]])
    now = mask.select("x", "y", "z")
    for _ in range(steps):
        now = now.select("x", "y", "z", F.explode(shifts).alias("o")).select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"])
        for c, a, b in zip("xyz", lo, hi, strict=True):
            now = now.where((F.col(c) >= a) & (F.col(c) < b))
        now = now.distinct()
    return now


def erode(mask: DataFrame, count: int) -> DataFrame:
    """Voxels whose neighbours are all in the mask; the border of the volume counts as outside."""
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in offsets(count)])
    votes = mask.select("x", "y", "z", F.explode(shifts).alias("o")).select(*[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"]).groupBy("x", "y", "z").agg(F.count("*").alias("n")).where(F.col("n") == len(offsets(count)))
    return mask.join(votes.select("x", "y", "z"), ["x", "y", "z"], "left_semi").select("x", "y", "z")


def sieve(voxels: DataFrame, threshold: float, size: tuple[int, int, int], margin: int = 3, least: int = 1, open_axes: str = "xyz", block: int = BLOCK) -> DataFrame:
    """The voxels of the blocks that aren't outside air, dilated by a margin over faces and edges; values are kept."""
    counts = tuple(-(-n // block) for n in size)
    outside = outside_air(classify_blocks(voxels, threshold, least, block), counts, open_axes)
    tagged = voxels.select("x", "y", "z", "grey", *block_columns(block))
    kept = tagged.join(outside, BX, "left_anti").select("x", "y", "z")
    if not margin:
        return voxels.join(kept, ["x", "y", "z"], "left_semi")
    # A margin reaches only the blocks next to kept ones: the dilation starts from voxels at their rims.
    rim = F.lit(False)
    for c in "xyz":
        rim = rim | (F.col(c) % block == 0) | (F.col(c) % block == block - 1)
    grown = dilate(kept.where(rim), margin, 18, ((0, 0, 0), size))
    return voxels.join(kept.union(grown).distinct(), ["x", "y", "z"], "left_semi").select("x", "y", "z", "grey")


def pyramid_level(voxels: DataFrame) -> DataFrame:
    """The next coarser level: the mean of up to eight active children, rounded half up. Sums are made before the
    shuffle, and the next level's keys are the same ones shifted."""
    sums = voxels.groupBy(*[F.shiftright(c, 1).alias(c) for c in "xyz"]).agg(F.sum("grey").alias("s"), F.count("*").alias("n"))
    return sums.select("x", "y", "z", F.floor((2 * F.col("s") + F.col("n")) / (2 * F.col("n"))).cast("int").alias("grey"))


def majority_level(labels: DataFrame) -> DataFrame:
    """The next coarser level of labels: the most frequent label of the children, the smaller of equals; air (0) only
    if all eight are air, that is if no child has a row."""
    by = labels.where("label > 0").groupBy(*[F.shiftright(c, 1).alias(c) for c in "xyz"], "label").agg(F.count("*").alias("n"))
    return by.groupBy("x", "y", "z").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def k_largest(voxels: DataFrame, k: int, size: int = BLOCK) -> DataFrame:
    """The k largest values of each block with their rank."""
    tagged = voxels.select(*block_columns(size), "grey", "x", "y", "z")
    w = Window.partitionBy(*BX).orderBy(F.desc("grey"), "z", "y", "x")
    return tagged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*BX, "rank", "grey")


def block_depth(blocks: DataFrame, seeds: DataFrame, rounds: int | None = None, step: float = 8) -> DataFrame:
    """(bx, by, bz, depth): the least of a seed's own depth plus a step for each face passed on the way from it through the
    given blocks. seeds are (bx, by, bz) with depth, or 0 without; with rounds, only blocks so many steps from a seed.

    Tiles of TILE^3 blocks are solved whole by a kernel; what leaves a round are the depths on the rims of tiles
    that fell, so the rounds are as many as tiles on the longest way, until nothing falls. Blocks off every way have no row."""
    start = seeds.select(*BX, (F.col("depth") if "depth" in seeds.columns else F.lit(0)).cast("double").alias("depth"))
    tile = [F.floor(F.col(c) / TILE).cast("int").alias(f"t{c[1]}") for c in BX]
    cells = stage(blocks.select(*BX).distinct().join(start.groupBy(*BX).agg(F.min("depth").alias("depth")), BX, "left").select(*tile, *BX, "depth"), "depth-cells")
    limit = None if rounds is None else (rounds + 1e-9) * step

    def solver(first: bool):
        def solve(key: tuple, pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pd.DataFrame({c: [] for c in [*BX, "depth", "fell", "tx", "ty", "tz"]})
            inside = np.zeros((TILE + 2,) * 3, dtype=bool)
            depth = np.full((TILE + 2,) * 3, np.inf)
            base = np.array(key) * TILE - 1
            at = tuple((pdf[BX].to_numpy() - base).T)
            inside[at] = True
            depth[at] = pdf["depth"].fillna(np.inf)
            before = np.full_like(depth, np.inf) if first else depth.copy()
            if len(asked):
                depth[tuple((asked[BX].to_numpy() - base).T)] = asked["depth"]
            open_ = True
            while open_:
                way = depth.copy()
                for axis in range(3):
                    for side in (-1, 1):
                        way = np.minimum(way, np.where(inside, np.roll(depth, side, axis) + step, np.inf))
                way = np.where(inside, way, depth)
                open_ = bool((way < depth).any())
                depth = way
            fell = depth < before
            return pdf[BX].assign(depth=depth[at], fell=fell[at], tx=key[0], ty=key[1], tz=key[2]).replace({"depth": {np.inf: np.nan}})

        return solve

    out = "bx int, by int, bz int, depth double, fell boolean, tx int, ty int, tz int"
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, BX, strict=True)]) for o in offsets(6)])
    none = cells.limit(0).select("tx", "ty", "tz", *BX, "depth")
    touched, told, first = cells, none, True
    keys = ["tx", "ty", "tz"]
    while True:
        solved = touched.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(solver(first), out)
        rest = cells.limit(0) if first else cells.join(touched.select(*keys).distinct(), keys, "left_anti")
        cells, first = stage(solved.unionByName(rest.withColumn("fell", F.lit(False))), "depth-round"), False
        fell = cells.where("fell").select("tx", "ty", "tz", *BX, "depth")
        sent = fell.select(*[F.col(k).alias(f"from_{k}") for k in keys], *BX, "depth", F.explode(shifts).alias("o"))
        to = [F.floor((F.col(c) + F.col(f"o.{c}")) / TILE).cast("int").alias(f"t{c[1]}") for c in BX]
        sent = sent.select(*to, *[f"from_{k}" for k in keys], *BX, "depth").where("tx != from_tx or ty != from_ty or tz != from_tz")
        told = stage(sent.select(*keys, *BX, "depth").distinct(), "depth-rims")
        if told.isEmpty():
            break
        cells = cells.drop("fell")
        touched = cells.join(told.select(*keys).distinct(), keys, "left_semi")
    found = cells.where("depth is not null").select(*BX, "depth")
    return found if limit is None else found.where(F.col("depth") <= limit)


def depth_seeds(filled: DataFrame, full: int = BLOCK**3, size: int = BLOCK) -> DataFrame:
    """(bx, by, bz, depth) of blocks at least half in the part with a neighbour over a face that isn't wholly, from filled
    (bx, by, bz, n), the part's voxels in each block: between blocks of shares f and g the surface stands so that the first one's
    centre is size (f + g) - size / 2 deep; the least of its neighbours counts."""
    own = filled.where(F.col("n") * 2 >= full).select(*BX, (F.col("n") / full).alias("f"))
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, BX, strict=True)]) for o in offsets(6)])
    asked = own.select(*[F.col(c).alias(f"a{c}") for c in BX], "f", F.explode(shifts).alias("o")).select("abx", "aby", "abz", "f", *[(F.col(f"a{c}") + F.col(f"o.{c}")).alias(c) for c in BX])
    met = asked.join(filled.select(*BX, (F.col("n") / full).alias("g")), BX, "left").withColumn("g", F.coalesce("g", F.lit(0.0))).where("g < 1")
    return met.groupBy(*[F.col(f"a{c}").alias(c) for c in BX]).agg(F.min(size * (F.col("f") + F.col("g")) - size / 2).alias("depth"))


def unkeyed(df: DataFrame, key: str = "key") -> DataFrame:
    return df.select(*unkey(key), *[c for c in df.columns if c != key])
