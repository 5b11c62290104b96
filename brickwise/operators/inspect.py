"""Whole porosity inspection: enclosing balls, distances to the surface, numbering, references by material, grown zones,
and the analysis that joins them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.functions.keys import offsets
from brickwise.operators import blocks, decide, histogram, porosity
from brickwise.operators.blocks import BX
from brickwise.operators.components import components, faces
from brickwise.operators.graph import stage
from brickwise.operators.ranking import ranks


def _ball_through(p: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The smallest ball with all of one to four points on it; None if they have none."""
    if len(p) == 1:
        return p[0], 0.0
    d = p[1:] - p[0]
    gram = 2 * d @ d.T
    if np.linalg.matrix_rank(gram) < len(d):
        return None
    centre = p[0] + np.linalg.solve(gram, (d**2).sum(1)) @ d
    return centre, float(np.linalg.norm(centre - p[0]))


def enclosing_ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(centre, radius) of the smallest ball around points (n, 3): the farthest point joins the few that hold the ball
    until none is outside; the best ball through those is found by trying them all."""
    p = points.astype(float)
    held = p[:1]
    centre, radius = p[0], 0.0
    for _ in range(1000):
        d = np.linalg.norm(p - centre, axis=1)
        k = int(d.argmax())
        if d[k] <= radius * (1 + 1e-12) + 1e-12:
            break
        held = np.vstack([held, p[k]])
        best = None
        for size in range(1, min(4, len(held)) + 1):
            for some in combinations(range(len(held)), size):
                got = _ball_through(held[list(some)])
                if got is not None and (np.linalg.norm(held - got[0], axis=1) <= got[1] * (1 + 1e-9) + 1e-9).all() and (best is None or got[1] < best[1]):
                    best = (*got, some)
        centre, radius, some = best
        held = held[list(some)]
    return centre, radius


def enclosing_diameters(pores: DataFrame, pitch: float = 1.0) -> DataFrame:
    """(component, enclosing): the diameter of the smallest ball around a pore's voxel centres, plus one pitch. Only the
    first and last voxel of each line can hold a ball, so that is what a pore's kernel gets."""
    ends = pores.groupBy("component", "y", "z").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.concatenate([pdf[[c, "y", "z"]].to_numpy(float) for c in ("lo", "hi")])
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "enclosing": [(2 * enclosing_ball(p)[1] + 1) * pitch]})

    return ends.groupBy("component").applyInPandas(run, "component long, enclosing double")


def surface_distances(pores: DataFrame, outside: DataFrame, reach: int, pitch: float = 1.0) -> DataFrame:
    """(component, surface_distance): the smallest distance of a pore's voxels from voxels of outside air (x, y, z), null
    beyond the reach. Both sides meet by cells as wide as the reach."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in [(0, 0, 0), *offsets(26)]])
    own = outside.select(*[cell(c).alias(f"g{c}") for c in "xyz"], *[F.col(c).alias(f"o{c}") for c in "xyz"])
    asked = pores.select("component", "x", "y", "z", F.explode(shifts).alias("s")).select("component", "x", "y", "z", *[(cell(c) + F.col(f"s.{c}")).alias(f"g{c}") for c in "xyz"])
    d2 = sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "yz"), (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")))
    near = asked.join(own, ["gx", "gy", "gz"]).groupBy("component").agg(F.min(d2).alias("d2")).where(F.col("d2") <= reach * reach)
    return pores.select("component").distinct().join(near, "component", "left").select("component", (F.sqrt("d2") * pitch).alias("surface_distance"))


def characteristics(pores: DataFrame, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(component, n, volume_mm3, size_mm, area, equivalent, sphericity, enclosing, compactness) of pores in voxels of three
    sizes: the area is two thirds of the open faces, the size the longest side of the bounding box, compactness the volume
    over that of the enclosing ball."""
    cube = voxel[0] * voxel[1] * voxel[2]
    face = F.create_map(*[x for c, s in zip("xyz", voxel, strict=True) for x in (F.lit(c), F.lit(cube / s))])
    area = faces(pores).groupBy("component").agg((F.sum(F.col("faces") * face[F.col("axis")]) * 2 / 3).alias("area"))
    sides = [(F.max(c) - F.min(c) + 1) * s for c, s in zip("xyz", voxel, strict=True)]
    n = pores.groupBy("component").agg(F.count("*").alias("n"), F.greatest(*sides).alias("size_mm"))
    ball = enclosing_diameters(pores.select("component", *[(F.col(c) * s).alias(c) for c, s in zip("xyz", voxel, strict=True)]))
    mean = sum(voxel) / 3
    v = F.col("n") * cube
    enclosing = F.col("enclosing") - 1 + mean
    both = n.join(area, "component").join(ball, "component")
    return both.select(
        "component", "n", v.alias("volume_mm3"), "size_mm", "area",
        F.pow(6 * v / math.pi, F.lit(1 / 3)).alias("equivalent"),
        F.least(F.lit(1.0), math.pi ** (1 / 3) * F.pow(6 * v, F.lit(2 / 3)) / F.col("area")).alias("sphericity"),
        enclosing.alias("enclosing"), (v / (math.pi / 6 * F.pow(enclosing, F.lit(3.0)))).alias("compactness"),
    )


def numbered(rows: DataFrame, found: str, volume: str) -> DataFrame:
    """rows with id, their rank in the order in which they are met, and place, their rank by falling volume. Ranks of a
    whole result come from counts by range: rows are dealt by their order and numbered inside their part."""

    first = ranks(rows, [F.col(found).asc()], "id")
    return ranks(first, [F.col(volume).desc(), F.col("id").asc()], "place")


def material_reference(voxels: DataFrame, labels: DataFrame, size: int = blocks.BLOCK) -> DataFrame:
    """(bx, by, bz, n, reference): what a block's mean would be without voids, its materials' levels weighted by their
    voxels. A material's level is the mean of the blocks that hold only it, but for a sixteenth; a material without such
    a block has the mean of its own voxels."""
    tagged = voxels.select("x", "y", "z", "grey").join(labels.select("x", "y", "z", "material"), ["x", "y", "z"]).where("material > 0")
    by = tagged.groupBy(*blocks.block_columns(size), "material").agg(F.count("*").alias("n"), F.sum(F.col("grey").cast("long")).alias("s"))
    by = stage(by.withColumn("total", F.sum("n").over(Window.partitionBy(*BX))), "material-blocks")
    pure = F.col("n") >= F.col("total") - F.floor(F.col("total") / 16)
    levels = by.groupBy("material").agg(F.avg(F.when(pure, F.col("s") / F.col("n"))).alias("pure"), (F.sum("s") / F.sum("n")).alias("own"))
    levels = levels.select("material", F.coalesce("pure", "own").alias("level"))
    return by.join(levels, "material").groupBy(*BX).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("level")) / F.sum("n")).alias("reference"))


def grown_zones(deficits: DataFrame, flagged: DataFrame, least_void: float = 0.01, least_blocks: int = 2, ring: int = 8, brick: int = 16) -> DataFrame:
    """(zone, blocks, void, porosity, cx, cy, cz) of 26-connected sets of flagged blocks (bx, by, bz): the deficits of
    their blocks and of the one-block rim around them count, less the upper median of the ring outside it if that has
    enough blocks; zones whose porosity is then below the least go."""
    cells = lambda df: df.select(*[F.col(b).alias(c) for b, c in zip(BX, "xyz", strict=True)])
    named = components(cells(flagged), 26, brick=brick)
    size = named.groupBy("component").agg(F.count("*").alias("blocks")).where(F.col("blocks") >= least_blocks)
    members = named.join(size.select("component"), "component", "left_semi")
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in offsets(26)])
    value = deficits.select(*[F.col(b).alias(c) for b, c in zip(BX, "xyz", strict=True)], "deficit")
    plain = value.join(cells(flagged), ["x", "y", "z"], "left_anti")

    def around(df: DataFrame) -> DataFrame:
        moved = df.select("component", "x", "y", "z", F.explode(shifts).alias("o")).select("component", *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"])
        return moved.distinct().join(plain, ["x", "y", "z"]).select("component", "x", "y", "z", "deficit")

    rim = stage(around(members), "zone-rim")
    counted = members.join(value, ["x", "y", "z"]).select("component", "x", "y", "z", "deficit").union(rim)
    outer = around(rim.select("component", "x", "y", "z")).join(rim, ["component", "x", "y", "z"], "left_anti")
    enough = outer.groupBy("component").agg(F.count("*").alias("k")).where(F.col("k") >= ring)
    base = histogram.upper_median(outer.join(enough, "component", "left_semi"), "deficit", ["component"])
    left = counted.join(base, "component", "left").withColumn("d", F.col("deficit") - F.coalesce("median", F.lit(0.0)))
    w = F.greatest("d", F.lit(0.0))
    sums = left.groupBy("component").agg(F.greatest(F.sum("d"), F.lit(0.0)).alias("void"), F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"s{c}") for c in "xyz"])
    out = sums.join(size, "component").withColumn("porosity", F.col("void") / F.col("blocks")).where(F.col("porosity") >= least_void)
    centre = [F.when(F.col("w") > 0, F.col(f"s{c}") / F.col("w")).otherwise(0.0).alias(f"c{c}") for c in "xyz"]
    return out.select(F.col("component").alias("zone"), "blocks", "void", "porosity", *centre)


@dataclass
class Porosity:
    """What an analysis finds: pores and zones as tables, and a summary row."""

    pores: DataFrame
    zones: DataFrame
    summary: DataFrame


def analyse(voxels: DataFrame, size: tuple[int, int, int], voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), threshold: float | None = None, least_voxels: int = 3, least_void: float = 0.01, sigmas: float = 5.0, least_blocks: int = 2, brick: int = 64) -> Porosity:
    """The whole porosity analysis of a volume from which outside air is removed: threshold and air level from the
    histogram, pores and outside air, the material's level and noise from blocks clear of both, pore volumes by grey
    values, zones, and the part's volume."""
    cube = voxel[0] * voxel[1] * voxel[2]
    box = ((0, 0, 0), size)
    counts = decide.counts_of(histogram.grey_histogram(voxels))
    t = decide.air_threshold(counts) if threshold is None else threshold
    below = np.arange(65536) < t
    air = float((counts * np.arange(65536))[below].sum() / max(counts[below].sum(), 1))
    found = stage(porosity.labelled_candidates(voxels, t, brick), "porosity")
    pores = found.where((~F.col("outside")) & (F.col("n") >= least_voxels)).select("x", "y", "z", "grey", "component")
    band = porosity.surface_band(found.where("outside").select("x", "y", "z"), box)
    shell = blocks.dilate(pores, 1, 26, box)
    spoilt = stage(band.union(shell).distinct(), "band")
    clear = voxels.join(spoilt, ["x", "y", "z"], "left_anti")
    statistics = stage(blocks.block_statistics(clear, t), "clear-blocks")
    sound = statistics.where((F.col("n") >= 128) & (F.col("below") <= 32)).select("mean", "variance", F.lit(1).alias("one"))
    level = histogram.upper_median(sound, "mean", ["one"]).first()
    noise = histogram.upper_median(sound, "variance", ["one"]).first()
    if level is None:
        # A part without a block clear of its surface: the voxels themselves tell the level, and nothing tells the noise.
        material, sigma = decide.material_level(voxels, t, side=brick), 0.0
    else:
        material, sigma = float(level["median"]), math.sqrt(float(noise["median"]))
    contrast = material - air
    volumes = porosity.pore_volumes(voxels, pores, material, air, cube)
    shapes = characteristics(pores, voxel).drop("volume_mm3")
    rows = numbered(volumes.join(shapes, "component").withColumnRenamed("component", "key"), "key", "volume_mm3")
    deficit = statistics.where(F.col("n") >= 128).select(*BX, "n", ((material - F.col("mean")) * F.col("n") / contrast / 512).alias("deficit"))
    limit = F.greatest(F.lit(least_void), sigmas * sigma * F.sqrt("n") / 512 / contrast)
    zones = stage(grown_zones(deficit, deficit.where(F.col("deficit") > limit), least_void, least_blocks), "zones")
    part = porosity.part_volume(voxels, material, air, cube)
    pore_void = rows.agg(F.coalesce(F.sum("volume_mm3"), F.lit(0.0)).alias("pore_void_mm3"), F.count("*").alias("pores"))
    zone_void = zones.agg((F.coalesce(F.sum("void"), F.lit(0.0)) * 512 * cube).alias("zone_void_mm3"), F.count("*").alias("zones"))
    total = F.col("volume_mm3") + F.col("pore_void_mm3") + F.col("zone_void_mm3")
    # Three one-row tables.
    summary = part.join(pore_void).join(zone_void).select(
        F.lit(t).alias("threshold"), F.lit(air).alias("air_level"), F.lit(material).alias("material_level"), F.lit(sigma).alias("noise_sigma"),
        "pores", "zones", "pore_void_mm3", "zone_void_mm3", total.alias("part_volume_mm3"), (100 * (F.col("pore_void_mm3") + F.col("zone_void_mm3")) / total).alias("porosity_percent"),
    )
    return Porosity(rows, zones, summary)


#: The criteria of a zone, whether the measured value is at most or at least the limit, and what they judge.
CRITERIA = {
    "max_pore_size_mm": ("most", "size_mm"),
    "max_pore_count": ("most", None),
    "max_porosity_percent": ("most", None),
    "loosening": ("most", None),
    "max_global_porosity_percent": ("most", None),
    "max_reference_porosity_percent": ("most", None),
    "max_pore_volume_mm3": ("most", "volume_mm3"),
    "max_enclosing_diameter_mm": ("most", "enclosing"),
    "max_equivalent_diameter_mm": ("most", "equivalent"),
    "min_sphericity": ("least", "sphericity"),
    "min_compactness": ("least", "compactness"),
    "min_pore_gap_mm": ("least", None),
    "min_surface_distance_mm": ("least", "surface_distance"),
}


def criteria(zones: DataFrame, pores: DataFrame, loosened: DataFrame, part_mm3: float, disregarded: Column | None = None, gaps: DataFrame | None = None, references: DataFrame | None = None, cell: float = 16.0) -> DataFrame:
    """(zone, criterion, measured, bound, ok, pore): a row for each limit that a zone sets. zones are boxes (zone, x0 .. z1,
    part_mm3, count_min_size_mm, allow_loosening, a column for each limit, null where there is none); pores (id, x, y, z in
    mm, volume_mm3, size_mm, equivalent, enclosing, sphericity, compactness, surface_distance); loosened (x, y, z,
    void_mm3); gaps (a, b, gap_mm) of pore pairs; references (zone, porosity) of reference volumes.

    A pore is in a zone if its centre is; disregarded pores don't count anywhere. A zone without pores passes. Pores and
    zones meet by grid cells in all three axes, so an order of many zones doesn't meet every pore."""
    skip = F.lit(False) if disregarded is None else disregarded
    kept = pores.where(~F.coalesce(skip, F.lit(False)))
    spans = [F.sequence(F.floor(F.col(f"{c}0") / cell), F.floor(F.col(f"{c}1") / cell)) for c in "xyz"]
    dealt = zones
    for c, s in zip("xyz", spans, strict=True):
        dealt = dealt.withColumn(f"g{c}", F.explode(s))
    dealt = dealt.select("zone", *[f"{c}{k}" for c in "xyz" for k in (0, 1)], *[f"g{c}" for c in "xyz"])

    def inside(rows: DataFrame) -> DataFrame:
        hit = rows.withColumns({f"g{c}": F.floor(F.col(c) / cell) for c in "xyz"}).join(dealt, ["gx", "gy", "gz"])
        for c in "xyz":
            hit = hit.where((F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}1")))
        return hit.select("zone", *rows.columns)

    tagged = inside(kept).join(zones.select("zone", "count_min_size_mm"), "zone")
    best = []
    for name, (kind, value) in CRITERIA.items():
        if value is not None:
            pick = F.max(F.struct(F.col(value).alias("v"), (-F.col("id")).alias("id"))) if kind == "most" else F.min(F.struct(F.col(value).alias("v"), F.col("id").alias("id")))
            best.append(F.max(F.lit(None)).alias(name) if value not in pores.columns else (pick if kind == "most" else pick).alias(name))
    sums = tagged.groupBy("zone").agg(F.count(F.when(F.col("size_mm") >= F.coalesce("count_min_size_mm", F.lit(0.0)), F.lit(1))).alias("counted"), F.sum("volume_mm3").alias("void"), *best)
    loose = inside(loosened).groupBy("zone").agg(F.count("*").alias("loose"), F.sum("void_mm3").alias("loose_void"))
    every = kept.agg(F.coalesce(F.sum("volume_mm3"), F.lit(0.0)).alias("all_void")).join(loosened.agg(F.coalesce(F.sum("void_mm3"), F.lit(0.0)).alias("all_loose")))
    rows = zones.join(sums, "zone", "left").join(loose, "zone", "left").join(F.broadcast(every))
    if gaps is not None:
        of = tagged.select("zone", F.col("id"))
        pair = gaps.join(of.withColumnRenamed("id", "a"), "a").join(of.select(F.col("zone").alias("other"), F.col("id").alias("b")), "b").where("zone = other")
        rows = rows.join(pair.groupBy("zone").agg(F.min(F.struct("gap_mm", "a")).alias("gap")), "zone", "left")
    if references is not None:
        rows = rows.join(references.select("zone", F.col("porosity").alias("reference")), "zone", "left")
    nothing = F.lit(0.0)
    far = F.lit(float("inf"))
    out = []
    for name, (kind, value) in CRITERIA.items():
        worst = F.lit(None).cast("long")
        if value is not None:
            at = F.col(name)
            measured = F.coalesce(at["v"], nothing if kind == "most" else far)
            worst = F.when(at["v"].isNotNull(), -at["id"] if kind == "most" else at["id"])
        elif name == "max_pore_count":
            measured = F.coalesce("counted", F.lit(0)).cast("double")
        elif name == "max_porosity_percent":
            measured = F.when(F.col("part_mm3") > 0, 100 * (F.coalesce("void", nothing) + F.coalesce("loose_void", nothing)) / F.col("part_mm3")).otherwise(0.0)
        elif name == "loosening":
            measured = F.coalesce("loose", F.lit(0)).cast("double")
        elif name == "max_global_porosity_percent":
            measured = (100 * (F.col("all_void") + F.col("all_loose")) / part_mm3) if part_mm3 > 0 else nothing
        elif name == "max_reference_porosity_percent":
            measured = F.coalesce("reference", nothing) if references is not None else nothing
        else:
            measured = F.coalesce(F.col("gap.gap_mm"), far) if gaps is not None else far
            worst = F.col("gap.a") if gaps is not None else worst
        if name == "loosening":
            limit = F.when(~F.coalesce("allow_loosening", F.lit(True)), F.lit(0.0))
        else:
            limit = F.col(f"limit_{name}").cast("double")
        ok = ~(measured > limit) if kind == "most" else ~(measured < limit)
        out.append(F.struct(F.lit(name).alias("criterion"), measured.cast("double").alias("measured"), limit.alias("bound"), ok.alias("ok"), worst.cast("long").alias("pore")))
    return rows.select("zone", F.explode(F.array(*out)).alias("r")).select("zone", "r.*").where("bound is not null")
