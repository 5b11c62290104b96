"""Porosity: candidates, pores, volumes by grey value, material level, zones and part volume."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from brickwise.functions.keys import offsets
from brickwise.operators.blocks import BX, block_columns, dilate
from brickwise.operators.components import components, faces
from brickwise.operators.graph import stage
from brickwise.operators.histogram import upper_median


def candidates(voxels: DataFrame, threshold: float) -> DataFrame:
    """(x, y, z, grey, seed) of active voxels below the threshold; a seed has an inactive face neighbour. Neighbours
    are counted by windows along the axes, one shuffle each, instead of six joins."""
    found = voxels.select("x", "y", "z", "grey")
    for axis in "xyz":
        rest = [c for c in "xyz" if c != axis]
        w = Window.partitionBy(*rest).orderBy(axis)
        both = (F.lag(axis).over(w) == F.col(axis) - 1).cast("int"), (F.lead(axis).over(w) == F.col(axis) + 1).cast("int")
        found = found.withColumn(f"n{axis}", F.coalesce(both[0], F.lit(0)) + F.coalesce(both[1], F.lit(0)))
    return found.where(F.col("grey") < threshold).select("x", "y", "z", "grey", (F.col("nx") + F.col("ny") + F.col("nz") < 6).alias("seed"))


def labelled_candidates(voxels: DataFrame, threshold: float, brick: int = 64) -> DataFrame:
    """Candidates with their 26-connected component and whether any voxel of it is a seed."""
    found = stage(candidates(voxels, threshold), "candidates")
    labels = components(found, 26, brick=brick).join(found, ["x", "y", "z"])
    outside = labels.groupBy("component").agg(F.bool_or("seed").alias("outside"), F.count("*").alias("n"))
    return labels.join(outside, "component")


def find_pores(voxels: DataFrame, threshold: float, least: int = 3, brick: int = 64) -> DataFrame:
    """(x, y, z, grey, component) of the pores: components without a seed, of so many voxels at least."""
    return labelled_candidates(voxels, threshold, brick).where((~F.col("outside")) & (F.col("n") >= least)).select("x", "y", "z", "grey", "component")


def surface_band(outside: DataFrame, box, steps: int = 3) -> DataFrame:
    return dilate(outside, steps, 26, box)


def void_fraction(material: float, air: float) -> Column:
    """The share of a voxel that is void; an inactive voxel (null) is all void."""
    return F.when(F.col("grey").isNull(), F.lit(1.0)).otherwise((material - F.col("grey")) / (material - air))


def pore_volumes(voxels: DataFrame, pores: DataFrame, material: float, air: float, voxel_mm3: float = 1.0) -> DataFrame:
    """(component, volume_mm3, cx, cy, cz): the void fractions of each pore and its one-voxel shell, not clamped in the
    volume, clamped in the centre, which is NaN where nothing of the clamped sum is left. A voxel in the shells of two pores counts for both."""
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in [(0, 0, 0), *offsets(26)]])
    shell = pores.select("component", "x", "y", "z", F.explode(shifts).alias("o")).select("component", *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "xyz"]).distinct()
    f = shell.join(voxels.select("x", "y", "z", "grey"), ["x", "y", "z"], "left").withColumn("f", void_fraction(material, air))
    c = F.least(F.greatest("f", F.lit(0.0)), F.lit(1.0))
    sums = f.groupBy("component").agg((F.sum("f") * voxel_mm3).alias("volume_mm3"), F.sum(c).alias("w"), *[F.sum(c * F.col(a)).alias(f"s{a}") for a in "xyz"])
    return sums.select("component", "volume_mm3", *[F.when(F.col("w") > 0, F.col(f"s{a}") / F.col("w")).otherwise(F.lit(float("nan"))).alias(f"c{a}") for a in "xyz"])


def material_level(statistics: DataFrame, most_below: int = 32, full: int = 512) -> DataFrame:
    """One row (level, sigma): medians of the means and variances of full blocks with few voxels below the threshold."""
    sound = statistics.where((F.col("n") == full) & (F.col("below") <= most_below)).select("mean", "variance", F.lit(1).alias("one"))
    level = upper_median(sound, "mean", ["one"]).select("one", F.col("median").alias("level"))
    noise = upper_median(sound, "variance", ["one"]).select("one", F.sqrt("median").alias("sigma"))
    return level.join(noise, "one").select("level", "sigma")


def depth_levels(blocks: DataFrame, value: str, depth: str, width: float = 2.0, least: int = 4) -> DataFrame:
    """(bin, level): the upper median of the blocks in each depth bin that has enough of them."""
    tagged = blocks.select(F.floor(F.col(depth) / width).cast("int").alias("bin"), F.col(value).alias("v"))
    n = tagged.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return upper_median(tagged.join(n, "bin", "left_semi"), "v", ["bin"]).select("bin", F.col("median").alias("level"))


def level_at_depth(points: DataFrame, depth: str, levels: DataFrame, width: float = 2.0) -> DataFrame:
    """points with the level at their depth, linear between bin centres and constant beyond the ends. The curve has a
    row for each depth bin; it is gathered into one array and broadcast, its size checked by the bins."""
    curve = levels.agg(F.array_sort(F.collect_list(F.struct(((F.col("bin") + 0.5) * width).alias("d"), F.col("level").cast("double").alias("v")))).alias("curve"))
    at = points.join(F.broadcast(curve))
    d = F.col(depth).cast("double")
    below = F.filter("curve", lambda p: p["d"] <= d)
    above = F.filter("curve", lambda p: p["d"] > d)
    lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    value = F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * (d - lo["d"]) / (hi["d"] - lo["d"]))
    return at.withColumn("level", value).drop("curve")


def flag_zones(statistics: DataFrame, material: float, air: float, noise: float, least_void: float = 0.01, sigmas: float = 5.0, full: int = 512, brick: int = 16, least_blocks: int = 2) -> DataFrame:
    """(bx, by, bz, deficit, zone) of blocks whose void fraction is over its least value and over the noise of a block
    mean, in 26-connected sets of so many blocks at least."""
    sigma = noise * F.sqrt("n") / full / (material - air)
    deficit = (material - F.col("mean")) / (material - air)
    flagged = statistics.where(F.col("n") == full).select(*BX, deficit.alias("deficit"), sigma.alias("sigma")).where(F.col("deficit") > F.greatest(F.lit(least_void), sigmas * F.col("sigma")))
    cells = flagged.select(*[F.col(b).alias(c) for b, c in zip(BX, "xyz", strict=True)], "deficit")
    named = components(cells.select("x", "y", "z"), 26, brick=brick)
    size = named.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least_blocks)
    kept = named.join(size, "component", "left_semi").join(cells, ["x", "y", "z"])
    return kept.select(*[F.col(c).alias(b) for b, c in zip(BX, "xyz", strict=True)], "deficit", F.col("component").alias("zone"))


def part_volume(voxels: DataFrame, material: float, air: float, voxel_mm3: float = 1.0) -> DataFrame:
    """The sum of (g - air) / contrast; the sum of grey values is exact before it is scaled."""
    s = voxels.agg(F.sum(F.col("grey").cast("long")).alias("s"), F.count("*").alias("n"))
    return s.select(((F.col("s") - air * F.col("n")) / (material - air) * voxel_mm3).alias("volume_mm3"))


def region_part_volume(voxels: DataFrame, regions: DataFrame, material: float, air: float) -> DataFrame:
    """(name, volume) for boxes (name, x0, y0, z0, x1, y1, z1): box rows meet the blocks that they touch, not voxels one
    by one; only voxels of those blocks are tested."""
    spans = [F.sequence(F.floor(F.col(f"{c}0") / 8), F.floor((F.col(f"{c}1") - 1) / 8)) for c in "xyz"]
    each = regions.select("*", F.explode(spans[0]).alias("bx")).select("*", F.explode(spans[1]).alias("by")).select("*", F.explode(spans[2]).alias("bz"))
    each = each.select(*regions.columns, *[F.col(b).cast("int").alias(b) for b in BX])
    tagged = voxels.select("x", "y", "z", "grey", *block_columns())
    hit = tagged.join(each, BX)
    for c in "xyz":
        hit = hit.where((F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}1")))
    return hit.groupBy("name").agg(((F.sum(F.col("grey").cast("long")) - air * F.count("*")) / (material - air)).alias("volume"))


def reference_porosity(voxels: DataFrame, edge: int, step: int, size: int, material: float, air: float) -> DataFrame:
    """One row (x, y, z, porosity): the cube of an edge, on a grid of steps, with the highest void fraction of its active
    voxels. Sums over cubes come from sums over step-sized cells and one window along each axis."""
    cells = voxels.groupBy(*[F.floor(F.col(c) / step).cast("int").alias(c) for c in "xyz"]).agg(F.sum(F.col("grey").cast("long")).alias("s"), F.count("*").alias("n"))
    from brickwise.operators.volume import lattice

    count = size // step
    full = lattice(voxels.sparkSession, ((0, 0, 0), (count, count, count))).join(cells, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("n", F.lit(0)).alias("n"))
    k = edge // step
    for axis in "xyz":
        rest = [c for c in "xyz" if c != axis]
        w = Window.partitionBy(*rest).orderBy(axis).rowsBetween(0, k - 1)
        full = full.select("x", "y", "z", F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n"))
    inside = (F.col("x") <= count - k) & (F.col("y") <= count - k) & (F.col("z") <= count - k) & (F.col("n") > 0)
    p = F.round((material * F.col("n") - F.col("s")) / (F.col("n") * (material - air)), 9)
    best = full.where(inside).select("x", "y", "z", p.alias("p")).agg(F.max_by(F.struct("x", "y", "z", "p"), F.struct("p", -F.col("z"), -F.col("y"), -F.col("x"))).alias("m"))
    return best.select(*[(F.col(f"m.{c}") * step).cast("int").alias(c) for c in "xyz"], F.col("m.p").alias("porosity"))


def pore_shapes(pores: DataFrame, pitch: float = 1.0) -> DataFrame:
    """(component, n, area, equivalent_diameter, sphericity, size): area is two thirds of the open faces, sphericity is
    capped at 1, size is the longest side of the bounding box."""
    area = faces(pores).groupBy("component").agg((F.sum("faces") * pitch * pitch * 2 / 3).alias("area"))
    n = pores.groupBy("component").agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c) + 1).alias(f"s{c}") for c in "xyz"])
    v = F.col("n") * pitch**3
    ball = math.pi ** (1 / 3) * F.pow(6 * v, F.lit(2 / 3))
    return n.join(area, "component").select("component", "n", "area", F.pow(6 * v / math.pi, F.lit(1 / 3)).alias("equivalent_diameter"), F.least(F.lit(1.0), ball / F.col("area")).alias("sphericity"), (F.greatest("sx", "sy", "sz") * pitch).alias("size"))


def smallest_gap(pores: DataFrame, reach: int) -> DataFrame:
    """(a, b, gap2): the smallest squared voxel distance between any two pores within reach. Voxels meet by cells of the
    reach: a pore's voxel is dealt to the 27 cells around its own, so close pairs share one."""
    cell = [F.floor(F.col(c) / reach).cast("int") for c in "xyz"]
    own = pores.select(F.col("component").alias("b"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[k.alias(f"g{c}") for c, k in zip("xyz", cell, strict=True)])
    shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in [(0, 0, 0), *offsets(26)]])
    dealt = pores.select(F.col("component").alias("a"), "x", "y", "z", F.explode(shifts).alias("s")).select("a", "x", "y", "z", *[(F.floor(F.col(c) / reach) + F.col(f"s.{c}")).cast("int").alias(f"g{c}") for c in "xyz"])
    near = dealt.join(own, ["gx", "gy", "gz"]).where("a < b")
    d2 = sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "yz"), (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")))
    return near.groupBy("a", "b").agg(F.min(d2).cast("long").alias("gap2")).where(F.col("gap2") <= reach * reach)


def closest_pores(pores: DataFrame, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(a, b, gap): of the pores (component, x, y, z) the two that come closest, a < b, and how much lies between their voxels, in
    units of the voxel sizes; touching pores have gap 0, and of equal gaps the smallest pair counts. Fewer than two pores give no row.

    There is no reach. Pores become sets of cells, wide ones first and half as wide from round to round, until no cells of two pores are neighbours:
    counts by cell tell, no pairs are made, and narrow cells, which are many, are made only if pores are as close. From the last width with
    neighbours the pairs of near cells are refined, half as wide a round, and only those are kept that can
    still hold a gap as small as the best upper bound, down to the voxels themselves. A cell's bounds are those of the voxels that it holds, and a voxel of each is
    tried, so what is compared is what lies near the answer."""
    around = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, "xyz", strict=True)]) for o in [(0, 0, 0), *offsets(26)]])
    own = stage(pores.select("component", "x", "y", "z").distinct(), "pore-cells")
    sides = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]

    def cells(k: int) -> DataFrame:
        return own.groupBy("component", *[F.shiftright(c, k).alias(f"c{c}") for c in "xyz"]).agg(*sides, F.min(F.struct("x", "y", "z")).alias("some"))

    def sent(k: int) -> DataFrame:
        rows = own.select("component", *[F.shiftright(c, k).alias(f"o{c}") for c in "xyz"]).distinct()
        return rows.select("component", "ox", "oy", "oz", F.explode(around).alias("s")).select("component", "ox", "oy", "oz", *[(F.col(f"o{c}") + F.col(f"s.{c}")).alias(c) for c in "xyz"])

    ends = own.agg(F.min("component"), F.max("component"), *[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    if ends[0] is None or ends[0] == ends[1]:
        return pores.sparkSession.createDataFrame([], "a long, b long, gap double")
    # Cells as wide as all pores together are neighbours; if a width has neighbours, so has every larger one.
    level = max(hi - lo for lo, hi in zip(ends[2::2], ends[3::2], strict=True)).bit_length()
    while level and not sent(level - 1).groupBy("x", "y", "z").agg((F.min("component") != F.max("component")).alias("met")).where("met").isEmpty():
        level -= 1
    # Neighbours of that width bound the gap by less than two cells' width each way. Cells wide enough for such a gap along any axis are neighbours.
    level += math.ceil(math.log2(2 * math.hypot(*voxel) / min(voxel)))
    tops = own.select("component", *[F.shiftright(c, level).alias(c) for c in "xyz"]).distinct()
    pairs = sent(level).withColumnRenamed("component", "a").join(tops.withColumnRenamed("component", "b").hint("merge"), ["x", "y", "z"]).where("a < b")
    pairs = pairs.select("a", "b", *[F.col(f"o{c}").alias(f"a{c}") for c in "xyz"], *[F.col(c).alias(f"b{c}") for c in "xyz"])

    def length(apart: list[Column]) -> Column:
        return F.sqrt(sum(((g * v) * (g * v) for g, v in zip((F.greatest(d - 1, F.lit(0)) for d in apart), voxel, strict=True)), F.lit(0.0)))

    while True:
        for end in "ab":
            box = stage(cells(level), "pore-boxes") if end == "a" else box
            pairs = pairs.join(box.select(F.col("component").alias(end), *[F.col(f"c{c}").alias(f"{end}{c}") for c in "xyz"], *[F.col(n).alias(f"{end}{n}") for n in ("some", *(f"{n}{c}" for c in "xyz" for n in ("lo", "hi")))]).hint("merge"), [end, *(f"{end}{c}" for c in "xyz")])
        low = length([F.greatest(F.col(f"blo{c}") - F.col(f"ahi{c}"), F.col(f"alo{c}") - F.col(f"bhi{c}")) for c in "xyz"])
        high = length([F.abs(F.col(f"asome.{c}") - F.col(f"bsome.{c}")) for c in "xyz"])
        pairs = stage(pairs.select("a", "b", *[f"{e}{c}" for e in "ab" for c in "xyz"], low.alias("low"), high.alias("high")), "pore-pairs")
        best = pairs.agg(F.min("high")).first()[0]
        pairs = pairs.where(F.col("low") <= best)
        if not level:
            return pairs.agg(F.min(F.struct("low", "a", "b")).alias("m")).select("m.a", "m.b", F.col("m.low").alias("gap"))
        level -= 1
        finer = own.select("component", *[F.shiftright(c, level).alias(c) for c in "xyz"]).distinct()
        for end in "ab":
            child = finer.select(F.col("component").alias(end), *[F.shiftright(c, 1).alias(f"{end}{c}") for c in "xyz"], *[F.col(c).alias(f"n{c}") for c in "xyz"])
            keys = [end, *(f"{end}{c}" for c in "xyz")]
            pairs = pairs.drop("low", "high").join(child.hint("merge"), keys).drop(*keys[1:]).withColumnsRenamed({f"n{c}": f"{end}{c}" for c in "xyz"})
