"""Grey histograms and the thresholds that follow from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def grey_histogram(voxels: DataFrame, value: str = "grey") -> DataFrame:
    """(v, n): a row for each value that occurs, 65536 for 16-bit volumes at most, so what follows is small."""
    return voxels.groupBy(F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """One row (threshold, air_level): the value with the largest between-class variance, the smallest of equals,
    plus a half; and the mean of what lies below."""
    # A histogram has at most one row for each grey value: a single window over it is bounded.
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    c = hist.select("v", F.sum("n").over(w).alias("n0"), F.sum(F.col("v") * F.col("n")).over(w).alias("s0"), F.sum("n").over(every).alias("n_all"), F.sum(F.col("v") * F.col("n")).over(every).alias("s_all"))
    c = c.where("n0 < n_all").withColumn("n1", F.col("n_all") - F.col("n0"))
    gap = F.col("s0") / F.col("n0") - (F.col("s_all") - F.col("s0")) / F.col("n1")
    between = F.col("n0").cast("double") * F.col("n1").cast("double") * gap * gap
    best = c.withColumn("b", between).groupBy().agg(F.max_by(F.struct("v", "n0", "s0"), F.struct("b", -F.col("v"))).alias("m"))
    return best.select((F.col("m.v") + 0.5).alias("threshold"), (F.col("m.s0") / F.col("m.n0")).alias("air_level"))


def air_level(hist: DataFrame, threshold: float) -> DataFrame:
    return hist.where(F.col("v") < threshold).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("air_level"))


def smoothed_bins(hist: DataFrame, bins: int = 256, radius: int = 5, sigma: float = 1.5) -> DataFrame:
    """(bin, s): up to so many equal bins between the cut values, smoothed by a Gaussian that is normalised at
    the ends. A thousandth of the counts is cut from either end."""
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    c = hist.select("v", "n", F.sum("n").over(w).alias("c"), F.sum("n").over(every).alias("total"))
    cut = F.floor(F.col("total") / 1000)
    ends = c.groupBy().agg(F.min(F.when(F.col("c") > cut, F.col("v"))).alias("lo"), F.min(F.when(F.col("c") >= F.col("total") - cut, F.col("v"))).alias("hi"))
    width = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo") + bins) / bins))
    cells = hist.join(F.broadcast(ends)).where("v >= lo and v <= hi").groupBy(F.floor((F.col("v") - F.col("lo")) / width).cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    count = ends.select(F.explode(F.sequence(F.lit(0), (F.floor((F.col("hi") - F.col("lo")) / width)).cast("int"))).alias("bin"))
    full = count.join(cells, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    weights = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-0.5 * (k / sigma) ** 2)).alias("g")) for k in range(-radius, radius + 1)])
    near = full.select((F.col("bin")).alias("from_bin"), "n", F.explode(weights).alias("w")).select((F.col("from_bin") + F.col("w.k")).alias("bin"), "n", "w.g")
    return full.select("bin").join(near, "bin").groupBy("bin").agg((F.sum(F.col("n") * F.col("g")) / F.sum("g")).alias("s"))


def peaks(bins: DataFrame, least: float = 0.005, dip: float = 0.8) -> DataFrame:
    """(bin, s) of local maxima of at least a share of the highest, whose higher side valley is low enough: the base
    between a peak and the next higher one, or the end, on either side."""
    top = bins.agg(F.max("s").alias("top"))
    w = Window.orderBy("bin")
    c = bins.select("bin", "s", F.lag("s").over(w).alias("before"), F.lead("s").over(w).alias("after"))
    found = c.where("s > coalesce(before, -1) and s >= coalesce(after, -1)").join(F.broadcast(top)).where(F.col("s") >= least * F.col("top")).select("bin", "s")
    # Up to 256 bins meet up to 128 peaks here, whatever the volume.
    p, b = found.alias("p"), bins.alias("b")
    left = p.join(b, F.col("b.bin") < F.col("p.bin")).groupBy("p.bin", "p.s").agg(F.max(F.when(F.col("b.s") > F.col("p.s"), F.col("b.bin"))).alias("wall"))
    right = p.join(b, F.col("b.bin") > F.col("p.bin")).groupBy("p.bin", "p.s").agg(F.min(F.when(F.col("b.s") > F.col("p.s"), F.col("b.bin"))).alias("wall"))
    lo = left.alias("l").join(b, (F.col("b.bin") < F.col("l.bin")) & (F.col("b.bin") > F.coalesce("l.wall", F.lit(-1)))).groupBy("l.bin").agg(F.min("b.s").alias("lo"))
    hi = right.alias("r").join(b, (F.col("b.bin") > F.col("r.bin")) & (F.col("b.bin") < F.coalesce("r.wall", F.lit(1 << 30)))).groupBy("r.bin").agg(F.min("b.s").alias("hi"))
    both = found.join(lo, "bin", "left").join(hi, "bin", "left")
    return both.where(F.greatest(F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(0.0))) <= dip * F.col("s")).select("bin", "s")


def multi_otsu_3(hist: DataFrame, bins: int) -> DataFrame:
    """One row (t1, t2): the two cuts of at most `bins` equal bins that maximise the sum of S^2 / W over three
    classes; the first of equals. Pairs of bins are bounded by the parameter."""
    ends = hist.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo") + bins) / bins))
    cell = F.floor((F.col("v") - F.col("lo")) / width).cast("int")
    c = hist.join(F.broadcast(ends)).groupBy(cell.alias("bin"), "lo", width.alias("width")).agg(F.sum("n").alias("n")).withColumn("m", F.col("n") * F.col("bin"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    c = c.select("bin", "lo", "width", F.sum("n").over(w).alias("n0"), F.sum("m").over(w).alias("s0"), F.sum("n").over(every).alias("n_all"), F.sum("m").over(every).alias("s_all"))
    a, b = c.alias("a"), c.alias("b")
    pair = a.join(b, F.col("a.bin") < F.col("b.bin")).where("b.n0 < b.n_all")
    score = F.col("a.s0") ** 2 / F.col("a.n0") + (F.col("b.s0") - F.col("a.s0")) ** 2 / (F.col("b.n0") - F.col("a.n0")) + (F.col("b.s_all") - F.col("b.s0")) ** 2 / (F.col("b.n_all") - F.col("b.n0"))
    pick = pair.select(F.round(score, 4).alias("score"), F.col("a.bin").alias("p"), F.col("b.bin").alias("q"), F.col("a.lo").alias("lo"), F.col("a.width").alias("width"))
    best = pick.agg(F.max_by(F.struct("p", "q", "lo", "width"), F.struct("score", -F.col("p"), -F.col("q"))).alias("m"))
    cut = lambda c: (F.col("m.lo") + (F.col(f"m.{c}") + 1) * F.col("m.width")).cast("long")
    return best.select(cut("p").alias("t1"), cut("q").alias("t2"))


def weighted_percentiles(values: DataFrame, value: str, weight: str, shares: list[float]) -> DataFrame:
    """(share, value): the first value in rising order whose cumulative weight reaches the share of the total.
    Values are summed by value first and dealt by range; a part's own sums are added to those of the parts before it, of
    which there is a row each, so that no task sorts the whole table."""
    from brickwise.operators.graph import stage

    by = values.groupBy(F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    dealt = stage(by.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "percentiles")
    sums = dealt.groupBy("part").agg(F.sum("w").alias("s"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    before = sums.select("part", (F.sum("s").over(every) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    w = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    c = dealt.join(F.broadcast(before), "part").select("v", (F.sum("w").over(w) + F.col("before")).alias("c"), "total")
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    each = c.select("v", "c", "total", F.explode(wanted).alias("share")).where(F.col("c") >= F.col("share") * F.col("total"))
    return each.groupBy("share").agg(F.min("v").alias("value"))


def upper_median(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The upper middle element, sorted[n / 2], of each group: equal values are counted first and dealt by ranges of group and value, which tasks
    share. The counts of a group's parts, a row each, tell in which of them its middle lies; only that part's values are summed up in order."""
    from brickwise.operators.graph import stage

    counted = values.groupBy(*by, F.col(value).alias("median")).agg(F.count("*").alias("m"))
    dealt = stage(counted.repartitionByRange(*by, "median").withColumn("part", F.spark_partition_id()), "medians")
    sums = dealt.groupBy("part", *by).agg(F.sum("m").alias("s"))
    every = Window.partitionBy(*by)
    before = sums.select("part", *by, "s", (F.sum("s").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"), F.floor(F.sum("s").over(every) / 2).alias("at"))
    home = before.where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("s"))).select(*[F.col(c).alias(f"home_{c}") for c in ("part", *by)], "before", "at")
    same = F.col("part") == F.col("home_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"home_{c}"))
    inside = Window.partitionBy("part", *by).orderBy("median").rowsBetween(Window.unboundedPreceding, 0)
    c = dealt.join(home.hint("merge"), same).select(*by, "median", "m", "at", (F.sum("m").over(inside) + F.col("before")).alias("up"))
    return c.where((F.col("up") > F.col("at")) & (F.col("up") - F.col("m") <= F.col("at"))).select(*by, "median")
