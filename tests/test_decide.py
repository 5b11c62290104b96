from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.operators import decide, histogram


def gaussians(*parts, seed=0):
    rng = np.random.default_rng(seed)
    return sum(np.bincount(np.clip(rng.normal(m, s, n).astype(int), 0, 65535), minlength=65536) for m, s, n in parts)


def test_air_threshold_lies_in_the_first_clear_valley():
    n = gaussians((3000, 400, 200_000), (9000, 500, 30_000), (20_000, 600, 90_000))
    assert 4500 < decide.air_threshold(n) < 7500
    flat = np.zeros(65536, dtype=np.int64)
    flat[[1000, 20000]] = 500
    assert decide.air_threshold(flat) == decide.otsu_of(flat) == 1000.5


def plain_air_threshold(n):
    """The rule, a value and a bin at a time."""
    otsu = decide.otsu_of(n)
    n = [0, *map(int, n[1:-1]), 0]
    total = sum(n)
    if total == 0:
        return otsu
    lo = seen = 0
    while seen + n[lo] <= total // 1000:
        seen, lo = seen + n[lo], lo + 1
    hi, seen = len(n) - 1, 0
    while seen + n[hi] <= total // 1000:
        seen, hi = seen + n[hi], hi - 1
    width = max(1, -(-(hi - lo + 1) // 256))
    sums = {}
    for v in range(lo, hi + 1):
        sums[(v - lo) // width] = sums.get((v - lo) // width, 0) + n[v]
    if len(sums) < 8:
        return otsu
    smooth = []
    for i in range(len(sums)):
        near = [(np.exp(-0.5 * (j - i) ** 2 / 2.25), sums[j]) for j in range(max(0, i - 5), min(len(sums), i + 6))]
        smooth.append(sum(w * c for w, c in near) / sum(w for w, _ in near))
    centre = [(2 * lo + 2 * i * width + width - 1) / 2 for i in range(len(sums))]
    low = [i for i in range(1, len(sums) - 1) if smooth[i - 1] <= smooth[i] > smooth[i + 1] and centre[i] < otsu]
    while len(low) > 1:
        a, b = low[:2]
        valley = min(range(a, b + 1), key=lambda i: (smooth[i], i))
        if min(smooth[a], smooth[b]) - smooth[valley] >= 0.05 * max(smooth):
            return centre[valley]
        low[:2] = [b if smooth[b] > smooth[a] else a]
    return otsu


@pytest.mark.parametrize("seed", range(12))
def test_air_threshold_is_the_plain_rule(seed):
    rng = np.random.default_rng(seed)
    n = gaussians(*[(rng.integers(500, 40_000), rng.integers(100, 1500), rng.integers(1000, 90_000)) for _ in range(seed % 4 + 2)], seed=seed)
    if seed % 3 == 0:
        n[[0, 65535]] += 50_000
    if seed % 4 == 1:
        n = np.bincount(rng.integers(10, 200, 5000), minlength=65536)
    assert decide.air_threshold(n) == pytest.approx(plain_air_threshold(n), abs=1e-9)


def test_two_peaks_fall_back_to_otsu():
    """The material's peak lies above Otsu's threshold, so it is no side of a valley."""
    n = gaussians((1000, 300, 100_000), (20_000, 900, 60_000))
    assert decide.air_threshold(n) == decide.otsu_of(n)


def test_otsu_is_that_of_spark(spark):
    n = gaussians((3000, 900, 2000), (9000, 1500, 3000))
    hist = spark.createDataFrame([(int(v), int(n[v])) for v in np.flatnonzero(n)], "v long, n long")
    assert decide.otsu_of(decide.counts_of(hist)) == histogram.otsu(hist).first()["threshold"]


@pytest.mark.parametrize("classes", [2, 3, 4])
@pytest.mark.parametrize("last", [130, 300, 700, 65_535])
def test_multi_otsu_by_brute_force(classes, last):
    """Bins are fractions of the range; the cuts are borders of bins. A small number of bins makes all cuts few enough to try."""
    rng = np.random.default_rng(classes)
    n = np.zeros(65536, dtype=np.int64)
    v = np.unique(np.r_[100, last, rng.integers(100, last + 1, 400)])
    n[v] = rng.integers(1, 50, len(v))
    bins = 24
    width = max(1.0, (last + 1 - 100) / bins)
    at = np.minimum(((v - 100) / width).astype(int), bins - 1)

    def score(cuts):
        edges = [0, *cuts, bins]
        parts = [(at >= a) & (at < b) for a, b in zip(edges, edges[1:], strict=False)]
        return sum(float((n[v[p]] * v[p]).sum()) ** 2 / n[v[p]].sum() for p in parts if p.any())

    best = max(map(score, combinations(range(1, bins), classes - 1)))
    got = [round((c - 100) / width) for c in decide.multi_otsu(n, classes, bins)]
    assert np.isclose(score(got), best, rtol=1e-12) and got == sorted(got)


def test_cuts_of_fractional_bins():
    n = np.zeros(65536, dtype=np.int64)
    n[100:450] = 1
    first, second = decide.multi_otsu(n, 3)
    width = 350 / 256
    assert (first - 100) / width == pytest.approx(round((first - 100) / width)) and abs(first - 216.7) < 2 * width and abs(second - 333.3) < 2 * width
    assert decide.multi_otsu(n, 1) == []
    with pytest.raises(ValueError):
        decide.multi_otsu(np.zeros(10, dtype=np.int64), 2)


def test_cuts_are_valleys_where_peaks_are_clear():
    n = gaussians((1000, 200, 100_000), (8000, 500, 50_000), (20_000, 600, 70_000))
    (cut,) = decide.material_cuts(n, 4000, 2)
    assert 9000 < cut < 18_000
    assert len(decide.material_cuts(n, 4000, 4)) == 3 and decide.material_cuts(n, 4000, 1) == []


def test_material_level(spark):
    v = spark.range(64 * 64 * 64).select((F.col("id") % 64).cast("int").alias("x"), (F.col("id") / 64 % 64).cast("int").alias("y"), (F.col("id") / 4096).cast("int").alias("z"))
    grey = F.when(F.col("x") < 10, 500).otherwise(10_000 + F.col("y")).cast("int")
    assert abs(decide.material_level(v.withColumn("grey", grey), 5000) - 10_031.5) <= 1
    assert decide.material_level(v.withColumn("grey", F.lit(1)), 5000) == 5000


@pytest.mark.parametrize("n", [1, 5, 17, 40])
def test_material_level_takes_every_step_th_brick(spark, n):
    """A brick of one voxel at every place along x, where Morton order is that of x."""
    voxels = spark.range(n).select((F.col("id") * 64).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), (F.col("id") + 1).cast("int").alias("grey"))
    taken = sorted(range(1, n + 1, max(1, n // 16)))
    assert decide.material_level(voxels, 0.0) == taken[len(taken) // 2]
