"""Decisions from grey histograms: air threshold, cuts between materials, and the material's level. A histogram has 65536
rows at most, so it is read on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.functions.keys import morton
from brickwise.operators.graph import stage
from brickwise.operators.ranking import ranks


def counts_of(hist: DataFrame) -> np.ndarray:
    """The counts by grey value 0..65535 of a histogram (v, n)."""
    out = np.zeros(65536, dtype=np.int64)
    for r in hist.where("v >= 0 and v <= 65535").collect():
        out[r["v"]] = r["n"]
    return out


def otsu_of(n: np.ndarray) -> float:
    """The value with the largest variance between what is up to it and the rest, plus a half; the first of equals."""
    v = np.arange(len(n), dtype=float)
    n0, s0 = np.cumsum(n).astype(float), np.cumsum(n * v)
    n1, s1 = n0[-1] - n0, s0[-1] - s0
    ok = (n0 > 0) & (n1 > 0)
    if not ok.any():
        raise ValueError("a histogram of one value has no threshold")
    gap = s0[ok] / n0[ok] - s1[ok] / n1[ok]
    return float(np.flatnonzero(ok)[np.argmax(n0[ok] * n1[ok] * gap * gap)]) + 0.5


def smoothed(n: np.ndarray, radius: int = 5, sigma: float = 1.5) -> np.ndarray:
    """A Gaussian over bins, normalised where it is cut off at the ends."""
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(n.astype(float), w)[radius:-radius] / np.convolve(np.ones(len(n)), w)[radius:-radius]


def air_threshold(n: np.ndarray, most_bins: int = 256, depth: float = 0.05) -> float:
    """Where air ends: the lowest valley between two peaks below Otsu's threshold that is deep enough below both; else Otsu's
    threshold. The end values, which hold what was clipped, and a thousandth at both ends don't count. Peaks without such a
    valley between them are one, which stands where the highest of them does."""
    otsu = otsu_of(n)
    inner = n.copy()
    inner[[0, -1]] = 0
    up = np.cumsum(inner)
    spare = up[-1] // 1000
    if not up[-1]:
        return otsu
    lo, hi = int(np.searchsorted(up, spare, "right")), int(np.searchsorted(up, up[-1] - spare))
    width = max(1, (hi - lo + most_bins) // most_bins)
    s = smoothed(np.bincount(np.arange(hi - lo + 1) // width, inner[lo : hi + 1]))
    if len(s) < 8:
        return otsu
    centre = lo + np.arange(len(s)) * width + (width - 1) / 2
    risen, falls = s[1:-1] >= s[:-2], s[1:-1] > s[2:]
    peaks = 1 + np.flatnonzero(risen & falls & (centre[1:-1] < otsu))
    for k in range(1, len(peaks)):
        air = peaks[np.argmax(s[peaks[:k]])]
        valley = air + np.argmin(s[air : peaks[k] + 1])
        if min(s[air], s[peaks[k]]) - s[valley] >= depth * s.max():
            return float(centre[valley])
    return otsu


def multi_otsu(n: np.ndarray, classes: int, bins: int = 256) -> list[float]:
    """The classes - 1 cuts that maximise the variance between classes, of whole bins: bins of one width, a fraction where
    the range asks for it but one value at least. The table of all stretches of bins is scored once; a class more is one product of maximum and plus with it."""
    if not 1 <= classes <= 8:
        raise ValueError("one to eight classes")
    values = np.flatnonzero(n)
    if not len(values):
        raise ValueError("an empty histogram has no classes")
    first, width = int(values[0]), max(1.0, (int(values[-1]) + 1 - int(values[0])) / bins)
    at = np.minimum(((values - first) / width).astype(int), bins - 1)
    weight, total = (np.r_[0.0, np.cumsum(np.bincount(at, w, bins))] for w in (n[values], n[values] * values.astype(float)))
    w, t = weight - weight[:, None], total - total[:, None]
    stretch = np.divide(t * t, w, out=np.zeros_like(t), where=w > 0)
    stretch[np.tril_indices(bins + 1)] = -np.inf
    best, cuts = np.full(bins + 1, -np.inf), []
    best[0] = 0.0
    for _ in range(classes):
        through = best[:, None] + stretch
        cuts.append(through.argmax(0))
        best = through.max(0)
    end, out = bins, []
    for cut in cuts[:0:-1]:
        end = int(cut[end])
        out.append(first + end * width)
    return out[::-1]


def clear_peaks(n: np.ndarray, threshold: float, most_bins: int = 128, least: float = 0.005, dip: float = 0.8) -> tuple[list[float], list[float]]:
    """(peaks, valleys between them) of the values above a threshold, without the top 0.01 %: a peak stands out if the
    higher of its two valleys is low enough."""
    n = n.copy()
    n[: math.floor(threshold) + 1] = 0
    up = np.cumsum(n)
    if not up[-1]:
        return [], []
    n[np.searchsorted(up, up[-1] - up[-1] // 10_000) + 1 :] = 0
    there = np.flatnonzero(n)
    first, last = int(there[0]), int(there[-1])
    width = max(1, (last - first + most_bins) // most_bins)
    bins = (last - first) // width + 1
    cells = np.zeros(bins * width, dtype=np.int64)
    some = n[first : first + len(cells)]
    cells[: len(some)] = some
    s = smoothed(cells.reshape(bins, width).sum(1))
    found = []
    for b in range(bins):
        if not ((b == 0 or s[b] > s[b - 1]) and (b == bins - 1 or s[b] >= s[b + 1]) and s[b] >= least * s.max()):
            continue
        left = next((i for i in range(b - 1, -1, -1) if s[i] > s[b]), -1)
        right = next((i for i in range(b + 1, bins) if s[i] > s[b]), bins)
        sides = [s[left + 1 : b].min() if b > left + 1 else 0.0, s[b + 1 : right].min() if right > b + 1 else 0.0]
        if max(sides) <= dip * s[b]:
            found.append(b)
    centre = lambda b: float(first + (b + 0.5) * width)
    valleys = [centre(a + int(np.argmin(s[a : b + 1]))) for a, b in zip(found, found[1:], strict=False)]
    return [centre(b) for b in found], valleys


def material_cuts(n: np.ndarray, threshold: float, classes: int) -> list[float]:
    """The cuts between so many materials above a threshold: the valleys if there is a clear peak for each, else those of
    multi_otsu."""
    if classes == 1:
        return []
    peaks, valleys = clear_peaks(n, threshold)
    if len(peaks) == classes:
        return valleys
    above = n.copy()
    above[: math.floor(threshold) + 1] = 0
    return multi_otsu(above, classes)


def material_level(voxels: DataFrame, threshold: float, bricks: int = 16, side: int = 64) -> float:
    """The upper median of the values above a threshold in every step-th brick along the Morton order, the step being the
    number of bricks by `bricks`, or 1; the threshold itself if none of them has such a value. That choice of bricks is the
    estimate, which looks for spread and not for all; a histogram comes to the driver. Bricks are ranked by counts of ranges of the order."""
    keyed = voxels.select("grey", *[F.floor(F.col(c) / side).cast("int").alias(f"b{c}") for c in "xyz"]).withColumn("brick", morton("bx", "by", "bz")).drop("bx", "by", "bz")
    ranked = stage(ranks(keyed.select("brick").distinct(), [F.col("brick").asc()], "rank"), "brick-ranks")
    step = max(1, ranked.count() // bricks)
    some = ranked.where((F.col("rank") - 1) % step == 0).select("brick")
    hist = keyed.where(F.col("grey") > threshold).join(some, "brick", "left_semi").groupBy("grey").agg(F.count("*").alias("n")).orderBy("grey").collect()
    if not hist:
        return float(threshold)
    up = np.cumsum([r["n"] for r in hist])
    return float(hist[int(np.searchsorted(up, up[-1] // 2, "right"))]["grey"])
