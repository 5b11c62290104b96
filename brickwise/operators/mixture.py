"""Gaussian mixtures of grey histograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def fit_mixture(values: np.ndarray, counts: np.ndarray, classes: int, rounds: int = 300, least_weight: float = 0.01, least_sigma: float = 0.5) -> dict:
    """Expectation maximisation on histogram bins from quantile starts; effective counts are capped at 10^4."""
    n = counts * min(1.0, 1e4 / counts.sum())
    cum = np.cumsum(n) / n.sum()
    mean = np.array([values[np.searchsorted(cum, (k + 0.5) / classes)] for k in range(classes)], dtype=float)
    sigma = np.full(classes, max(least_sigma, float(np.sqrt(np.average((values - np.average(values, weights=n)) ** 2, weights=n))) / classes))
    weight = np.full(classes, 1 / classes)
    last = -np.inf
    for _ in range(rounds):
        p = weight * np.exp(-0.5 * ((values[:, None] - mean) / sigma) ** 2) / sigma
        total = np.maximum(p.sum(1), 1e-300)
        score = float((n * np.log(total)).sum())
        r = p / total[:, None] * n[:, None]
        mass = np.maximum(r.sum(0), 1e-9)
        weight = np.maximum(mass / n.sum(), least_weight)
        weight /= weight.sum()
        mean = (r * values[:, None]).sum(0) / mass
        sigma = np.maximum(np.sqrt((r * (values[:, None] - mean) ** 2).sum(0) / mass), least_sigma)
        if abs(score - last) < 1e-9 * max(1.0, abs(score)):
            break
        last = score
    post = p / total[:, None]
    order = np.argsort(mean)
    bic = (3 * classes - 1) * np.log(n.sum()) - 2 * score
    return {"mean": mean[order], "sigma": sigma[order], "weight": weight[order], "bic": bic, "ambiguous": float((counts * (post.max(1) < 0.9)).sum() / counts.sum())}


def suggest_mixture(hist: DataFrame, most: int = 5) -> DataFrame:
    """(class, mean, sigma, weight, ambiguous) of the mixture with the least BIC. The histogram has at most a row for each
    grey value, so it is fitted on the driver."""
    rows = sorted((r["v"], r["n"]) for r in hist.collect())
    v, n = (np.array(x, dtype=float) for x in zip(*rows, strict=True))
    best = min((fit_mixture(v, n, k) for k in range(1, min(most, len(v)) + 1)), key=lambda m: m["bic"])
    out = [(k, float(best["mean"][k]), float(best["sigma"][k]), float(best["weight"][k]), best["ambiguous"]) for k in range(len(best["mean"]))]
    return hist.sparkSession.createDataFrame(out, "class int, mean double, sigma double, weight double, ambiguous double")
