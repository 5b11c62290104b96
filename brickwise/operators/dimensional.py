"""Dimensional measurement: fitted elements, their distances, and datums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("plane", "sphere", "cylinder", "point")


def _fit(kind: str, p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(centre, direction, radius, residuals) of one least-squares fit of places that count w times each."""
    c = np.average(p, axis=0, weights=w)
    if kind == "point":
        return c, np.zeros(3), 0.0, np.linalg.norm(p - c, axis=1)
    often = np.sqrt(w)
    _, _, axes = np.linalg.svd(often[:, None] * (p - c), full_matrices=False)
    if kind == "plane":
        n = axes[2] * (1 if axes[2][np.abs(axes[2]).argmax()] > 0 else -1)
        return c, n, 0.0, (p - c) @ n
    if kind == "sphere":
        a = np.c_[2 * p, np.ones(len(p))]
        s = np.linalg.lstsq(often[:, None] * a, often * (p**2).sum(1), rcond=None)[0]
        r = float(np.sqrt(max(s[3] + s[:3] @ s[:3], 0)))
        return s[:3], np.zeros(3), r, np.linalg.norm(p - s[:3], axis=1) - r
    best = None
    for start in axes:
        d = start
        for _ in range(30):  # alternate the circle across the axis with a small turn of the axis
            u = np.cross(d, [1, 0, 0] if abs(d[0]) < 0.9 else [0, 1, 0])
            u /= np.linalg.norm(u)
            v = np.cross(d, u)
            q = np.c_[(p - c) @ u, (p - c) @ v]
            s = np.linalg.lstsq(often[:, None] * np.c_[2 * q, np.ones(len(q))], often * (q**2).sum(1), rcond=None)[0]
            r = float(np.sqrt(max(s[2] + s[0] ** 2 + s[1] ** 2, 1e-18)))
            away = q - s[:2]
            length = np.maximum(np.linalg.norm(away, axis=1), 1e-12)
            e = length - r
            t = (p - c) @ d
            j = np.c_[-away[:, 0] / length * t, -away[:, 1] / length * t, -away / length[:, None], -np.ones(len(q))]
            step = np.linalg.lstsq(often[:, None] * j, -often * e, rcond=None)[0]
            d = d + step[0] * u + step[1] * v
            d /= np.linalg.norm(d)
            if np.abs(step[:2]).max() < 1e-12:
                break
        found = (float((w * e**2).sum()), c + s[0] * u + s[1] * v, d, r, e)
        best = found if best is None or found[0] < best[0] else best
    d = best[2] * (1 if best[2][np.abs(best[2]).argmax()] > 0 else -1)
    return best[1], d, best[3], best[4]


def fit_element(kind: str, points: np.ndarray, counts: np.ndarray | None = None) -> dict:
    """A fit of points, each counted once or as often as is said; points beyond three times the RMS dropped, at most twice."""
    if kind not in KINDS:
        raise ValueError(f"unknown element {kind!r}")
    w = np.ones(len(points)) if counts is None else np.asarray(counts, dtype=float)
    for _ in range(3):
        centre, direction, radius, e = _fit(kind, points, w)
        rms = float(np.sqrt(np.average(e**2, weights=w)))
        keep = np.abs(e) <= 3 * rms
        if keep.all() or w[keep].sum() < 6:
            break
        points, w = points[keep], w[keep]
    return {"cx": centre[0], "cy": centre[1], "cz": centre[2], "dx": direction[0], "dy": direction[1], "dz": direction[2], "radius": radius, "rms": rms, "form": float(e.max() - e.min()), "n": int(w.sum())}


def fit_elements(points: DataFrame) -> DataFrame:
    """One row for each element of points(element, kind, x, y, z): a group is one element's different places with how often each occurs, a
    kernel each. Equal points are counted before the shuffle, so a kernel's memory goes with the places, 32 bytes each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit_element(pdf["kind"].iloc[0], pdf[["x", "y", "z"]].to_numpy(float), pdf["often"].to_numpy())
        return pd.DataFrame([{"element": pdf["element"].iloc[0], "kind": pdf["kind"].iloc[0], **out}])

    schema = "element string, kind string, cx double, cy double, cz double, dx double, dy double, dz double, radius double, rms double, form double, n long"
    return points.groupBy("element", "kind", "x", "y", "z").agg(F.count("*").alias("often")).groupBy("element", "kind").applyInPandas(run, schema)


def element_distances(pairs: DataFrame) -> DataFrame:
    """pairs with distance (along the first element's direction if it is a plane, across it if a cylinder, else straight)
    and angle, folded to 90 degrees. Columns are those of two elements with prefixes a_ and b_."""
    d = [F.col(f"b_c{c}") - F.col(f"a_c{c}") for c in "xyz"]
    n = [F.col(f"a_d{c}") for c in "xyz"]
    along = d[0] * n[0] + d[1] * n[1] + d[2] * n[2]
    straight = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    dot = sum((n[k] * F.col(f"b_d{c}") for k, c in list(enumerate("xyz"))[1:]), n[0] * F.col("b_dx"))
    across = F.sqrt(F.greatest(straight * straight - along * along, F.lit(0.0)))
    distance = F.when(F.col("a_kind") == "plane", along).when(F.col("a_kind") == "cylinder", across).otherwise(straight)
    return pairs.withColumns({"distance": distance, "angle": F.degrees(F.acos(F.least(F.abs(dot), F.lit(1.0))))})


def datum_frame(primary: np.ndarray, secondary: np.ndarray, tertiary: np.ndarray) -> np.ndarray:
    """The 4x4 matrix into the frame of three datum planes, each (point, normal): the first gives z, the second, made square
    to it, x, and the origin is where the three meet."""
    z = primary[1] / np.linalg.norm(primary[1])
    x = secondary[1] - (secondary[1] @ z) * z
    if np.linalg.norm(x) < 1e-9:
        raise ValueError("the second datum is parallel to the first")
    x /= np.linalg.norm(x)
    y = np.cross(z, x)
    normals = np.stack([p[1] / np.linalg.norm(p[1]) for p in (primary, secondary, tertiary)])
    if abs(np.linalg.det(normals)) < 1e-9:
        raise ValueError("the datums don't meet in one point")
    origin = np.linalg.solve(normals, [n @ p[0] for n, p in zip(normals, (primary, secondary, tertiary), strict=True)])
    out = np.eye(4)
    out[:3, :3] = np.stack([x, y, z])
    out[:3, 3] = -out[:3, :3] @ origin
    return out


def reference_points(nominal: np.ndarray, actual: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The 4x4 matrix of the small motion that brings each actual point onto its nominal one along its direction: six or
    more linear equations in three turns and three shifts, repeated until the motion vanishes."""
    if len(nominal) < 6:
        raise ValueError("six reference points at least determine a motion")
    m = np.eye(4)
    for _ in range(20):
        p = actual @ m[:3, :3].T + m[:3, 3]
        a = np.concatenate([np.cross(p, directions), directions], axis=1)
        if np.linalg.matrix_rank(a) < 6:
            raise ValueError("the reference points leave a motion free")
        step = np.linalg.lstsq(a, ((nominal - p) * directions).sum(1), rcond=None)[0]
        angle = np.linalg.norm(step[:3])
        k = step[:3] / angle if angle > 1e-15 else np.zeros(3)
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        turn = np.eye(4)
        turn[:3, :3] = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
        turn[:3, 3] = step[3:]
        m = turn @ m
        if np.abs(step).max() < 1e-12:
            break
    return m
