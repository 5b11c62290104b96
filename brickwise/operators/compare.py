"""Nominal-actual comparison: signed distances to a mesh, alignment of points to it, deviations and their statistics."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Triangles of a nominal mesh that may be broadcast; it is a design file, and larger ones are refused.
MOST_TRIANGLES = 2_000_000


#: Points whose coarse alignments are ranked, and point and triangle pairs that are computed together.
RANKED, PAIRS = 2000, 1 << 19


class Mesh:
    """Triangles with their centres and radii. Points are answered by grid cell: a triangle can be the nearest of a cell's
    points only if it could be nearer to the cell's centre than the nearest centre of all, by the sizes of both."""

    def __init__(self, triangles: np.ndarray):
        if not 0 < len(triangles) <= MOST_TRIANGLES:
            raise ValueError(f"a nominal mesh needs 1 to {MOST_TRIANGLES} triangles, not {len(triangles)}")
        self.t = triangles
        n = np.cross(triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0])
        self.area = np.linalg.norm(n, axis=1) / 2
        self.normal = n / np.maximum(2 * self.area, 1e-300)[:, None]
        self.centre = triangles.mean(1)
        self.radius = np.linalg.norm(triangles - self.centre[:, None], axis=2).max(1)
        extent = float((triangles.max((0, 1)) - triangles.min((0, 1))).max())
        self.cell = max(extent / 32, 1e-9)

    def closest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signed distances, nearest places, normals there) of points (n, 3): negative behind the triangle's front. Of
        equally near triangles the one that the point is most in front of or behind tells the side."""
        d, q, n = np.zeros(len(points)), np.zeros((len(points), 3)), np.zeros((len(points), 3))
        cell = np.floor(points / self.cell).astype(np.int64)
        by = np.lexsort(cell.T)
        edges = np.flatnonzero(np.r_[True, (cell[by][1:] != cell[by][:-1]).any(1)]) if len(by) else []
        for lo, hi in zip(edges, [*edges[1:], len(by)], strict=True):
            rows = by[lo:hi]
            middle = (cell[rows[0]] + 0.5) * self.cell
            half = float(np.linalg.norm(points[rows] - middle, axis=1).max())
            away = np.linalg.norm(self.centre - middle, axis=1)
            some = np.flatnonzero(away - self.radius <= (away + self.radius).min() + 2 * half + 1e-9)
            step = max(1, PAIRS // len(some))
            for at in range(0, len(rows), step):
                k = rows[at : at + step]
                near = closest_on_triangles(points[k], self.t[some])
                gap = points[k][:, None] - near
                away2 = np.linalg.norm(gap, axis=2)
                best = away2.min(1)
                side = (gap * self.normal[some][None]).sum(2)
                pick = np.where(away2 <= best[:, None] + 1e-9, np.abs(side), -1.0).argmax(1)
                each = np.arange(len(k))
                q[k], n[k] = near[each, pick], self.normal[some[pick]]
                d[k] = np.where(side[each, pick] >= 0, best, -best)
        return d, q, n


def closest_on_triangles(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The nearest place (n, m, 3) on each of m triangles to each of n points: inside its face, or on the nearest of its
    edges."""
    p = p[:, None]
    a, b, c = (t[None, :, k] for k in range(3))
    n = np.cross(b - a, c - a)
    size = np.maximum((n * n).sum(-1), 1e-300)
    foot = p - (((p - a) * n).sum(-1) / size)[..., None] * n
    within = np.ones(foot.shape[:2], dtype=bool)
    best, out = np.full(foot.shape[:2], np.inf), np.broadcast_to(a, foot.shape)
    for u, v in ((a, b), (b, c), (c, a)):
        e = v - u
        within &= (np.cross(e, foot - u) * n).sum(-1) >= 0
        s = np.clip(((p - u) * e).sum(-1) / np.maximum((e * e).sum(-1), 1e-300), 0, 1)
        q = u + s[..., None] * e
        d = ((q - p) ** 2).sum(-1)
        out, best = np.where((d < best)[..., None], q, out), np.minimum(d, best)
    return np.where(within[..., None], foot, out)


def nominal_mesh(triangles: DataFrame) -> Mesh:
    """The mesh on the driver, its size checked before it is collected."""
    n = triangles.count()
    if n > MOST_TRIANGLES:
        raise ValueError(f"a nominal mesh of {n} triangles is over {MOST_TRIANGLES}")
    names = [f"{c}{k}" for k in (1, 2, 3) for c in "xyz"]
    return Mesh(np.array([tuple(r) for r in triangles.select(*names).collect()]).reshape(-1, 3, 3))


def mesh_distance(points: DataFrame, mesh: Mesh) -> DataFrame:
    """points (x, y, z, ...) with distance and the nearest point's normal; the mesh is broadcast, its size is checked."""
    sent = points.sparkSession.sparkContext.broadcast(mesh)
    schema = T.StructType([*points.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("distance", "nx", "ny", "nz")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.stack([b.column(c).to_numpy() for c in "xyz"], 1).astype(float)
            d, _, n = sent.value.closest(p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d), *[pa.array(np.ascontiguousarray(n[:, k])) for k in range(3)]], names=[*b.schema.names, "distance", "nx", "ny", "nz"])

    return points.mapInArrow(run, schema)


def moved(points: DataFrame, m: np.ndarray) -> DataFrame:
    from brickwise.operators.surface import transform

    return transform(points, m.ravel().tolist())


def align(points: DataFrame, mesh: Mesh, start: np.ndarray | None = None, rounds: int = 30, floor: float = 1e-3) -> np.ndarray:
    """The 4x4 matrix of point-to-plane rounds; a round sends the matrix out and gets 27 sums back. It ends when the motion
    is a thousandth of the floor."""
    from brickwise.operators.surface import icp_sums

    m = np.eye(4) if start is None else start.copy()
    for _ in range(rounds):
        found = mesh_distance(moved(points.select("x", "y", "z"), m), mesh).withColumnRenamed("distance", "r")
        s = icp_sums(found, floor).first().asDict()
        a = np.array([[s[f"a{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)], dtype=float)
        step = np.linalg.solve(a + 1e-9 * np.trace(a) * np.eye(6), -np.array([s[f"b{k}"] for k in range(6)], dtype=float))
        angle = np.linalg.norm(step[:3])
        k = step[:3] / angle if angle > 1e-15 else np.zeros(3)
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        turn = np.eye(4)
        turn[:3, :3] = np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross
        turn[:3, 3] = step[3:]
        m = turn @ m
        if max(angle, np.abs(step[3:]).max()) < floor / 1000:
            break
    return m


def coarse_alignments(points: DataFrame, mesh: Mesh) -> list[np.ndarray]:
    """Matrices that lay the points' principal axes on the mesh's in the 24 proper ways; sums of the points, not the points,
    come to the driver."""
    s = points.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "xyz"], *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a in "xyz" for b in "xyz"]).first().asDict()
    c = np.array([s[k] for k in "xyz"]) / s["n"]
    cov = np.array([[s[a + b] for b in "xyz"] for a in "xyz"]) / s["n"] - np.outer(c, c)
    centre = np.average(mesh.t.mean(1), axis=0, weights=mesh.area)
    spread = np.cov(mesh.t.mean(1).T, aweights=mesh.area)
    p, q = (np.linalg.eigh(x)[1] for x in (cov, spread))
    out = []
    for order in permutations(range(3)):
        for signs in product((1, -1), repeat=3):
            r = (q[:, order] * signs) @ p.T
            if np.linalg.det(r) > 0:
                m = np.eye(4)
                m[:3, :3], m[:3, 3] = r, centre - r @ c
                out.append(m)
    return out


def best_alignment(points: DataFrame, mesh: Mesh, tried: int = 4) -> np.ndarray:
    """Coarse alignments ranked by the mean absolute distance of RANKED points, those with the smallest hashes; the best
    few are refined with all."""
    starts = coarse_alignments(points, mesh)
    some = points.select("x", "y", "z").orderBy(F.xxhash64("x", "y", "z")).limit(RANKED)
    some = points.sparkSession.createDataFrame([tuple(map(float, r)) for r in some.collect()], "x double, y double, z double")
    cases = None
    for k, m in enumerate(starts):
        part = moved(some, m).withColumn("case", F.lit(k))
        cases = part if cases is None else cases.union(part)
    rank = mesh_distance(cases, mesh).groupBy("case").agg(F.avg(F.abs("distance")).alias("d")).orderBy("d", "case").limit(tried).collect()
    found = []
    for r in rank:
        m = align(points, mesh, starts[r["case"]], rounds=10)
        d = mesh_distance(moved(points.select("x", "y", "z"), m), mesh).agg(F.avg(F.abs("distance"))).first()[0]
        found.append((d, r["case"], m))
    return align(points, mesh, min(found, key=lambda f: f[:2])[2])


def deviations(points: DataFrame, tolerance: float) -> DataFrame:
    """One row of statistics of points(distance): mean, RMS, ends, and the share within the tolerance."""
    d = F.col("distance")
    return points.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rms"), F.min(d).alias("least"), F.max(d).alias("most"), F.avg((F.abs(d) <= tolerance).cast("double")).alias("within"))
