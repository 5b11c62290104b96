"""Surfaces: distance codes, weighted statistics, transforms, plane cuts, fits and extraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.operators.filters import with_halo


def encode(rows: DataFrame, distance: str, band: float, bits: int) -> DataFrame:
    """rows with code: 0 far inside, the largest far outside, else a floor quantiser clamped to its side."""
    top = 2**bits - 1
    half, step = (top - 1) // 2, 2 * band / (top - 1)
    d = F.col(distance)
    q = F.lit(1) + F.floor((d + band) / step)
    code = F.when(d <= -band, F.lit(0)).when(d >= band, F.lit(top)).when(d < 0, F.least(F.greatest(q, F.lit(1)), F.lit(half))).otherwise(F.least(F.greatest(q, F.lit(half + 1)), F.lit(top - 1)))
    return rows.withColumn("code", code.cast("int"))


def decoded(code: Column, band: float, bits: int) -> Column:
    return -band + (code - 0.5) * (2 * band / (2**bits - 2))


def volume_of_codes(codes: DataFrame, band: float, bits: int, voxel_mm3: float) -> DataFrame:
    """The sum of clamp(0.5 - d, 0, 1). There are 2^bits codes: they are counted first, weighed then."""
    top = 2**bits - 1
    share = F.when(F.col("code") == 0, F.lit(1.0)).when(F.col("code") == top, F.lit(0.0)).otherwise(F.least(F.greatest(0.5 - decoded(F.col("code"), band, bits), F.lit(0.0)), F.lit(1.0)))
    return codes.groupBy("code").agg(F.count("*").alias("n")).agg((F.sum(share * F.col("n")) * voxel_mm3).alias("volume_mm3"))


def weighted_histogram(rows: DataFrame, value: str, weight: str, top: float, bins: int) -> DataFrame:
    at = F.least(F.floor(F.col(value) * bins / top), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.sum(weight).alias("weight"))


def nice_ceil(value: Column) -> Column:
    """The next 1, 2 or 5 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    m = value / power
    return power * F.when(m <= 1, F.lit(1.0)).when(m <= 2, F.lit(2.0)).when(m <= 5, F.lit(5.0)).otherwise(F.lit(10.0))


def transform(points: DataFrame, matrix: list[float]) -> DataFrame:
    """Points moved by a row-major 4x4 matrix."""
    x, y, z = (F.col(c) for c in "xyz")
    out = {c: matrix[4 * k] * x + matrix[4 * k + 1] * y + matrix[4 * k + 2] * z + matrix[4 * k + 3] for k, c in enumerate("xyz")}
    return points.withColumns(out)


def plane_cut(triangles: DataFrame) -> DataFrame:
    """Cut triangles of (id, d1, d2, d3), the signed distances of their corners: how many edges are cut, always two
    (half-open), and where along the first edge if it is."""
    side = [F.col(f"d{k}") < 0 for k in (1, 2, 3)]
    cuts = [side[0] != side[1], side[1] != side[2], side[2] != side[0]]
    ends = cuts[0].cast("int") + cuts[1].cast("int") + cuts[2].cast("int")
    t12 = F.when(cuts[0], F.col("d1") / (F.col("d1") - F.col("d2")))
    return triangles.where(cuts[0] | cuts[1] | cuts[2]).select("*", ends.alias("ends"), t12.alias("t12"))


def fit_sums(pairs: DataFrame) -> DataFrame:
    """The sums that a rigid fit of point pairs (p, q) needs: one row, whatever the number of pairs."""
    p, q = ("px", "py", "pz"), ("qx", "qy", "qz")
    return pairs.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a in p for b in q], *[F.sum(c).alias(f"s_{c}") for c in p + q])


def rigid_fit(pairs: DataFrame) -> list[float]:
    """The 4x4 matrix that moves p onto q with the least squares: the largest eigenvector of the quaternion matrix."""
    s = fit_sums(pairs).first().asDict()
    n = s["n"]
    p = np.array([s[f"s_p{c}"] for c in "xyz"]) / n
    q = np.array([s[f"s_q{c}"] for c in "xyz"]) / n
    m = np.array([[s[f"s_p{a}_q{b}"] / n for b in "xyz"] for a in "xyz"]) - np.outer(p, q)
    k = np.zeros((4, 4))
    k[0, 0] = np.trace(m)
    k[0, 1:] = k[1:, 0] = [m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]]
    k[1:, 1:] = m + m.T - np.trace(m) * np.eye(3)
    values, vectors = np.linalg.eigh(k)
    if values[-1] - values[-2] < 1e-12 * max(1.0, abs(values[-1])):
        raise ValueError("the points don't determine a rotation")
    w, x, y, z = vectors[:, -1]
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, q - r @ p
    return out.ravel().tolist()


#: Places in a cell, on average, where the search for neighbours begins.
CROWD = 4


def nearest(points: DataFrame, among: DataFrame, levels: int = 60) -> DataFrame:
    """(id, nearest, d2) of each point: the nearest other one, the smaller id of equals. Points in one place are told from their two smallest
    ids; of the others, the 27 grid cells around a point are searched, where a place stands for all its points. A point leaves when its best find is no
    farther than a cell, else the cells are made twice as wide for those that are left, until none is. The first cells are so narrow that a few places
    share one, however crowded the space is."""
    from brickwise.operators.graph import stage

    ids = stage(among.select("id", "x", "y", "z"), "nearest-among")
    first = stage(ids.groupBy("x", "y", "z").agg(F.min("id").alias("first")), "nearest-places")
    second = ids.join(first.hint("merge"), ["x", "y", "z"]).where("id != first").groupBy("x", "y", "z").agg(F.min("id").alias("second"))
    at_home = first.join(second.hint("merge"), ["x", "y", "z"], "left")
    asked = points.select("id", "x", "y", "z").join(at_home.hint("merge"), ["x", "y", "z"], "left")
    rest = stage(asked.select("id", "x", "y", "z", F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second")).alias("nearest")), "nearest")
    done = rest.where("nearest is not null").select("id", "nearest", F.lit(0.0).alias("d2"))
    rest = rest.where("nearest is null").drop("nearest")
    ends = first.agg(F.count("*"), F.max(F.greatest(*[F.abs(c) for c in "xyz"]))).first()
    if not ends[0] or rest.isEmpty():
        return done
    cell = max(2 * ends[1] / max(1.0, ends[0] ** (1 / 3)), 1e-300)
    grid = lambda: {f"g{c}": F.floor(F.col(c) / cell) for c in "xyz"}
    while first.select(*[v.alias(k) for k, v in grid().items()]).distinct().count() * CROWD < ends[0] and cell > ends[1] * 2**-40:
        cell /= 2
    d2 = sum(((F.col(c) - F.col(f"b{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("bx")) ** 2)
    span = F.sequence(F.lit(-1), F.lit(1))
    for _ in range(levels):
        at = grid()
        own = first.select(F.col("first").alias("bid"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *[v.alias(k) for k, v in at.items()])
        around = rest.select("id", "x", "y", "z", F.explode(span).alias("i")).select("*", F.explode(span).alias("j")).select("*", F.explode(span).alias("k"))
        around = around.select("id", "x", "y", "z", *[(at[f"g{c}"] + F.col(o)).alias(f"g{c}") for c, o in zip("xyz", "ijk", strict=True)])
        near = around.join(own.hint("merge"), ["gx", "gy", "gz"]).where("id != bid").groupBy("id").agg(F.min(F.struct(d2.alias("d2"), F.col("bid").alias("nearest"))).alias("m"))
        sure = stage(near.where(F.col("m.d2") <= cell * cell).select("id", "m.nearest", "m.d2"), "nearest-found")
        done = done.union(sure)
        rest = stage(rest.join(sure.hint("merge"), "id", "left_anti"), "nearest-open")
        if not rest.head(1):
            break
        cell *= 2
    return done


def icp_sums(matches: DataFrame, floor: float) -> DataFrame:
    """The normal equations of one point-to-plane round: rows (x, y, z, nx, ny, nz, r); residuals are weighed by Huber's
    rule and dropped beyond the rejection limit. One row of 27 sums comes back."""
    r = F.abs("r")
    sigma = matches.agg((1.4826 * F.expr("percentile_disc(0.5) within group (order by abs(r))")).alias("sigma"))
    m = matches.join(F.broadcast(sigma))
    huber, limit = F.greatest(2 * F.col("sigma"), F.lit(floor)), F.greatest(5 * F.col("sigma"), F.lit(3 * floor))
    w = F.when(r <= huber, F.lit(1.0)).otherwise(huber / r)
    j = [F.col("y") * F.col("nz") - F.col("z") * F.col("ny"), F.col("z") * F.col("nx") - F.col("x") * F.col("nz"), F.col("x") * F.col("ny") - F.col("y") * F.col("nx"), F.col("nx"), F.col("ny"), F.col("nz")]
    m = m.where(r <= limit).select(w.alias("w"), "r", *[c.alias(f"j{k}") for k, c in enumerate(j)])
    return m.agg(*[F.sum(F.col("w") * F.col(f"j{a}") * F.col(f"j{b}")).alias(f"a{a}{b}") for a in range(6) for b in range(a, 6)], *[F.sum(F.col("w") * F.col(f"j{a}") * F.col("r")).alias(f"b{a}") for a in range(6)])


def surface_points(voxels: DataFrame, iso: float) -> DataFrame:
    """(x, y, z, axis) of the zero crossings between face neighbours, at sub-voxel places."""
    pairs = None
    for axis in "xyz":
        other = voxels.select(*[(F.col(c) - 1).alias(c) if c == axis else F.col(c) for c in "xyz"], F.col("grey").alias("next"))
        both = voxels.join(other, ["x", "y", "z"]).where((F.col("grey") >= iso) != (F.col("next") >= iso))
        t = (iso - F.col("grey")) / (F.col("next") - F.col("grey"))
        part = both.select(*[(F.col(c) + t).alias(c) if c == axis else F.col(c).cast("double").alias(c) for c in "xyz"], F.lit(axis).alias("axis"))
        pairs = part if pairs is None else pairs.union(part)
    return pairs


#: Corners of a cell's six tetrahedra around its main diagonal, as bits x, y, z of the corner number.
TETRAHEDRA = ((0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7))


def _tetra_triangles(value: np.ndarray, place: np.ndarray, iso: float) -> np.ndarray:
    """Triangles (n, 3, 3) of the iso surface in tetrahedra with corner values (m, 4) and places (m, 4, 3). Their corners run
    counterclockwise for one who looks from the lower values: they wind outward."""
    inside = value >= iso
    out, outward = [], []

    def cut(rows, a, b):
        t = (iso - value[rows, a]) / (value[rows, b] - value[rows, a])
        return place[rows, a] + t[:, None] * (place[rows, b] - place[rows, a])

    for code in range(1, 15):
        rows = np.flatnonzero((inside * (1 << np.arange(4))).sum(1) == code)
        if not len(rows):
            continue
        hi = [k for k in range(4) if code >> k & 1]
        lo = [k for k in range(4) if not code >> k & 1]
        if len(hi) in (1, 3):
            top, rest = (hi[0], lo) if len(hi) == 1 else (lo[0], hi)
            some = [np.stack([cut(rows, top, k) for k in rest], 1)]
        else:
            a, b, c, d = cut(rows, hi[0], lo[0]), cut(rows, hi[0], lo[1]), cut(rows, hi[1], lo[1]), cut(rows, hi[1], lo[0])
            some = [np.stack([a, b, c], 1), np.stack([a, c, d], 1)]
        out += some
        outward += [place[rows][:, lo].mean(1) - place[rows][:, hi].mean(1)] * len(some)
    if not out:
        return np.zeros((0, 3, 3))
    t, away = np.concatenate(out), np.concatenate(outward)
    # Within a tetrahedron the values are linear, so the way from its inner to its outer corners lies on the outer side.
    turned = (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) * away).sum(1) < 0
    t[turned] = t[turned][:, ::-1]
    return t


def iso_triangles(grey: np.ndarray, iso: float) -> np.ndarray:
    """Triangles (n, 3, 3) of the iso surface of values at the places [x, y, z] of an array, in all its cells."""
    sizes = np.array(grey.shape) - 1
    corner = np.stack([grey[i : sizes[0] + i, j : sizes[1] + j, k : sizes[2] + k] for k in (0, 1) for j in (0, 1) for i in (0, 1)], -1)
    mixed = np.argwhere((corner.max(-1) >= iso) & (corner.min(-1) < iso))
    values = corner[tuple(mixed.T)]
    bits = np.array([[c & 1, c >> 1 & 1, c >> 2 & 1] for c in range(8)])
    return np.concatenate([_tetra_triangles(values[:, t], mixed[:, None, :] + bits[list(t)][None], iso) for t in TETRAHEDRA])


def extract_surface(voxels: DataFrame, iso: float, brick: int = 32, fill: float = 0.0) -> DataFrame:
    """(x1 .. z3) of the iso surface's triangles by marching tetrahedra, a brick with a halo of one voxel at a time; every
    cell belongs to the brick of its lower corner. Triangles wind outward, away from the higher values. Inactive voxels have the fill value."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grey = np.full((brick + 2,) * 3, fill, dtype=float)
        base = np.array(key) * brick - 1
        grey[tuple(pdf[c].to_numpy() - b for c, b in zip("xyz", base, strict=True))] = pdf["grey"]
        # Cells that begin in the halo are a neighbour's.
        t = iso_triangles(grey[1:, 1:, 1:], iso) + base + 1
        return pd.DataFrame(t.reshape(-1, 9), columns=[f"{c}{k}" for k in (1, 2, 3) for c in "xyz"])

    schema = ", ".join(f"{c}{k} double" for k in (1, 2, 3) for c in "xyz")
    return with_halo(voxels.select("x", "y", "z", "grey"), brick, 1).groupBy("tx", "ty", "tz").applyInPandas(run, schema)


def cross_of() -> list[Column]:
    """Twice the area of a triangle (x1 .. z3) as a vector along its outward side."""
    a, b = ([F.col(f"{c}{k}") - F.col(f"{c}1") for c in "xyz"] for k in (2, 3))
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def mesh_measures(triangles: DataFrame) -> DataFrame:
    """One row (triangles, area, volume) of a mesh: the volume by signed tetrahedra from the origin, which is right for
    closed meshes that wind outward and negative for inverted ones."""
    n = cross_of()
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    volume = (F.col("x1") * n[0] + F.col("y1") * n[1] + F.col("z1") * n[2]) / 6
    return triangles.agg(F.count("*").alias("triangles"), F.sum(area).alias("area"), F.sum(volume).alias("volume"))


def surface_samples(triangles: DataFrame) -> DataFrame:
    """triangles with a point (x, y, z) in their middle, the outward unit normal (nx, ny, nz) and their area; triangles
    without an area have no normal and go."""
    n = cross_of()
    long = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    middle = [((F.col(f"{c}1") + F.col(f"{c}2") + F.col(f"{c}3")) / 3).alias(c) for c in "xyz"]
    return triangles.where(long > 1e-12).select("*", *middle, *[(v / long).alias(f"n{c}") for v, c in zip(n, "xyz", strict=True)], (long / 2).alias("area"))
