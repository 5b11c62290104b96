"""Wall thickness by rays and by balls, regions of thin walls, components and display levels of meshes, and the meshes of
materials."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brickwise.operators.filters import with_halo
from brickwise.operators.graph import FEW_EDGES, connected_components, stage
from brickwise.operators.ranking import ranks
from brickwise.operators.surface import cross_of, extract_surface, surface_samples

CORNERS = [f"{c}{k}" for k in (1, 2, 3) for c in "xyz"]


def sample(grey: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Trilinear values of an array [x, y, z] at places (n, 3), clamped to its border."""
    top = np.array(grey.shape) - 1
    p = np.clip(at, 0, top)
    lo = np.minimum(np.floor(p).astype(int), top - 1)
    t = p - lo
    out = np.zeros(len(p))
    for c in range(8):
        d = np.array([c & 1, c >> 1 & 1, c >> 2 & 1])
        w = np.where(d, t, 1 - t).prod(1)
        out += w * grey[tuple((lo + d).T)]
    return out


def gradient(grey: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([sample(grey, at + e) - sample(grey, at - e) for e in np.eye(3)], 1)


#: Values of lines, and pairs of points, that are held at once.
HELD = 2_000_000


def _crossing(value: np.ndarray, at: np.ndarray, iso: float) -> np.ndarray:
    """By row, where between the columns at and at + 1 the value passes iso, in columns."""
    row = np.arange(len(value))
    a, b = value[row, at], value[row, at + 1]
    return at + np.where(a == b, 0.0, (a - iso) / np.where(a == b, 1.0, a - b))


def ray_thickness(grey: np.ndarray, points: np.ndarray, normals: np.ndarray, iso: float, most: float, step: float = 0.5, angle: float = 60.0) -> np.ndarray:
    """Distances, in voxels, from surface points against their outward normals to where the material ends; NaN where that
    is farther than `most`, where no surface lies within a voxel of the point, or where the far face doesn't look along the ray.

    A ray is one line of values from a voxel outside to two steps behind `most`. It enters at the change from outside to inside next to its
    point and leaves before the first two values in a row that are outside; both places are interpolated. The far face's normal is
    the falling gradient there, which has to be within `angle` of the ray."""
    lead = int(round(1 / step))
    columns = np.arange(-lead, int(math.ceil(most / step)) + lead + 3)
    out = np.full(len(points), np.nan)
    block = max(1, HELD // len(columns))
    for k in range(0, len(points), block):
        p, n = points[k : k + block], normals[k : k + block]
        line = sample(grey, (p[:, None] - (columns * step)[None, :, None] * n[:, None]).reshape(-1, 3)).reshape(len(p), -1)
        solid = line >= iso
        enters = ~solid[:, : 2 * lead] & solid[:, 1 : 2 * lead + 1]
        start = np.where(enters, np.abs(columns[: 2 * lead] + 0.5), np.inf).argmin(1)
        gone = ~solid[:, 1:-1] & ~solid[:, 2:] & (np.arange(1, len(columns) - 1) > start[:, None] + 1)
        end = gone.argmax(1)
        ok = np.flatnonzero(enters.any(1) & gone.any(1))
        first, last = (_crossing(line[ok], x[ok], iso) for x in (start, end))
        far = (last - first) * step
        exits = p[ok] - ((last - lead) * step)[:, None] * n[ok]
        face = -gradient(grey, exits)
        along = -(face * n[ok]).sum(1) >= math.cos(math.radians(angle)) * np.linalg.norm(face, axis=1)
        good = along & (far <= most)
        out[k + ok[good]] = far[good]
    return out


def inscribed_diameters(points: np.ndarray, normals: np.ndarray, among: np.ndarray, most: float, apart: float = 30.0, cell: float = 4.0) -> np.ndarray:
    """Diameters of the largest balls that touch surface points from inside and hold none of the points `among`; NaN where
    that is `most` or more. The ball that touches p and passes through q has the radius |p - q|^2 / 2 n (p - q): the largest free
    one is the least of these, so no ball has to be tried. A q that its centre sees less than `apart` degrees from p is noise of p's
    own surface and doesn't count. Points are met by cells, nearest cells first, until none can hold a nearer ball."""
    radius = np.full(len(points), most / 2)
    if not len(points) or not len(among):
        return np.full(len(points), np.nan)
    home, own = np.floor(among / cell).astype(int), np.floor(points / cell).astype(int)
    low = np.minimum(home.min(0), own.min(0)) - 1
    size = np.maximum(home.max(0), own.max(0)) - low + 2
    keys = np.ravel_multi_index(tuple((home - low).T), size)
    order = np.argsort(keys, kind="stable")
    keys, among = keys[order], among[order]
    reach = int(math.ceil(most / cell)) + 1
    shifts = np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * 3, indexing="ij"), -1).reshape(-1, 3)
    gaps = cell * np.sqrt((np.maximum(np.abs(shifts) - 1, 0) ** 2).sum(1))
    chord = 2 * math.sin(math.radians(apart) / 2)
    for shift, gap in sorted(zip(map(tuple, shifts), gaps, strict=True), key=lambda x: (x[1], x[0])):
        at = own + shift - low
        live = np.flatnonzero((2 * radius > gap) & ((at >= 0) & (at < size)).all(1))
        if not len(live):
            if gap >= 2 * radius.max():
                break
            continue
        k = np.ravel_multi_index(tuple(at[live].T), size)
        first, last = np.searchsorted(keys, k), np.searchsorted(keys, k, "right")
        live, first, n = live[last > first], first[last > first], (last - first)[last > first]
        begin = 0
        while begin < len(live):
            stop = max(begin + 1, int(np.searchsorted(n[begin:].cumsum(), HELD, "right")) + begin)
            m = n[begin:stop]
            mine = np.repeat(live[begin:stop], m)
            q = among[np.repeat(first[begin:stop], m) + np.arange(m.sum()) - np.repeat(m.cumsum() - m, m)]
            away = points[mine] - q
            square, depth = (away**2).sum(1), (normals[mine] * away).sum(1)
            ok = (depth > 1e-9) & (2 * depth >= chord * np.sqrt(square))
            np.minimum.at(radius, mine[ok], square[ok] / (2 * depth[ok]))
            begin = stop
    return np.where(radius < most / 2, 2 * radius, np.nan)


def _dealt(points: DataFrame, brick: int) -> DataFrame:
    return points.withColumns({f"t{c}": F.floor(F.col(c) / brick).cast("int") for c in "xyz"})


def wall_by_rays(points: DataFrame, voxels: DataFrame, iso: float, most: float = 16.0, brick: int = 64, fill: float = 0.0) -> DataFrame:
    """points (x, y, z, nx, ny, nz, ...) with thickness, in voxels, null where it isn't measured. Points meet the voxels of
    their brick and a halo as wide as the thickest wall."""
    halo = int(math.ceil(most)) + 3
    names = points.columns
    schema = StructType([*points.schema.fields, StructField("thickness", DoubleType())])
    keys = ["tx", "ty", "tz"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        base = np.array([k * brick - halo for k in key])
        grey = np.full((brick + 2 * halo,) * 3, fill)
        grey[tuple(right[c].to_numpy() - b for c, b in zip("xyz", base, strict=True))] = right["grey"]
        found = ray_thickness(grey, left[["x", "y", "z"]].to_numpy(float) - base, left[["nx", "ny", "nz"]].to_numpy(float), iso, most)
        return left[names].assign(thickness=pd.Series(found, index=left.index).astype(object).where(~np.isnan(found), None))

    return _dealt(points, brick).groupBy(*keys).cogroup(with_halo(voxels.select("x", "y", "z", "grey"), brick, halo).groupBy(*keys)).applyInPandas(run, schema)


def wall_by_balls(points: DataFrame, most: float = 16.0, brick: int = 32) -> DataFrame:
    """points (x, y, z, nx, ny, nz, ...) with thickness, null where a ball of the largest diameter fits. Points meet those
    of their own cell and a halo as wide as the largest ball."""
    halo = int(math.ceil(most)) + 1
    names = points.columns
    schema = StructType([*points.schema.fields, StructField("thickness", DoubleType())])
    keys = ["tx", "ty", "tz"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        found = inscribed_diameters(left[["x", "y", "z"]].to_numpy(float), left[["nx", "ny", "nz"]].to_numpy(float), right[["x", "y", "z"]].to_numpy(float), most)
        return left[names].assign(thickness=pd.Series(found, index=left.index).astype(object).where(~np.isnan(found), None))

    return _dealt(points, brick).groupBy(*keys).cogroup(with_halo(points.select("x", "y", "z"), brick, halo).groupBy(*keys)).applyInPandas(run, schema)


def wall_thickness(voxels: DataFrame, iso: float, pitch: float = 1.0, method: str = "ray", most: float = 16.0, brick: int = 64, fill: float = 0.0) -> DataFrame:
    """(x, y, z, nx, ny, nz, area, thickness) at every triangle of the part's surface: places and thickness in units of the pitch, thickness null where
    it isn't measured; by rays through the voxels or by balls between the surface points. most is in voxels."""
    points = surface_samples(extract_surface(voxels, iso, min(brick, 32), fill)).select("x", "y", "z", "nx", "ny", "nz", "area")
    if method == "ray":
        found = wall_by_rays(points, voxels, iso, most, brick, fill)
    elif method == "sphere":
        found = wall_by_balls(points, most, min(brick, 32))
    else:
        raise ValueError(f"wall thickness by ray or sphere, not {method!r}")
    return found.select(*[(F.col(c) * pitch).alias(c) for c in "xyz"], "nx", "ny", "nz", (F.col("area") * pitch * pitch).alias("area"), (F.col("thickness") * pitch).alias("thickness"))


def against_nominal(measured: DataFrame, nominal: DataFrame, reach: float) -> DataFrame:
    """measured points (id, x, y, z, thickness) with nominal, the thickness of the nearest nominal point (x, y, z,
    thickness) within reach, and actual minus nominal. Different places meet by cells as wide as the reach, once each: of nominal points in one
    place the least thickness counts, and measured points in one place have the same nominal."""
    cell = lambda c: F.floor(F.col(c) / reach)
    span = F.sequence(F.lit(-1), F.lit(1))
    places = nominal.where("thickness is not null").groupBy("x", "y", "z").agg(F.min("thickness").alias("nominal"))
    own = places.select(*[cell(c).alias(f"g{c}") for c in "xyz"], *[F.col(c).alias(f"q{c}") for c in "xyz"], "nominal")
    around = measured.select("x", "y", "z").distinct().select("*", F.explode(span).alias("i")).select("*", F.explode(span).alias("j")).select("*", F.explode(span).alias("k"))
    around = around.select("x", "y", "z", *[(cell(c) + F.col(o)).alias(f"g{c}") for c, o in zip("xyz", "ijk", strict=True)])
    d2 = sum(((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in "yz"), (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")))
    near = around.join(own.hint("merge"), ["gx", "gy", "gz"]).select("x", "y", "z", d2.alias("d2"), "nominal").where(F.col("d2") <= reach * reach)
    best = near.groupBy("x", "y", "z").agg(F.min(F.struct("d2", "nominal")).alias("m"))
    both = measured.join(best, ["x", "y", "z"], "left")
    return both.select(*measured.columns, F.col("m.nominal").alias("nominal"), (F.col("thickness") - F.col("m.nominal")).alias("difference"))


def mesh_components(triangles: DataFrame, digits: int = 6) -> DataFrame:
    """triangles (id, x1 .. z3) with component: the smallest id of those that hang together over common corners. A corner
    links its triangles to the smallest of them, so an edge row for each corner of a triangle is all that there is."""
    corners = [F.struct(*[F.round(F.col(f"{c}{k}"), digits).alias(c) for c in "xyz"]) for k in (1, 2, 3)]
    each = triangles.select("id", F.explode(F.array(*corners)).alias("corner"))
    least = each.groupBy("corner").agg(F.min("id").alias("b"))
    edges = each.join(least.hint("merge"), "corner").select(F.col("id").alias("a"), "b").where("a != b")
    roots = connected_components(edges, FEW_EDGES)
    return triangles.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("root", "id")).drop("root")


def with_area(triangles: DataFrame) -> DataFrame:
    n = cross_of()
    return triangles.withColumn("area", F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2)


def outer_skin(triangles: DataFrame) -> DataFrame:
    """The triangles (id, ...) of the component with the largest area, the smallest name among equals."""
    named = with_area(mesh_components(triangles))
    largest = named.groupBy("component").agg(F.sum("area").alias("a")).agg(F.max_by("component", F.struct("a", -F.col("component"))).alias("component"))
    return named.join(F.broadcast(largest), "component", "left_semi").drop("component", "area")


def _linked_cells(points: DataFrame, cells: DataFrame, side: float, reach: float) -> DataFrame:
    """(a, b) of the cells (g, rep) that hold a pair of points within reach of each other, by their representatives. Points (g, x, y, z) are
    boxed by halves of their cells, halved again from round to round: boxes that lie within reach as a whole link their cells, which leave; boxes apart
    go. What is left is compared point by point as soon as that is no more than a few pairs a point."""
    limit = reach * reach
    span = F.sequence(F.lit(-2), F.lit(2))
    named = [F.col("g.x").alias("gx"), F.col("g.y").alias("gy"), F.col("g.z").alias("gz"), "rep"]
    near = cells.select("rep", "g", F.explode(span).alias("i")).select("*", F.explode(span).alias("j")).select("*", F.explode(span).alias("k"))
    near = near.select(F.col("rep").alias("a"), *[(F.col(f"g.{c}") + F.col(o)).alias(f"g{c}") for c, o in zip("xyz", "ijk", strict=True)])
    pairs = near.join(cells.select(*named).hint("merge"), ["gx", "gy", "gz"]).where(F.col("a") < F.col("rep")).select("a", F.col("rep").alias("b"))
    own = stage(points.join(cells.hint("merge"), "g").select("rep", "x", "y", "z"), "thin-places")
    few = 64 * own.count() + FEW_EDGES

    def boxes(k: int) -> DataFrame:
        cell = F.struct(*[F.floor(F.col(c) / (side / 2**k)).alias(c) for c in "xyz"])
        sides = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
        return own.groupBy("rep", cell.alias("at")).agg(F.count("*").alias("n"), *sides)

    def met(k: int, pairs: DataFrame) -> DataFrame:
        """The pairs with every two boxes of a cell each, or with those inside the boxes of a round before, that are not apart."""
        for end in "ab":
            box = boxes(k).select(F.col("rep").alias(end), F.col("at").alias(f"{end}at"), *[F.col(c).alias(f"{end}{c}") for c in ("n", *SIDES)])
            up = [f"{end}up"] if f"{end}up" in pairs.columns else []
            if up:
                box = box.withColumn(up[0], F.struct(*[F.floor(F.col(f"{end}at.{c}") / 2).alias(c) for c in "xyz"]))
            pairs = pairs.join(box.hint("merge"), [end, *up]).drop(*up)
        low = [F.greatest(F.col(f"blo{c}") - F.col(f"ahi{c}"), F.col(f"alo{c}") - F.col(f"bhi{c}"), F.lit(0.0)) for c in "xyz"]
        high = [F.greatest(F.col(f"bhi{c}") - F.col(f"alo{c}"), F.col(f"ahi{c}") - F.col(f"blo{c}")) for c in "xyz"]
        square = lambda d: d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        return pairs.where(square(low) <= limit).select("a", "b", "aat", "bat", "an", "bn", (square(high) <= limit).alias("sure"))

    done, k = None, 0
    while True:
        found = stage(met(k, pairs), "thin-pairs")
        sure = found.where("sure").select("a", "b").distinct()
        done = sure if done is None else done.union(sure)
        rest = stage(found.join(sure.hint("merge"), ["a", "b"], "left_anti").drop("sure"), "thin-open")
        if (rest.agg(F.sum(F.col("an").cast("double") * F.col("bn"))).first()[0] or 0) <= few:
            break
        pairs, k = rest.select("a", "b", F.col("aat").alias("aup"), F.col("bat").alias("bup")), k + 1
    cell = F.struct(*[F.floor(F.col(c) / (side / 2**k)).alias(c) for c in "xyz"])
    for end in "ab":
        rest = rest.join(own.select(F.col("rep").alias(end), cell.alias(f"{end}at"), *[F.col(c).alias(f"{end}{c}") for c in "xyz"]).hint("merge"), [end, f"{end}at"])
    d = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    return done.union(rest.where(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= limit).select("a", "b").distinct())


#: The sides of a box.
SIDES = [f"{n}{c}" for c in "xyz" for n in ("lo", "hi")]


def thin_regions(points: DataFrame, least: float, reach: float) -> DataFrame:
    """(region, n, least, cx, cy, cz, size) of the points (id, x, y, z, thickness) thinner than a limit that hang together
    within a reach, numbered by size. A cell whose diagonal is shorter than the reach is linked as a whole and stands for its points, however many
    they are; links are sought between cells, among different places."""
    side = reach / math.sqrt(3) * (1 - 1e-6)
    cell = F.struct(*[F.floor(F.col(c) / side).alias(c) for c in "xyz"])
    thin = points.where(F.col("thickness") < least).select("id", "x", "y", "z", "thickness", cell.alias("g"))
    cells = stage(thin.groupBy("g").agg(F.min("id").alias("rep")), "thin-cells")
    links = _linked_cells(thin.select("g", "x", "y", "z").distinct(), cells, side, reach)
    roots = connected_components(links, FEW_EDGES).withColumnRenamed("node", "rep")
    home = cells.join(roots, "rep", "left").select("g", F.coalesce("root", "rep").alias("root"))
    named = thin.join(home.hint("merge"), "g")
    sides = [F.max(c) - F.min(c) for c in "xyz"]
    found = named.groupBy("root").agg(F.count("*").alias("n"), F.min("thickness").alias("least"), *[F.avg(c).alias(f"c{c}") for c in "xyz"], F.greatest(*sides).alias("size"))
    return ranks(found, [F.desc("n"), F.col("root")], "region").drop("root")


def display_mesh(voxels: DataFrame, iso: float, budget: int, levels: int = 6, fill: float = 0.0) -> tuple[int, DataFrame]:
    """The finest level whose surface has no more triangles than the budget, and its mesh in voxels of level 0."""
    from brickwise.operators.blocks import pyramid_level

    now = voxels
    for level in range(levels + 1):
        mesh = extract_surface(now, iso, fill=fill)
        if level == levels or mesh.count() <= budget:
            scale = 2**level
            return level, mesh.select(*[(F.col(c) * scale + (scale - 1) / 2).alias(c) for c in CORNERS])
        now = pyramid_level(now)
    raise AssertionError


def material_mesh(labels: DataFrame, material: int, stride: int = 1) -> DataFrame:
    """The triangles of the border of one material of labels (x, y, z, material), on every stride-th voxel, a power of two."""
    if stride < 1 or stride & (stride - 1):
        raise ValueError("the stride is a power of two")
    some = labels.where(F.col("material") == material)
    for c in "xyz":
        some = some.where(F.col(c) % stride == 0)
    cells = some.select(*[(F.col(c) / stride).cast("int").alias(c) for c in "xyz"], F.lit(1).alias("grey"))
    return extract_surface(cells, 0.5).select(*[(F.col(c) * stride).alias(c) for c in CORNERS])
