"""Measuring plans: elements, characteristics of fourteen kinds and their values, extraction of an element's points, and
the elements that a mesh has."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators.dimensional import KINDS, fit_element

#: The kinds of characteristics, and how many elements each takes.
CHARACTERISTICS = {
    "diameter": 1,
    "radius": 1,
    "distance": 2,
    "angle": 2,
    "coordinate": 1,
    "position": 1,
    "flatness": 1,
    "cylindricity": 1,
    "sphericity": 1,
    "form": 1,
    "parallelism": 1,
    "perpendicularity": 1,
    "profile": 1,
    "deviation": 1,
}
ORIENTED = ("parallelism", "perpendicularity")
PLAN = "number int, label string, kind string, a string, b string, datum string, axis int, nominal double, tolerance double"


def parse_plan(spark: SparkSession, plan: dict) -> DataFrame:
    """The characteristics of a plan {elements, characteristics}, checked: a row (number, label, kind, a, b, datum, axis,
    nominal, tolerance) for each."""
    known = {}
    for e in plan.get("elements", []):
        if e.get("type") not in KINDS:
            raise ValueError(f"element {e.get('id')!r}: unknown type {e.get('type')!r}")
        if e["id"] in known:
            raise ValueError(f"element {e['id']!r} stands twice")
        known[e["id"]] = e["type"]
    rows, numbers = [], set()
    for c in plan.get("characteristics", []):
        number, kind = c["number"], c.get("type")
        if number in numbers:
            raise ValueError(f"characteristic {number} stands twice")
        numbers.add(number)
        if kind not in CHARACTERISTICS:
            raise ValueError(f"characteristic {number}: unknown type {kind!r}")
        names = c.get("elements") or [c.get("element")]
        if len(names) != CHARACTERISTICS[kind]:
            raise ValueError(f"characteristic {number}: {kind} takes {CHARACTERISTICS[kind]} elements")
        for name in [*names, *([c["datum"]] if c.get("datum") else [])]:
            if name not in known:
                raise ValueError(f"characteristic {number}: no element {name!r}")
        if kind in ORIENTED and not c.get("datum"):
            raise ValueError(f"characteristic {number}: {kind} needs a datum")
        axis = c.get("axis")
        if kind == "coordinate" and axis not in ("x", "y", "z"):
            raise ValueError(f"characteristic {number}: a coordinate needs an axis")
        number_of = lambda v: None if v is None else float(v)
        rows.append((int(number), c.get("label"), kind, names[0], names[1] if len(names) > 1 else None, c.get("datum"), None if axis is None else "xyz".index(axis), number_of(c.get("nominal")), number_of(c.get("tolerance"))))
    return spark.createDataFrame(rows, PLAN)


def _vector(prefix: str, which: str) -> list[Column]:
    return [F.col(f"{prefix}_{which}{c}") for c in "xyz"]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _axis_distance(element: str, point: list[Column]) -> Column:
    d = [q - p for p, q in zip(_vector(element, "c"), point, strict=True)]
    along = _dot(d, _vector(element, "d"))
    return F.sqrt(F.greatest(_dot(d, d) - along * along, F.lit(0.0)))


def distance_of() -> Column:
    """The distance of elements a and b: along the axis if one is given, else square to a plane, across a cylinder's axis
    (a's before b's), or straight."""
    ca, cb = _vector("a", "c"), _vector("b", "c")
    d = [q - p for p, q in zip(ca, cb, strict=True)]
    given = F.abs(F.get(F.array(*d), F.col("axis")))
    return (
        F.when(F.col("axis").isNotNull(), given)
        .when(F.col("a_kind") == "plane", F.abs(_dot(_vector("a", "d"), d)))
        .when(F.col("b_kind") == "plane", F.abs(_dot(_vector("b", "d"), d)))
        .when(F.col("a_kind") == "cylinder", _axis_distance("a", cb))
        .when(F.col("b_kind") == "cylinder", _axis_distance("b", ca))
        .otherwise(F.sqrt(_dot(d, d)))
    )


def angle_of() -> Column:
    """The angle of two directions in degrees; an axis has no side, and between an axis and a face it counts from the
    face."""
    dot = F.greatest(F.least(_dot(_vector("a", "d"), _vector("b", "d")), F.lit(1.0)), F.lit(-1.0))
    angle = F.degrees(F.acos(dot))
    folded = F.least(angle, 180 - angle)
    a, b = F.col("a_kind") == "cylinder", F.col("b_kind") == "cylinder"
    return F.when(a & b, folded).when(a | b, 90 - folded).otherwise(angle)


def position_of(size: str = "b") -> Column:
    """Twice how far the element is off its nominal place: for cylinders the worse end of the axis, for planes the
    worst deviation (form and shift), else the centre."""
    half = F.col("a_length") / 2
    ends = [[c + s * half * d for c, d in zip(_vector("a", "c"), _vector("a", "d"), strict=True)] for s in (-1, 1)]
    off = [q - p for p, q in zip(_vector(size, "c"), _vector("a", "c"), strict=True)]
    return (
        F.when(F.col("a_kind") == "cylinder", 2 * F.greatest(*[_axis_distance(size, e) for e in ends]))
        .when(F.col("a_kind") == "plane", 2 * (F.abs(_dot(off, _vector(size, "d"))) + F.col("a_form") / 2))
        .otherwise(2 * F.sqrt(_dot(off, off)))
    )


def orientation_of() -> Column:
    """The zone that an axis needs against its datum, or, of planes, their extent along the datum's direction times the
    sine or cosine of the angle between them, plus the form."""
    n, r = _vector("a", "d"), _vector("b", "d")
    cos = F.abs(_dot(n, r))
    sin = F.sqrt(F.greatest(1 - cos * cos, F.lit(0.0)))
    datum_plane, feature_plane = F.col("b_kind") == "plane", F.col("a_kind") == "plane"
    parallel = F.col("kind") == "parallelism"
    axis = F.when(parallel != datum_plane, F.col("a_length") * sin).otherwise(F.col("a_length") * cos)
    face = F.when(parallel == datum_plane, F.col("a_length") * sin).otherwise(F.col("a_length") * cos) + F.col("a_form")
    return F.when(feature_plane, face).otherwise(axis)


def characteristic_values(plan: DataFrame, elements: DataFrame, nominal: DataFrame | None = None) -> DataFrame:
    """The plan's rows with measured, null where an element is missing. elements are fitted ones (element, kind, cx .. dz,
    radius, form, length, worst); positions are against the element of the same name in nominal. A plan and its elements
    are a handful of rows."""
    keep = ["element", "kind", "cx", "cy", "cz", "dx", "dy", "dz", "radius", "form", "length", "worst"]
    wide = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in keep])
    joined = plan.join(wide(elements, "a"), F.col("a") == F.col("a_element"), "left")
    other = F.coalesce("b", "datum")
    paired = joined.join(wide(elements, "b"), other == F.col("b_element"), "left")
    if nominal is not None:
        paired = paired.join(wide(nominal, "o"), F.col("a") == F.col("o_element"), "left")
    kind = F.col("kind")
    value = (
        F.when(kind == "diameter", 2 * F.col("a_radius"))
        .when(kind == "radius", F.col("a_radius"))
        .when(kind == "distance", distance_of())
        .when(kind == "angle", angle_of())
        .when(kind == "coordinate", F.get(F.array(*_vector("a", "c")), F.col("axis")))
        .when(kind.isin("flatness", "cylindricity", "sphericity", "form"), F.col("a_form"))
        .when(kind.isin(*ORIENTED), orientation_of())
        .when(kind == "profile", 2 * F.col("a_worst"))
        .when(kind == "deviation", F.col("a_worst"))
    )
    if nominal is not None:
        value = F.when(kind == "position", position_of("o")).otherwise(value)
    return paired.select(*plan.columns, value.alias("measured"), F.when(kind == "angle", "deg").otherwise("mm").alias("unit"))


def extract_points(points: DataFrame, nominal: DataFrame, search: float, margin: float, angle: float = 30.0) -> DataFrame:
    """points (x, y, z, nx, ny, nz, ...) with element and kind: those within the search distance of a nominal element (element,
    kind, cx .. dz, radius, length), whose normals agree within an angle, and that stay a margin away from its edges. The
    elements are a plan's handful; Spark broadcasts them by their size."""
    e = nominal.select(*[F.col(c).alias(f"b_{c}") for c in ("element", "kind", "cx", "cy", "cz", "dx", "dy", "dz", "radius", "length")])
    p, n = [F.col(c) for c in "xyz"], [F.col(f"n{c}") for c in "xyz"]
    both = points.join(e)
    w = [a - b for a, b in zip(p, _vector("b", "c"), strict=True)]
    along = _dot(w, _vector("b", "d"))
    across = [a - along * b for a, b in zip(w, _vector("b", "d"), strict=True)]
    off = F.sqrt(F.greatest(_dot(across, across), F.lit(1e-30)))
    far = F.sqrt(F.greatest(_dot(w, w), F.lit(1e-30)))
    plane, cylinder, sphere = (F.col("b_kind") == k for k in ("plane", "cylinder", "sphere"))
    distance = F.when(plane, along).when(cylinder, off - F.col("b_radius")).when(sphere, far - F.col("b_radius")).otherwise(along)
    facing = F.when(plane, _dot(n, _vector("b", "d"))).when(cylinder, _dot(n, across) / off).when(sphere, _dot(n, w) / far).otherwise(F.lit(1.0))
    inner = F.when(plane, off <= F.col("b_length") / 2 - margin).when(cylinder, F.abs(along) <= F.col("b_length") / 2 - margin).otherwise(F.lit(True))
    kept = both.where((F.abs(distance) <= search) & (F.abs(facing) >= math.cos(math.radians(angle))) & inner)
    others = [c for c in points.columns if c not in ("x", "y", "z", "nx", "ny", "nz")]
    return kept.select(F.col("b_element").alias("element"), F.col("b_kind").alias("kind"), "x", "y", "z", distance.alias("deviation"), *others)


def find_features(triangles: np.ndarray, angle: float = 10.0, form: float = 1e-3, least: int = 4) -> pd.DataFrame:
    """The planes, cylinders and spheres of a design mesh (n, 3, 3): facets are grown over common edges as long as normals
    turn by no more than an angle, then each region gets the simplest element that fits its corners within form times its
    size. A design mesh has a checked size."""
    from brickwise.operators.compare import MOST_TRIANGLES
    from brickwise.operators.graph import dense_roots

    if len(triangles) > MOST_TRIANGLES:
        raise ValueError(f"a design mesh has {MOST_TRIANGLES} triangles at most")
    n = np.cross(triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0])
    n /= np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
    _, corner = np.unique(triangles.reshape(-1, 3).round(6), axis=0, return_inverse=True)
    corner = corner.reshape(-1, 3)
    edge = np.sort(np.concatenate([corner[:, [0, 1]], corner[:, [1, 2]], corner[:, [2, 0]]]), axis=1)
    owner = np.tile(np.arange(len(triangles)), 3)
    by = np.lexsort((edge[:, 1], edge[:, 0]))
    edge, owner = edge[by], owner[by]
    same = (edge[1:] == edge[:-1]).all(1)
    a, b = owner[:-1][same], owner[1:][same]
    cos = (n[a] * n[b]).sum(1)
    flat = cos >= math.cos(math.radians(1e-3))
    rows = []

    def add(part: np.ndarray, kinds: tuple[str, ...]) -> bool:
        p = np.unique(triangles[part].reshape(-1, 3), axis=0)
        size = float(np.linalg.norm(p.max(0) - p.min(0)))
        for kind in kinds:
            if len(p) >= (3 if kind == "plane" else 6):
                got = fit_element(kind, p)
                if got["form"] <= form * size and (kind == "plane" or got["radius"] < 4 * size):
                    along = p @ np.array([got["dx"], got["dy"], got["dz"]])
                    rows.append({"element": f"{kind}{len(rows) + 1}", "kind": kind, **got, "length": float(np.ptp(along)) if kind == "cylinder" else size, "worst": got["form"] / 2, "triangles": len(part)})
                    return True
        return False

    planes = dense_roots(len(triangles), a[flat], b[flat])
    area = np.linalg.norm(np.cross(triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0]), axis=1) / 2
    smooth = dense_roots(len(triangles), a[cos >= math.cos(math.radians(angle))], b[cos >= math.cos(math.radians(angle))])
    for root in np.unique(smooth):
        part = np.flatnonzero(smooth == root)
        inner = np.unique(planes[part])
        if len(inner) > 1 and len(part) >= least and add(part, ("cylinder", "sphere")):
            continue
        for q in inner if len(inner) <= 1 or area[part].sum() else ():
            face = np.flatnonzero(planes == q)
            if len(inner) == 1 or area[face].sum() > 0.05 * area[part].sum():
                add(face, ("plane",))
    return pd.DataFrame(rows)
