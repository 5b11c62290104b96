"""Registered operations over meshes, comparisons, plans, cells, reports and models; registry has those over volumes."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators import battery, cells, compare, dimensional, evaluate, hardening, histogram, plan, report, shape, surface, walls
from brickwise.plans.registry import NUMBER, PATH, operation
from brickwise.sources import export, images, metadata, raw

COUNT = {"type": "integer", "minimum": 1}
TEXT = {"type": "string"}
POINTS = ", ".join(f"{c} double" for c in ("px", "py", "pz", "qx", "qy", "qz"))


def _centres(triangles: DataFrame) -> DataFrame:
    """Points (x, y, z, nx, ny, nz, area) in the middle of triangles; the normal has the sense of their corners."""
    a, b = ([F.col(f"{c}{k}") - F.col(f"{c}1") for c in "xyz"] for k in (2, 3))
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    middle = [((F.col(f"{c}1") + F.col(f"{c}2") + F.col(f"{c}3")) / 3).alias(c) for c in "xyz"]
    rows = triangles.select(*middle, *[(v / length).alias(f"n{c}") for c, v in zip("xyz", n, strict=True)], (length / 2).alias("area"))
    return rows.where("area > 1e-12")


def _pose(spark: SparkSession, matrix: np.ndarray | list) -> DataFrame:
    return spark.createDataFrame([([float(v) for v in np.asarray(matrix).ravel()],)], "matrix array<double>")


def _apply(points: DataFrame, pose: DataFrame | None) -> DataFrame:
    return points if pose is None else surface.transform(points, pose.first()["matrix"])


@operation("import_gzipped_xml", (), "dataset", path=PATH, folder=PATH, place={"type": "integer", "minimum": 0, "default": 0})
def _import_xml(spark: SparkSession, path: str, folder: str, place: int) -> DataFrame:
    """The raw volume that a project names, from a folder."""
    row = metadata.read_projects(spark, path).where(F.col("place") == place).first()
    if row is None or len(row["dims"]) != 3:
        raise ValueError(f"import_gzipped_xml: no volume {place} with three sizes")
    nx, ny, nz = row["dims"]
    return raw.read_raw(spark, f"{folder}/{row['file']}", nx=nx, ny=ny, nz=nz, type=row["type"])


@operation("move", ("mesh",), "pose", matrix={"type": "array"})
def _move(spark: SparkSession, mesh: DataFrame, matrix: list) -> DataFrame:
    m = np.array(matrix, dtype=float)
    if m.size != 16 or not np.allclose(m.reshape(4, 4)[3], [0, 0, 0, 1]) or not np.allclose(m.reshape(4, 4)[:3, :3] @ m.reshape(4, 4)[:3, :3].T, np.eye(3), atol=1e-6):
        raise ValueError("move: the matrix is a rigid 4x4 motion")
    return _pose(spark, m)


@operation("align_points", (), "pose", pairs={"type": "array"})
def _align_points(spark: SparkSession, pairs: list) -> DataFrame:
    """The motion that brings the first point of each pair, six numbers, onto its second with the least squares."""
    if len(pairs) < 3:
        raise ValueError("align_points: three pairs at least")
    return _pose(spark, surface.rigid_fit(spark.createDataFrame([tuple(map(float, p)) for p in pairs], POINTS)))


@operation("align_surfaces", ("surface", "mesh"), "pose", coarse={"type": "boolean", "default": True})
def _align_surfaces(spark: SparkSession, found: DataFrame, mesh: DataFrame, coarse: bool) -> DataFrame:
    points, nominal = _centres(found).select("x", "y", "z"), compare.nominal_mesh(mesh)
    return _pose(spark, compare.best_alignment(points, nominal) if coarse else compare.align(points, nominal))


def _compared(found: DataFrame, mesh: DataFrame, pose: DataFrame | None) -> DataFrame:
    return compare.mesh_distance(_apply(_centres(found).select("x", "y", "z", "area"), pose), compare.nominal_mesh(mesh))


@operation("compare_cad", ("surface", "mesh"), "comparison", align={"type": "boolean", "default": True}, flexible={"type": "boolean", "default": False})
def _compare_cad(spark: SparkSession, found: DataFrame, mesh: DataFrame, align: bool, flexible: bool) -> DataFrame:
    """(x, y, z, area, distance, nx, ny, nz) of a surface against its design, aligned first, and bent onto it if asked."""
    points, nominal = _centres(found).select("x", "y", "z", "area"), compare.nominal_mesh(mesh)
    if align:
        points = compare.moved(points, compare.best_alignment(points.select("x", "y", "z"), nominal))
    if flexible:
        points = shape.warped(points, shape.register(points, nominal))
    return compare.mesh_distance(points, nominal)


@operation("compare_objects", ("surface", "mesh"), "comparison", optional=("pose",))
def _compare_objects(spark: SparkSession, found: DataFrame, mesh: DataFrame, pose: DataFrame | None) -> DataFrame:
    return _compared(found, mesh, pose)


@operation("inspection_regions", (), "regions", order=TEXT)
def _regions(spark: SparkSession, order: str) -> DataFrame:
    """(zone, x1 .. z3): the boxes of an inspection order, a JSON text, as triangles."""
    zones = report.zones_of_order(spark, json.loads(order))
    #: The corners, as bits x, y, z, of a box's twelve triangles.
    sides = ((0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5))
    corner = lambda k: [F.col(f"{c}{k >> n & 1}") for n, c in enumerate("xyz")]
    faces = F.array(*[F.struct(*[v.alias(f"{c}{i}") for i, k in enumerate(t, 1) for c, v in zip("xyz", corner(k), strict=True)]) for t in sides])
    return zones.select("zone", F.explode(faces).alias("t")).select("zone", "t.*")


@operation("material_meshes", ("materials",), "mesh", materials={"type": "array", "default": []}, stride=COUNT | {"default": 1})
def _material_meshes(spark: SparkSession, labels: DataFrame, materials: list, stride: int) -> DataFrame:
    """(path, x1 .. z3): the borders of the given materials, all if none are given; path is material<id>."""
    known = materials or sorted(r["material"] for r in labels.where("material > 0").select("material").distinct().collect())
    out = None
    for m in known:
        part = walls.material_mesh(labels, m, stride).select(F.lit(f"material{m}").alias("path"), *walls.CORNERS)
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("material_meshes: no material")
    return out


@operation("segment_model", ("dataset",), "materials", path=PATH, offset=NUMBER | {"default": 0.0}, scale=NUMBER | {"default": 1.0}, halo=COUNT | {"default": 8})
def _segment_model(spark: SparkSession, dataset: DataFrame, path: str, offset: float, scale: float, halo: int) -> DataFrame:
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    return shape.apply_model(dataset, shape.read_model(data), offset, scale, halo=halo)


@operation("beam_hardening", ("dataset",), "dataset", order={"type": "integer", "minimum": 2, "maximum": 4, "default": 3}, level={"type": "integer", "minimum": 0, "maximum": 3, "default": 1}, air=NUMBER | {"default": 0.0}, material=NUMBER | {"default": 0.0})
def _beam_hardening(spark: SparkSession, dataset: DataFrame, order: int, level: int, air: float, material: float) -> DataFrame:
    """Levels that aren't given are those of Otsu's classes."""
    size = 1 + max(dataset.agg(F.max("x"), F.max("y")).first())
    if not material:
        hist = histogram.grey_histogram(dataset)
        t = histogram.otsu(hist).first()
        air = air or float(t["air_level"])
        above = hist.where(F.col("v") > t["threshold"]).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m")).first()
        material = float(above["m"])
    value = F.least(F.greatest(F.floor(F.col("value") + 0.5), F.lit(0)), F.lit(65535)).cast("int")
    return hardening.correct(dataset, size, order, air, material, level).select("x", "y", "z", value.alias("grey"))


@operation("battery_inspection", ("dataset",), "battery", threshold=NUMBER, anode=NUMBER, cathode=NUMBER, tolerance=NUMBER, reach=COUNT | {"default": 6}, pitch=NUMBER | {"default": 1.0})
def _battery(spark: SparkSession, dataset: DataFrame, threshold: float, anode: float, cathode: float, tolerance: float, reach: int, pitch: float) -> DataFrame:
    """(type, axis, edge, section, layer, overhang_mm) of a cell: overhangs of a stacked one's layers; a wound one has the
    radii of its can by section instead."""
    seen = cells.overview(dataset, threshold).first()
    kind, axis = seen["type"], seen["axis"]
    if kind == "stacked":
        turned = dataset if axis == "z" else dataset.withColumns({"z": F.col(axis), axis: F.col("z")})
        layers = cells.stacked_layers(turned, anode, cathode, tolerance)
        return cells.stacked_overhang(layers, reach, pitch).select(F.lit(kind).alias("type"), F.lit(axis).alias("axis"), "edge", F.col("section").cast("int").alias("section"), F.col("layer").cast("long").alias("layer"), F.col("overhang").alias("overhang_mm"))
    a, b = (c for c in "xyz" if c != axis)
    rim = dataset.where(F.col("grey") > threshold).groupBy(F.col(axis).alias("section"), F.col(b).alias("y")).agg(F.min(a).alias("lo"), F.max(a).alias("hi"))
    outline = rim.select("section", F.col("y").cast("double").alias("y"), F.explode(F.array("lo", "hi")).cast("double").alias("x"))
    fits = battery.fit_circles(battery.circle_sums(outline, ["section"]), ["section"])
    return fits.select(F.lit(kind).alias("type"), F.lit(axis).alias("axis"), F.lit("can").alias("edge"), F.col("section").cast("int").alias("section"), F.lit(0).cast("long").alias("layer"), (F.col("radius") * pitch).alias("overhang_mm"))


@operation("battery_images", (), "battery", path=PATH, threshold=NUMBER, anode=NUMBER, cathode=NUMBER, tolerance=NUMBER, pitch=NUMBER | {"default": 1.0})
def _battery_images(spark: SparkSession, path: str, threshold: float, anode: float, cathode: float, tolerance: float, pitch: float) -> DataFrame:
    """The same of a folder of section images: a row for each section with its least overhang."""
    pixels = images.read_stack(spark, path, "png").select(F.lit("cell").alias("cell"), F.col("z").alias("section"), "x", "y", "value")
    found = cells.image_cells(pixels, threshold, anode, cathode, tolerance)
    return found.select("type", F.lit("z").alias("axis"), F.lit("section").alias("edge"), "section", F.col("cathodes").cast("long").alias("layer"), (F.col("least_overhang") * pitch).alias("overhang_mm"))


@operation("battery_report", ("battery",), "report", limits={"type": "object"})
def _battery_report(spark: SparkSession, samples: DataFrame, limits: dict) -> DataFrame:
    rated = report.battery_report(samples.where("overhang_mm is not null"), limits)
    return rated.select(F.lit("battery").alias("section"), F.to_json(F.struct("*")).alias("json"))


@operation("measure_dimensions", ("surface",), "dimensional_measurement", optional=("comparison",), plan=TEXT, search=NUMBER | {"default": 2.0}, margin=NUMBER | {"default": 1.0})
def _measure_dimensions(spark: SparkSession, found: DataFrame, comparison: DataFrame | None, **given) -> DataFrame:
    """The characteristics of a plan, a JSON text whose elements tell where they should be (at, direction, radius, length),
    measured on the surface, or on the compared points if there are some, and rated."""
    doc = json.loads(given["plan"])
    keep = ("element", "kind", "cx", "cy", "cz", "dx", "dy", "dz", "radius", "form", "length", "worst")
    rows = [(e["id"], e["type"], *map(float, e.get("at", (0, 0, 0))), *map(float, e.get("direction", (0, 0, 1))), float(e.get("radius", 0)), 0.0, float(e.get("length", 1e9)), 0.0) for e in doc["elements"]]
    nominal = spark.createDataFrame(rows, "element string, kind string, " + ", ".join(f"{c} double" for c in keep[2:]))
    points = _centres(found) if comparison is None else comparison.select("x", "y", "z", "nx", "ny", "nz")
    taken = plan.extract_points(points, nominal, given["search"], given["margin"])
    fitted = dimensional.fit_elements(taken.select("element", "kind", "x", "y", "z"))
    worst = taken.groupBy("element").agg(F.max(F.abs("deviation")).alias("worst"))
    elements = fitted.join(worst, "element").join(nominal.select("element", "length"), "element").select(*keep)
    return evaluate.rate(plan.characteristic_values(plan.parse_plan(spark, doc), elements, nominal))


@operation("first_article_report", ("dimensional_measurement",), "report")
def _first_article(spark: SparkSession, rated: DataFrame) -> DataFrame:
    head = report.first_article(rated).select(F.lit("decision").alias("section"), F.to_json(F.struct("*")).alias("json"))
    return head.unionByName(rated.select(F.lit("characteristic").alias("section"), F.to_json(F.struct("*")).alias("json")))


@operation("report", ("dataset",), "report", optional=("porosity", "comparison", "materials", "fibre_orientation", "wall_thickness"), tolerance=NUMBER | {"default": 0.1}, min_wall=NUMBER | {"default": 0.0})
def _report(spark: SparkSession, dataset: DataFrame, pores: DataFrame | None, compared: DataFrame | None, labels: DataFrame | None, fibres: DataFrame | None, thickness: DataFrame | None, tolerance: float, min_wall: float) -> DataFrame:
    """(section, json): a row for each part of a report; what hasn't been made has none."""
    return report.sections(dataset, pores, compared, labels, fibres, thickness, tolerance, min_wall)


@operation("export_diconde", ("dataset",), "diconde", folder=PATH, pitch=NUMBER, series=TEXT)
def _export(spark: SparkSession, dataset: DataFrame, folder: str, pitch: float, series: str) -> DataFrame:
    nx, ny = dataset.agg(F.max("x") + 1, F.max("y") + 1).first()
    n = export.export_dicom(dataset, folder, nx, ny, pitch, series)
    return spark.createDataFrame([(folder, n)], "folder string, slices long")
