"""Named operations with checked parameters and typed ports, and projects that record their steps."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators import blocks, components, decide, filters, histogram, inspect, levelset, materials, mixture, noise, shape, surface, walls
from brickwise.operators.graph import stage
from brickwise.sources import images, metadata, raw, store

TYPES = {"integer": int, "number": (int, float), "string": str, "boolean": bool, "array": list, "object": dict}


@dataclass
class Operation:
    """A name, a JSON schema of parameters, the artifact types that it takes and makes, and what it does."""

    name: str
    parameters: dict
    inputs: tuple[str, ...]
    output: str
    run: Callable[..., DataFrame]
    optional: tuple[str, ...] = ()

    def check(self, given: dict) -> dict:
        """The parameters with defaults filled in; unknown names, wrong types, values out of range and missing ones raise."""
        unknown = set(given) - set(self.parameters)
        if unknown:
            raise ValueError(f"{self.name}: unknown parameter {sorted(unknown)[0]!r}")
        out = {}
        for name, rule in self.parameters.items():
            if name not in given:
                if "default" not in rule:
                    raise ValueError(f"{self.name}: parameter {name!r} is required")
                out[name] = rule["default"]
                continue
            v = given[name]
            if not isinstance(v, TYPES[rule["type"]]) or (isinstance(v, bool) and rule["type"] != "boolean"):
                raise ValueError(f"{self.name}: parameter {name!r} must be of type {rule['type']}")
            if "enum" in rule and v not in rule["enum"]:
                raise ValueError(f"{self.name}: parameter {name!r} must be one of {rule['enum']}")
            if ("minimum" in rule and v < rule["minimum"]) or ("maximum" in rule and v > rule["maximum"]):
                raise ValueError(f"{self.name}: parameter {name!r} is out of range")
            out[name] = v
        return out


OPERATIONS: dict[str, Operation] = {}


def operation(name: str, inputs: tuple[str, ...], output: str, optional: tuple[str, ...] = (), **parameters: dict):
    """Register a function of (spark, inputs, optional inputs or None, parameters)."""

    def add(f):
        OPERATIONS[name] = Operation(name, parameters, inputs, output, f, optional)
        return f

    return add


NUMBER = {"type": "number"}
PATH = {"type": "string"}


#: By operation, what tells the metadata of the volume that it brings: a function of (spark, parameters) that returns a Volume or None.
DESCRIBE: dict[str, Callable[[SparkSession, dict], metadata.Volume | None]] = {}


@operation("open_dataset", (), "dataset", path=PATH, level={"type": "integer", "minimum": 0, "default": 0}, low={"type": "array", "default": []}, high={"type": "array", "default": []})
def _open(spark: SparkSession, path: str, level: int, low: list, high: list) -> DataFrame:
    """A folder of voxels, or a stored volume, of which a level or a box from low to before high can be asked for; the rest stays unread."""
    if not store.holds_volume(spark, path):
        if level or low or high:
            raise ValueError(f"open_dataset: {path} is no stored volume, so it has no levels and boxes")
        return spark.read.parquet(path)
    if len(low) != len(high) or len(low) not in (0, 3):
        raise ValueError("open_dataset: low and high are three numbers each")
    return store.open_volume(spark, path).voxels(level, tuple(low) or None, tuple(high) or None)


def _stored(spark: SparkSession, given: dict) -> metadata.Volume | None:
    if not store.holds_volume(spark, given["path"]):
        return None
    v, share = store.open_volume(spark, given["path"]).volume, 2 ** given["level"]
    return replace(v, pitch_x_mm=v.pitch_x_mm * share, pitch_y_mm=v.pitch_y_mm * share, pitch_z_mm=v.pitch_z_mm * share)


DESCRIBE["open_dataset"] = _stored


@operation("store_volume", ("dataset",), "stored", folder=PATH, levels={"type": "integer", "minimum": 0, "maximum": 12, "default": 3}, pitch={"type": "array", "default": [1.0, 1.0, 1.0]}, title={"type": "string", "default": ""})
def _store(spark: SparkSession, dataset: DataFrame, folder: str, levels: int, pitch: list, title: str) -> DataFrame:
    """The dataset as a stored volume with its levels; one row that says where."""
    size = [int(n) for n in dataset.agg(*[F.coalesce(F.max(c) + 1, F.lit(0)) for c in "xyz"]).first()]
    store.write(dataset, metadata.Volume(title, *size, *map(float, pitch)), folder, levels)
    return spark.createDataFrame([(folder, levels)], "folder string, levels int")


@operation("import_raw", (), "dataset", path=PATH, dims={"type": "array"}, type={"type": "string", "enum": ["uint8", "uint16"], "default": "uint16"})
def _import_raw(spark: SparkSession, path: str, dims: list, type: str) -> DataFrame:
    return raw.read_raw(spark, path, nx=dims[0], ny=dims[1], nz=dims[2], type=type)


@operation("import_tiff", (), "dataset", path=PATH)
def _import_tiff(spark: SparkSession, path: str) -> DataFrame:
    return images.read_stack(spark, path, "tiff").select("x", "y", "z", F.col("value").cast("int").alias("grey"))


def _tiff(spark: SparkSession, given: dict) -> metadata.Volume | None:
    """The voxel sizes that the first file which has some tells; without a z they are those of x."""
    row = metadata.tiff_voxel_sizes(spark, given["path"]).where("x_mm is not null").agg(F.min_by(F.struct("x_mm", "y_mm", "z_mm"), "path").alias("v")).first()["v"]
    return None if row is None else metadata.Volume("", pitch_x_mm=row["x_mm"], pitch_y_mm=row["y_mm"], pitch_z_mm=row["z_mm"] or row["x_mm"])


DESCRIBE["import_tiff"] = _tiff


@operation("import_png", (), "dataset", path=PATH)
def _import_png(spark: SparkSession, path: str) -> DataFrame:
    return images.read_stack(spark, path, "png").select("x", "y", "z", F.col("value").cast("int").alias("grey"))


@operation("import_dicom", (), "dataset", path=PATH, rescale={"type": "boolean", "default": False})
def _import_dicom(spark: SparkSession, path: str, rescale: bool) -> DataFrame:
    """Stored values as grey; with rescale a column value has what the files' slope and intercept make of them."""
    found = images.read_dicom(spark, path)
    if not rescale:
        return found
    first = metadata.read_inspection(spark, path).agg(F.min_by("info", "path").alias("info")).first()["info"]
    return metadata.rescaled(found, first or {})


def _dicom(spark: SparkSession, given: dict) -> metadata.Volume | None:
    """Slope and intercept as the files tell them, the first file's."""
    info = metadata.read_inspection(spark, given["path"]).agg(F.min_by("info", "path").alias("info")).first()["info"]
    return None if info is None else metadata.Volume(info.get("component", ""), value_scale=float(info.get("slope") or 1), value_offset=float(info.get("intercept") or 0))


DESCRIBE["import_dicom"] = _dicom


@operation("add_mesh", (), "mesh", path=PATH)
def _add_mesh(spark: SparkSession, path: str) -> DataFrame:
    return images.read_stl(spark, path)


def _threshold(dataset: DataFrame, threshold: float) -> float:
    if threshold > 0:
        return threshold
    return float(histogram.otsu(histogram.grey_histogram(dataset)).first()["threshold"])


@operation("sieve", ("dataset",), "dataset", size={"type": "integer", "minimum": 0, "default": 0}, dims={"type": "array", "default": []}, threshold=NUMBER | {"default": 0}, margin={"type": "integer", "minimum": 0, "maximum": 64, "default": 3})
def _sieve(spark: SparkSession, dataset: DataFrame, size: int, dims: list, threshold: float, margin: int) -> DataFrame:
    """dims are the volume's sizes along its axes, or size that of a cube; else they are read from the voxels."""
    if len(dims) not in (0, 3):
        raise ValueError("sieve: dims are three numbers")
    sizes = tuple(dims) or ((size,) * 3 if size else tuple(dataset.agg(*[F.max(c) + 1 for c in "xyz"]).first()))
    return blocks.sieve(dataset, _threshold(dataset, threshold), sizes, margin)


@operation("porosity", ("dataset",), "porosity", threshold=NUMBER | {"default": 0}, min_pore_voxels={"type": "integer", "minimum": 1, "default": 3}, pitch={"type": "array", "default": [1.0, 1.0, 1.0]}, zone_void=NUMBER | {"default": 0.01}, zone_sigma=NUMBER | {"default": 5.0}, min_zone_blocks={"type": "integer", "minimum": 1, "default": 2})
def _porosity(spark: SparkSession, dataset: DataFrame, threshold: float, min_pore_voxels: int, pitch: list, zone_void: float, zone_sigma: float, min_zone_blocks: int) -> DataFrame:
    """The pores of the whole analysis, with volumes by grey values, shapes and places. pitch: a voxel's sizes in mm. The volume's
    sizes are read from its voxels."""
    size = tuple(dataset.agg(*[F.max(c) + 1 for c in "xyz"]).first())
    return inspect.analyse(dataset, size, tuple(map(float, pitch)), threshold if threshold > 0 else None, min_pore_voxels, zone_void, zone_sigma, min_zone_blocks).pores


@operation("segment_materials", ("dataset",), "materials", threshold=NUMBER | {"default": 0}, cuts={"type": "array", "default": []}, classes={"type": "integer", "minimum": 1, "maximum": 8, "default": 1}, min_neighbours={"type": "integer", "minimum": 1, "maximum": 27, "default": 6})
def _segment(spark: SparkSession, dataset: DataFrame, threshold: float, cuts: list, classes: int, min_neighbours: int) -> DataFrame:
    """Without cuts, those between so many classes of material: valleys between clear peaks, or multi-Otsu's."""
    t = _threshold(dataset, threshold)
    if not cuts and classes > 1:
        cuts = decide.material_cuts(decide.counts_of(histogram.grey_histogram(dataset)), t, classes)
    return materials.segment(dataset, t, cuts, min_neighbours)


@operation("suggest_materials", ("dataset",), "suggestion")
def _suggest(spark: SparkSession, dataset: DataFrame) -> DataFrame:
    return mixture.suggest_mixture(histogram.grey_histogram(dataset))


@operation("measure_objects", ("materials",), "measurements", pitch=NUMBER | {"default": 1.0}, min_voxels={"type": "integer", "minimum": 1, "default": 1})
def _measure(spark: SparkSession, dataset: DataFrame, pitch: float, min_voxels: int) -> DataFrame:
    return materials.measure(components.components(dataset, 6, "material"), pitch, min_voxels)


@operation("denoise", ("dataset",), "dataset", sigma=NUMBER | {"default": 0}, strength=NUMBER | {"default": 1.0}, search={"type": "integer", "minimum": 1, "maximum": 5, "default": 3})
def _denoise(spark: SparkSession, dataset: DataFrame, sigma: float, strength: float, search: int) -> DataFrame:
    """A sigma of 0 is measured, from blocks above Otsu's threshold."""
    if not sigma:
        row = noise.noise_model(dataset, _threshold(dataset, 0)).first()
        if row is None:
            raise ValueError("denoise: no block of the part tells the noise; give sigma")
        sigma = row["sigma"]
    got = filters.non_local_means(dataset, sigma, strength, search)
    return got.select("x", "y", "z", F.floor(F.col("value") + 0.5).cast("int").alias("grey"))


@operation("fibre_orientation", ("dataset",), "fibre_orientation", block={"type": "integer", "minimum": 2, "default": 16}, families={"type": "integer", "minimum": 1, "maximum": 8, "default": 1})
def _fibres(spark: SparkSession, dataset: DataFrame, block: int, families: int) -> DataFrame:
    """Directions by block, each with the family of near directions that it belongs to, 0 the largest."""
    found = stage(filters.fibre_directions(filters.structure_tensors(dataset, block), max(1, block**3 // 4)), "fibres")
    return shape.direction_families(found, families)


@operation("surface", ("dataset",), "surface", iso=NUMBER, fill=NUMBER | {"default": 0.0})
def _surface(spark: SparkSession, dataset: DataFrame, iso: float, fill: float) -> DataFrame:
    return surface.extract_surface(dataset, iso, fill=fill)


@operation("wall_thickness", ("dataset",), "wall_thickness", threshold=NUMBER | {"default": 0}, method={"type": "string", "enum": ["ray", "sphere", "map"], "default": "ray"}, pitch=NUMBER | {"default": 1.0}, most=NUMBER | {"default": 16.0}, radius={"type": "integer", "minimum": 1, "maximum": 32, "default": 8}, fill=NUMBER | {"default": 0.0})
def _thickness(spark: SparkSession, dataset: DataFrame, threshold: float, method: str, pitch: float, most: float, radius: int, fill: float) -> DataFrame:
    """At the surface's points by ray or sphere, up to `most` voxels; or of every voxel, as a map of balls up to a radius."""
    t = _threshold(dataset, threshold)
    if method == "map":
        return filters.thickness_map(dataset.where(F.col("grey") >= t), radius)
    return walls.wall_thickness(dataset, t, pitch, method, most, fill=fill)


@operation("surface_codes", ("dataset",), "surface_codes", iso=NUMBER, band=NUMBER | {"default": 3.0}, bits={"type": "integer", "enum": [8, 16], "default": 8}, fill=NUMBER | {"default": 0.0})
def _codes(spark: SparkSession, dataset: DataFrame, iso: float, band: float, bits: int, fill: float) -> DataFrame:
    return levelset.surface_codes(dataset, iso, band, bits, fill=fill)


@operation("surface_of_codes", ("surface_codes",), "surface", band=NUMBER | {"default": 3.0}, bits={"type": "integer", "enum": [8, 16], "default": 8})
def _surface_of_codes(spark: SparkSession, codes: DataFrame, band: float, bits: int) -> DataFrame:
    return levelset.surface_of_codes(codes, band, bits)


@operation("isolate_part", ("dataset",), "dataset", threshold=NUMBER | {"default": 0}, keep={"type": "integer", "minimum": 1, "default": 1})
def _isolate(spark: SparkSession, dataset: DataFrame, threshold: float, keep: int) -> DataFrame:
    part = components.keep_largest(components.components(dataset.where(F.col("grey") > _threshold(dataset, threshold)), 6), keep)
    return dataset.join(part.select("x", "y", "z"), ["x", "y", "z"], "left_semi")


@dataclass
class Project:
    """Recorded steps in a folder: project.json holds the log and a cursor, each result is a Parquet folder. Undo moves
    the cursor back, a new step drops what was undone. A failed step is recorded and makes no result."""

    spark: SparkSession
    folder: str
    steps: list[dict] = field(default_factory=list)
    cursor: int = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Project:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, "project.json")
        if not os.path.exists(path):
            return cls(spark, folder)
        with open(path) as f:
            log = json.load(f)
        return cls(spark, folder, log["steps"], log["cursor"])

    def save(self) -> None:
        path = os.path.join(self.folder, "project.json")
        with open(path + ".part", "w") as f:
            json.dump({"steps": self.steps, "cursor": self.cursor}, f, indent=1)
        os.replace(path + ".part", path)

    def latest(self, kind: str) -> dict | None:
        """The newest finished step before the cursor that made such an artifact."""
        return next((s for s in reversed(self.steps[: self.cursor]) if s["status"] == "done" and s["output"] == kind), None)

    def result(self, step: dict) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"step{step['id']}"))

    def run(self, name: str, parameters: dict | None = None, inputs: dict[str, int] | None = None) -> dict:
        """Check, wire, log and execute an operation; inputs name steps by id, else the newest artifact of a type is taken."""
        if name not in OPERATIONS:
            raise KeyError(f"no operation {name!r}")
        op = OPERATIONS[name]
        checked = op.check(parameters or {})
        wired = {}
        for kind in op.inputs:
            asked = (inputs or {}).get(kind)
            step = self.latest(kind) if asked is None else next((s for s in self.steps[: self.cursor] if s["id"] == asked and s["output"] == kind and s["status"] == "done"), None)
            if step is None:
                raise ValueError(f"{name}: no {kind} to work on")
            wired[kind] = step
        for kind in op.optional:
            asked = (inputs or {}).get(kind)
            step = self.latest(kind) if asked is None else next((s for s in self.steps[: self.cursor] if s["id"] == asked and s["output"] == kind and s["status"] == "done"), None)
            if step is not None:
                wired[kind] = step
        volume = next((s["volume"] for s in wired.values() if s.get("volume")), None)
        if volume and "pitch" in op.parameters and "pitch" not in (parameters or {}):
            checked["pitch"] = self._pitch(name, volume, op.parameters["pitch"]["type"])
        del self.steps[self.cursor :]
        number = 1 + max((s["id"] for s in self.steps), default=0)
        step = {"id": number, "operation": name, "parameters": checked, "inputs": {k: s["id"] for k, s in wired.items()}, "output": op.output, "status": "running", "started": datetime.now(UTC).isoformat(timespec="seconds")}
        self.steps.append(step)
        self.cursor = len(self.steps)
        self.save()
        try:
            given = [self.result(wired[k]) if k in wired else None for k in (*op.inputs, *op.optional)]
            df = op.run(self.spark, *given, **checked)
            df.write.mode("overwrite").parquet(os.path.join(self.folder, f"step{number}"))
            if name in DESCRIBE:
                told = DESCRIBE[name](self.spark, checked)
                volume = None if told is None else asdict(told)
            if volume:
                step["volume"] = volume
            step["status"] = "done"
        except Exception as e:
            step |= {"status": "failed", "error": str(e)[:500]}
            raise
        finally:
            self.save()
        return step

    @staticmethod
    def _pitch(name: str, volume: dict, kind: str) -> list[float] | float:
        """The voxel sizes that the input's volume has, for an operation that wasn't given any."""
        pitch = [volume[f"pitch_{c}_mm"] for c in "xyz"]
        if kind == "array":
            return pitch
        if max(pitch) - min(pitch) > 1e-9 * max(pitch):
            raise ValueError(f"{name}: voxels of {pitch} mm have no one pitch; give it")
        return pitch[0]

    def undo(self) -> None:
        self.cursor = max(0, self.cursor - 1)
        self.save()

    def redo(self) -> None:
        self.cursor = min(len(self.steps), self.cursor + 1)
        self.save()


from brickwise.plans import operations  # noqa: E402, F401  (registers the rest)
