"""What files tell beside their values: voxel sizes in TIFF tags, DICOM descriptions, XML projects, and the metadata of
stored volumes."""

from __future__ import annotations

import gzip
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators.graph import stage

#: Units of length in mm, as descriptions write them.
UNITS = {"nm": 1e-6, "um": 1e-3, "µm": 1e-3, "μm": 1e-3, "micron": 1e-3, "microns": 1e-3, "mm": 1.0, "cm": 10.0, "m": 1000.0, "inch": 25.4, "in": 25.4}


@dataclass
class Volume:
    """The metadata of a volume; lengths in mm, value = offset + scale * grey."""

    name: str = ""
    nx: int = 0
    ny: int = 0
    nz: int = 0
    pitch_x_mm: float = 1.0
    pitch_y_mm: float = 1.0
    pitch_z_mm: float = 1.0
    slice_thickness_mm: float | None = None
    threshold: float | None = None
    air_level: float | None = None
    value_offset: float = 0.0
    value_scale: float = 1.0

    @property
    def size(self) -> tuple[int, int, int]:
        return self.nx, self.ny, self.nz

    @property
    def voxel(self) -> tuple[float, float, float]:
        return self.pitch_x_mm, self.pitch_y_mm, self.pitch_z_mm


def write_volume(spark: SparkSession, volume: Volume, folder: str) -> None:
    """The metadata beside a volume's levels, through Spark, so that any path that it can write will do."""
    spark.createDataFrame([(json.dumps(asdict(volume)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/volume")


def read_volume(spark: SparkSession, folder: str) -> Volume:
    return Volume(**json.loads(spark.read.text(f"{folder}/volume").first()["value"]))


def tiff_tags(data: bytes) -> dict[int, object]:
    """The tags of the first page: numbers, ratios as floats, texts."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    (count,) = struct.unpack(order + "H", data[at : at + 2])
    sizes, out = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 12: 8}, {}
    for k in range(count):
        tag, kind, n, raw = struct.unpack(order + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
        if kind not in sizes:
            continue
        length = sizes[kind] * n
        start = struct.unpack(order + "I", raw)[0]
        body = raw[:length] if length <= 4 else data[start : start + length]
        if kind in (1, 2, 7):
            out[tag] = body.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else list(body)
        elif kind == 5:
            p = struct.unpack(f"{order}{2 * n}I", body)
            out[tag] = [a / b if b else 0.0 for a, b in zip(p[::2], p[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack(f"{order}{n}{ {3: 'H', 4: 'I', 12: 'd'}[kind] }", body))
    return out


def voxel_size(tags: dict[int, object]) -> tuple[float, float, float | None] | None:
    """(x, y, z) in mm from a page's tags, z None if it isn't told: OME-XML in the description, key = value lines, or the
    resolution in centimetres or inches, unless that is a print default. None if nothing tells."""
    text = tags.get(270, "") or ""
    if "PhysicalSizeX" in text:
        found = {}
        for c in "XYZ":
            m = re.search(rf'PhysicalSize{c}="([0-9.eE+-]+)"', text)
            u = re.search(rf'PhysicalSize{c}Unit="([^"]+)"', text)
            if m:
                found[c] = float(m[1]) * UNITS.get(u[1] if u else "um", 1e-3)
        if "X" in found and "Y" in found:
            return found["X"], found["Y"], found.get("Z")
    lines = dict(re.findall(r"^\s*([\w ]+?)\s*=\s*(.+?)\s*$", text, re.M))
    unit = UNITS.get(lines.get("unit", "mm").strip().lower().replace("\\u00b5", "µ"), 1.0)
    spacing = lines.get("spacing")
    res = {k: tags[t][0] for k, t in (("x", 282), ("y", 283)) if tags.get(t)}
    if {"voxel_size_x", "voxel_size_y"} <= set(lines):
        z = lines.get("voxel_size_z")
        return float(lines["voxel_size_x"]) * unit, float(lines["voxel_size_y"]) * unit, float(z) * unit if z else None
    if "unit" in lines and res.get("x") and res.get("y"):  # pixels by unit
        return unit / res["x"], unit / res["y"], float(spacing) * unit if spacing else None
    kind = (tags.get(296) or [2])[0]
    if not (res.get("x") and res.get("y")):
        return None
    if kind == 3:
        return 10 / res["x"], 10 / res["y"], None
    if kind == 2 and round(res["x"]) not in (72, 96, 150, 200, 300, 600):
        return 25.4 / res["x"], 25.4 / res["y"], None
    return None


def tiff_voxel_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, x_mm, y_mm, z_mm) of TIFF files, null where they don't tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [voxel_size(tiff_tags(d)) or (None, None, None) for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([s[k] for s in sizes], pa.float64()) for k in range(3)]], names=["path", "x_mm", "y_mm", "z_mm"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, x_mm double, y_mm double, z_mm double")


#: DICOM tags of an inspection, (group, element), by the name that they get.
INSPECTION_TAGS = {
    "component": (0x0010, 0x0010),
    "component_id": (0x0010, 0x0020),
    "modality": (0x0008, 0x0060),
    "manufacturer": (0x0008, 0x0070),
    "institution": (0x0008, 0x0080),
    "equipment": (0x0008, 0x1090),
    "inspected": (0x0008, 0x0020),
    "series": (0x0020, 0x000E),
    "description": (0x0008, 0x103E),
    "slope": (0x0028, 0x1053),
    "intercept": (0x0028, 0x1052),
    "spacing": (0x0028, 0x0030),
    "thickness": (0x0018, 0x0050),
}
LONG = (b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UN", b"UR", b"UT")


def dicom_texts(data: bytes) -> dict[str, str]:
    """The texts of the tags of an inspection in a file of explicit little-endian form; pixels aren't read."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    names, out, at = {v: k for k, v in INSPECTION_TAGS.items()}, {}, 132
    while at + 8 <= len(data):
        tag = struct.unpack("<HH", data[at : at + 4])
        kind = data[at + 4 : at + 6]
        if kind in LONG:
            (length,), start = struct.unpack("<I", data[at + 8 : at + 12]), at + 12
        else:
            (length,), start = struct.unpack("<H", data[at + 6 : at + 8]), at + 8
        if tag == (0x7FE0, 0x0010):
            break
        if length == 0xFFFFFFFF:
            end = data.find(b"\xfe\xff\xdd\xe0", start)
            at = len(data) if end < 0 else end + 8
            continue
        if tag in names:
            out[names[tag]] = data[start : start + length].decode("utf-8", "replace").strip(" \0")
        at = start + length
    return out


def read_inspection(spark: SparkSession, path: str) -> DataFrame:
    """(path, info) of DICOM files, info a map of what describes component, equipment, inspection and scaling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(dicom_texts(d).items()) for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.map_(pa.string(), pa.string()))], names=["path", "info"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dcm").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, info map<string,string>")


def rescaled(voxels: DataFrame, info: dict[str, str]) -> DataFrame:
    """voxels with value, by the slope and intercept that the files tell."""
    return voxels.withColumn("value", F.col("grey") * float(info.get("slope") or 1) + float(info.get("intercept") or 0))


def xml_volumes(data: bytes) -> list[dict]:
    """The volumes of a gzipped XML project: name, file, dims, voxel size, type and the 4x4 transform, the identity if
    none is given."""
    root = ElementTree.fromstring(gzip.decompress(data))
    out = []
    for e in root.iter():
        if e.tag.rsplit("}", 1)[-1].lower() != "volume":
            continue
        child = {c.tag.rsplit("}", 1)[-1].lower(): (c.text or "").strip() for c in e.iter()}
        get = lambda *names: next((v for n in names for v in (e.get(n), child.get(n.lower())) if v), None)
        numbers = lambda t: [float(x) for x in re.split(r"[\s,;x]+", t.strip()) if x]
        matrix = numbers(get("transform", "matrix") or "")
        out.append({
            "name": get("name"), "file": get("file", "path", "filename"), "type": get("type", "datatype") or "uint16",
            "dims": [int(v) for v in numbers(get("dims", "size") or "")], "voxel_mm": numbers(get("voxelsize", "spacing") or ""),
            "transform": matrix if len(matrix) == 16 else [float(r == c) for r in range(4) for c in range(4)],
        })
    return out


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, name, file, type, dims, voxel_mm, transform) of the volumes of gzipped XML projects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        names = ["name", "file", "type", "dims", "voxel_mm", "transform"]
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = xml_volumes(data)
                columns = [pa.array([v[n] for v in found], k) for n, k in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), *columns], names=["path", "place", *names])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, place int, name string, file string, type string, dims array<long>, voxel_mm array<double>, transform array<double>")


def staged(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A slow source copied once to the shared folder, and its histogram, from the copy."""
    from brickwise.operators.histogram import grey_histogram

    copy = stage(source, "source")
    return copy, grey_histogram(copy)


def preview_rounds(voxels: DataFrame, nz: int, slices: int = 64, rounds: int = 3, stride: int = 4) -> Iterator[DataFrame]:
    """Previews from coarse to fine: strided means of evenly spread slices, each round twice as dense as the one before."""
    from brickwise.operators.derived import preview

    for k in range(rounds):
        share = 2 ** (rounds - 1 - k)
        yield preview(voxels, nz, max(1, slices // share), stride * share)


#: The files of a result by its kind, and the columns that each must have.
ARTIFACTS = {
    "materials": ("x", "y", "z", "material"),
    "surface": tuple(f"{c}{k}" for k in (1, 2, 3) for c in "xyz"),
    "porosity": ("component", "n", "volume_mm3"),
}


def open_artifact(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """A stored result of a kind, its columns checked."""
    if kind not in ARTIFACTS:
        raise ValueError(f"no artifact {kind!r}")
    df = spark.read.parquet(folder)
    missing = set(ARTIFACTS[kind]) - set(df.columns)
    if missing:
        raise ValueError(f"{folder} is no {kind}: {sorted(missing)[0]!r} is missing")
    return df
