"""Writers and readers of results: PLY meshes with vertex fields, DICOM slices, JSON and CSV tables."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PLY_TYPES = {"float": "<f4", "double": "<f8", "int": "<i4", "uint": "<u4", "uchar": "u1", "short": "<i2"}


def encode_ply(vertices: dict[str, np.ndarray], triangles: np.ndarray) -> bytes:
    """A binary PLY file: x, y, z and any further scalar fields as floats, and triangles."""
    n = len(vertices["x"])
    head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {n}\n" + "".join(f"property float {k}\n" for k in vertices) + f"element face {len(triangles)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = np.zeros(n, np.dtype([(k, "<f4") for k in vertices]))
    for k, v in vertices.items():
        rows[k] = v
    faces = np.zeros(len(triangles), np.dtype([("n", "u1"), ("v", "<i4", 3)]))
    faces["n"], faces["v"] = 3, triangles
    return head.encode() + rows.tobytes() + faces.tobytes()


def decode_ply(data: bytes) -> dict[str, np.ndarray]:
    """The vertex fields of a binary little-endian PLY file."""
    end = data.index(b"end_header\n") + len(b"end_header\n")
    lines = data[:end].decode("latin-1").splitlines()
    if lines[0] != "ply" or "format binary_little_endian 1.0" not in lines:
        raise ValueError("only binary little-endian PLY files are read")
    fields, count, element = [], 0, ""
    for line in lines:
        words = line.split()
        if words[0] == "element":
            element = words[1]
            count = int(words[2]) if element == "vertex" else count
        elif words[0] == "property" and element == "vertex":
            fields.append((words[2], PLY_TYPES[words[1]]))
    rows = np.frombuffer(data, np.dtype(fields), count, end)
    return {k: rows[k] for k, _ in fields}


def read_ply(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(path, fields ...) of the vertices of PLY files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = decode_ply(data)
                columns = [pa.array(v[f].astype(np.float64)) for f in fields]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.string()), *columns], names=["path", *fields])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{f} double" for f in fields))


def dicom_slice(image: np.ndarray, z: int, pitch: float, series: str, offset: float = 0.0, scale: float = 1.0) -> bytes:
    """An explicit little-endian DICOM file of one 16-bit slice."""

    def tag(group: int, element: int, vr: str, body: bytes) -> bytes:
        body += (b"\0" if vr == "UI" else b" ") * (len(body) % 2)
        head = struct.pack("<HH", group, element) + vr.encode()
        return head + (b"\0\0" + struct.pack("<I", len(body)) if vr in ("OW", "OB") else struct.pack("<H", len(body))) + body

    us = lambda v: struct.pack("<H", v)
    rows, columns = image.shape
    meta = tag(2, 0x10, "UI", b"1.2.840.10008.1.2.1")
    out = tag(8, 0x60, "CS", b"CT") + tag(0x20, 0x0E, "UI", series.encode()) + tag(0x20, 0x13, "IS", str(z + 1).encode())
    out += tag(0x20, 0x32, "DS", f"0\\0\\{z * pitch:.6g}".encode()) + tag(0x20, 0x37, "DS", b"1\\0\\0\\0\\1\\0")
    out += tag(0x28, 2, "US", us(1)) + tag(0x28, 0x10, "US", us(rows)) + tag(0x28, 0x11, "US", us(columns)) + tag(0x28, 0x30, "DS", f"{pitch:.6g}\\{pitch:.6g}".encode())
    out += tag(0x28, 0x100, "US", us(16)) + tag(0x28, 0x101, "US", us(16)) + tag(0x28, 0x102, "US", us(15)) + tag(0x28, 0x103, "US", us(0))
    out += tag(0x28, 0x1052, "DS", f"{offset:.6g}".encode()) + tag(0x28, 0x1053, "DS", f"{scale:.6g}".encode()) + tag(0x7FE0, 0x10, "OW", image.astype("<u2").tobytes())
    return b"\0" * 128 + b"DICM" + tag(2, 0, "UL", struct.pack("<I", len(meta))) + meta + out


def export_dicom(voxels: DataFrame, folder: str, nx: int, ny: int, pitch: float, series: str, fill: int = 0) -> int:
    """One file for each slice, written by the executors into a folder that they share with the driver; their number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = int(pdf["z"].iloc[0])
        plane = np.full((ny, nx), fill, dtype=np.uint16)
        plane[pdf["y"], pdf["x"]] = pdf["grey"]
        name = os.path.join(folder, f"slice{z:06d}.dcm")
        with open(name + ".part", "wb") as f:
            f.write(dicom_slice(plane, z, pitch, series))
        os.replace(name + ".part", name)
        return pdf[["z"]].head(1)

    os.makedirs(folder, exist_ok=True)
    return voxels.groupBy("z").applyInPandas(run, "z int").count()


def write_csv(df: DataFrame, folder: str) -> None:
    """A result table as CSV with a header; nested columns as JSON text."""
    from pyspark.sql import functions as F

    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(folder, header=True)
