"""Raw volumes: a Spark data source that reads byte ranges of a file, slices at a time, and a writer."""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"uint8": "u1", "uint16": "u2"}
SCHEMA = "x int, y int, z int, grey int"
ARROW = pa.schema([("x", pa.int32()), ("y", pa.int32()), ("z", pa.int32()), ("grey", pa.int32())])


class Slab(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def slab_batch(values: np.ndarray, nx: int, ny: int, z: int) -> pa.RecordBatch:
    index = np.arange(len(values), dtype=np.int32)
    plane = nx * ny
    return pa.RecordBatch.from_arrays([pa.array(index % nx), pa.array(index // nx % ny), pa.array(z + index // plane), pa.array(values.astype(np.int32))], schema=ARROW)


class RawSource(DataSource):
    """format("brickwise.raw") with options path, nx, ny, nz, type (uint8, uint16), endian (little, big), header (bytes;
    default: what the file has beyond its voxels), slices (per partition). Gzip files are read forward in one partition."""

    @classmethod
    def name(cls) -> str:
        return "brickwise.raw"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RawReader(self.options)


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.n = [int(options[k]) for k in ("nx", "ny", "nz")]
        kind = options.get("type", "uint16")
        if kind not in KINDS or min(self.n) < 1:
            raise ValueError(f"raw volumes need type uint8 or uint16 and sizes of at least 1, not {kind} and {self.n}")
        self.dtype = np.dtype((">" if options.get("endian") == "big" else "<") + KINDS[kind])
        self.packed = self.path.endswith(".gz")
        voxels = int(np.prod(self.n)) * self.dtype.itemsize
        given = options.get("header")
        if given is None and self.packed:
            given = 0
        self.header = int(given) if given is not None else os.path.getsize(self.path) - voxels
        if self.header < 0 or (not self.packed and os.path.getsize(self.path) < self.header + voxels):
            raise ValueError(f"{self.path} is smaller than its {voxels} bytes of voxels")
        self.slices = int(options.get("slices", 16))

    def partitions(self) -> list[Slab]:
        step = self.n[2] if self.packed else self.slices
        return [Slab(z, min(z + step, self.n[2])) for z in range(0, self.n[2], step)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        nx, ny, _ = self.n
        plane = nx * ny * self.dtype.itemsize
        with (gzip.open if self.packed else open)(self.path, "rb") as f:
            f.seek(self.header + partition.first * plane)
            for z in range(partition.first, partition.last):
                data = f.read(plane)
                if len(data) < plane:
                    raise ValueError(f"{self.path} ends in slice {z}")
                yield slab_batch(np.frombuffer(data, self.dtype), nx, ny, z)


def read_raw(spark: SparkSession, path: str, **options) -> DataFrame:
    """A raw volume; sizes and pitch may come from a sidecar, scan.json beside scan.raw or scan.raw.gz."""
    side = path.removesuffix(".gz").rsplit(".", 1)[0] + ".json"
    if "nx" not in options and os.path.exists(side):
        with open(side) as f:
            options = json.load(f) | options
    spark.dataSource.register(RawSource)
    return spark.read.format("brickwise.raw").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def write_raw(voxels: DataFrame, folder: str, nx: int, ny: int, fill: int = 0) -> None:
    """One file z<slice>.raw of 16-bit little-endian values for each slice, written by the executors under another name
    and then renamed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = int(pdf["z"].iloc[0])
        plane = np.full((ny, nx), fill, dtype="<u2")
        plane[pdf["y"], pdf["x"]] = pdf["grey"]
        name = os.path.join(folder, f"z{z:06d}.raw")
        with open(name + ".part", "wb") as f:
            f.write(plane.tobytes())
        os.replace(name + ".part", name)
        return pdf[["z"]].head(1)

    os.makedirs(folder, exist_ok=True)
    voxels.groupBy("z").applyInPandas(run, "z int").count()
