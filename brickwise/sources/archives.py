"""Members of ZIP archives and gzipped XML projects, read without extraction."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def zip_members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(archive, member, content) of the files in ZIP archives whose names match; checksums are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for info in z.infolist():
                        if not info.is_dir() and fnmatch(info.filename, pattern):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([info.filename]), pa.array([z.read(info)], pa.binary())], names=["archive", "member", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInArrow(run, "archive string, member string, content binary")


def xml_elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(path, place, attributes, text) of the elements with a tag in gzipped XML files, in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list(ElementTree.fromstring(gzip.decompress(data)).iter(tag))
                columns = [pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([list(e.attrib.items()) for e in found], kind), pa.array([(e.text or "").strip() for e in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "place", "attributes", "text"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, place int, attributes map<string,string>, text string")
