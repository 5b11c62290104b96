"""Slice images and meshes in binary files: PNG, TIFF, STL and a minimal DICOM reader. Files are read by Spark's
binaryFile source, so any file system will do, and decoded by the executors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from brickwise.functions.keys import natural_key


def decode_png(data: bytes) -> np.ndarray:
    """A grey PNG of 8 or 16 bits without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
    width, height, depth, colour, _, _, interlace = head
    if colour != 0 or depth not in (8, 16) or interlace:
        raise ValueError("only grey PNG files of 8 or 16 bits are read")
    step = depth // 8
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), dtype=np.uint8)
    above = np.zeros(width * step, dtype=np.int32)
    for y in range(height):
        filt, line = rows[y, 0], rows[y, 1:].astype(np.int32)
        if filt == 2:
            line = (line + above) & 255
        elif filt == 1:
            line = np.concatenate([np.cumsum(line[k::step])[:, None] for k in range(step)], 1).ravel() & 255
        elif filt in (3, 4):
            for i in range(len(line)):
                a = line[i - step] if i >= step else 0
                b, c = above[i], above[i - step] if i >= step else 0
                if filt == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                line[i] = (line[i] + guess) & 255
        out[y], above = line, line
    return out.view(">u2").astype(np.uint16) if step == 2 else out


def encode_png(image: np.ndarray) -> bytes:
    """A grey PNG of 8 or 16 bits, unfiltered."""
    depth = 16 if image.dtype.itemsize == 2 else 8
    raw = image.astype(">u2" if depth == 16 else np.uint8)
    lines = np.zeros((image.shape[0], 1 + raw[0].nbytes), dtype=np.uint8)
    lines[:, 1:] = raw.view(np.uint8).reshape(image.shape[0], -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """The TIFF kind: codes most significant bit first, widths growing one code early."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code = (held >> bits) & ((1 << width) - 1)
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None:
                table.append(last + entry[:1])
            last = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def decode_tiff(data: bytes) -> list[np.ndarray]:
    """The pages of a classic TIFF: grey strips of 8, 16 or 32 bits or floats; uncompressed, LZW, deflate or PackBits, with
    or without the horizontal predictor."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None or struct.unpack(end + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    (at,) = struct.unpack(end + "I", data[4:8])
    sizes = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}
    pages = []
    while at:
        (count,) = struct.unpack(end + "H", data[at : at + 2])
        tags = {}
        for k in range(count):
            e = data[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, n = struct.unpack(end + "HHI", e[:8])
            if kind not in sizes or kind == 2:
                continue
            size = struct.calcsize(sizes[kind]) * n
            body = e[8 : 8 + size] if size <= 4 else data[struct.unpack(end + "I", e[8:])[0] :][:size]
            tags[tag] = struct.unpack(f"{end}{n}{sizes[kind]}", body)
        width, height, bits = tags[256][0], tags[257][0], tags.get(258, (8,))[0]
        packing, predictor, form = tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(339, (1,))[0]
        unpack = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}
        if packing not in unpack or tags.get(277, (1,))[0] != 1:
            raise ValueError(f"a TIFF page with compression {packing} or several samples isn't read")
        dtype = np.dtype(end + ("f" if form == 3 else "u") + str(bits // 8))
        raw = b"".join(unpack[packing](data[o : o + c]) for o, c in zip(tags[273], tags[279], strict=True))
        image = np.frombuffer(raw, dtype)[: width * height].reshape(height, width).astype(dtype.newbyteorder("="))
        pages.append(np.cumsum(image, axis=1, dtype=image.dtype) if predictor == 2 else image)
        (at,) = struct.unpack(end + "I", data[at + 2 + 12 * count :][:4])
    return pages


def decode_dicom(data: bytes) -> dict:
    """Explicit little-endian DICOM: the tags needed to stack slices, and the pixels with rescale applied."""
    at = 132 if data[128:132] == b"DICM" else 0
    tags: dict[tuple[int, int], bytes] = {}
    while at + 8 <= len(data):
        group, element = struct.unpack("<HH", data[at : at + 4])
        vr = data[at + 4 : at + 6]
        if vr in (b"OB", b"OW", b"SQ", b"UN", b"UT", b"OF"):
            (size,) = struct.unpack("<I", data[at + 8 : at + 12])
            at += 12
        else:
            (size,) = struct.unpack("<H", data[at + 6 : at + 8])
            at += 8
        if size == 0xFFFFFFFF:
            raise ValueError("sequences and pixels of undefined length aren't read")
        tags[group, element] = data[at : at + size]
        at += size
    text = lambda g, e, default="": tags.get((g, e), default.encode()).decode("latin-1").strip("\0 ")
    number = lambda g, e: struct.unpack("<H", tags[g, e][:2])[0]
    rows, columns = number(0x28, 0x10), number(0x28, 0x11)
    signed = (0x28, 0x103) in tags and number(0x28, 0x103) == 1
    pixels = np.frombuffer(tags[0x7FE0, 0x10], "<i2" if signed else "<u2")[: rows * columns].reshape(rows, columns).astype(np.int32)
    place = [float(v) for v in text(0x20, 0x32, "0\\0\\0").split("\\")]
    turn = [float(v) for v in text(0x20, 0x37, "1\\0\\0\\0\\1\\0").split("\\")]
    normal = np.cross(turn[:3], turn[3:])
    return {"series": text(0x20, 0x0E), "along": float(np.dot(normal, place)), "pixels": pixels + (32768 if signed else 0), "slope": float(text(0x28, 0x1053, "1") or 1), "intercept": float(text(0x28, 0x1052, "0") or 0)}


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def _rows(image: np.ndarray, z: int) -> pa.RecordBatch:
    y, x = np.indices(image.shape)
    names = ["x", "y", "z", "value"]
    return pa.RecordBatch.from_arrays([pa.array(x.ravel().astype(np.int32)), pa.array(y.ravel().astype(np.int32)), pa.array(np.full(image.size, z, np.int32)), pa.array(image.ravel().astype(np.float64))], names=names)


def read_stack(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(x, y, z, value) of a folder of png or tiff slices in natural order; the pages of a file follow one another. File
    names, not contents, are ranked to find each slice's place."""
    files = _files(spark, path, {"png": "*.png", "tiff": "*.tif*"}[kind])
    decode = {"png": lambda d: [decode_png(d)], "tiff": decode_tiff}[kind]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [len(decode(d)) for d in b.column(1).to_pylist()] if kind == "tiff" else [1] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32())], names=["path", "pages"])

    sized = files.select("path", "content").mapInArrow(pages, "path string, pages int")
    w = Window.orderBy(natural_key(F.col("path"))).rowsBetween(Window.unboundedPreceding, -1)
    first = sized.select("path", F.coalesce(F.sum("pages").over(w), F.lit(0)).cast("int").alias("first"))

    def voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from (_rows(image, z + k) for k, image in enumerate(decode(data)))

    return files.join(first, "path").select("content", "first").mapInArrow(voxels, "x int, y int, z int, value double")


def read_dicom(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z, grey) of the largest series of a folder, its slices sorted along their normal. Grey values are stored
    ones; metadata.read_inspection tells the slope and intercept that make values of them."""
    files = _files(spark, path, "*.dcm")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode_dicom(d) for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f["series"] for f in found]), pa.array([f["along"] for f in found])], names=["path", "series", "along"])

    index = files.select("path", "content").mapInArrow(heads, "path string, series string, along double")
    largest = index.groupBy("series").agg(F.count("*").alias("n")).agg(F.max_by("series", F.struct("n", "series")).alias("series"))
    place = index.join(F.broadcast(largest), "series").select("path", (F.row_number().over(Window.orderBy("along", "path")) - 1).alias("z"))

    def voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield _rows(decode_dicom(data)["pixels"], z)

    return files.join(place, "path").select("content", "z").mapInArrow(voxels, "x int, y int, z int, value double").select("x", "y", "z", F.col("value").cast("int").alias("grey"))


STL = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("extra", "<u2")])


def decode_stl(data: bytes) -> np.ndarray:
    """Triangles (n, 3, 3) of a binary or ASCII STL file."""
    if len(data) >= 84:
        (n,) = struct.unpack("<I", data[80:84])
        if len(data) == 84 + n * STL.itemsize:
            return np.frombuffer(data, STL, n, 84)["corners"].astype(np.float64)
    numbers = [line.split()[1:4] for line in data.decode("latin-1").splitlines() if line.strip().startswith("vertex")]
    if not numbers or len(numbers) % 3:
        raise ValueError("not an STL file")
    return np.array(numbers, dtype=np.float64).reshape(-1, 3, 3)


def encode_stl(triangles: np.ndarray) -> bytes:
    rows = np.zeros(len(triangles), STL)
    rows["corners"] = triangles
    return b"\0" * 80 + struct.pack("<I", len(triangles)) + rows.tobytes()


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """(path, x1 .. z3) of the triangles of all STL files of a folder or of one file."""
    names = [f"{c}{k}" for k in (1, 2, 3) for c in "xyz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = decode_stl(data).reshape(-1, 9)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(t), pa.string()), *[pa.array(t[:, k]) for k in range(9)]], names=["path", *names])

    return _files(spark, path, "*.stl").select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{n} double" for n in names))
