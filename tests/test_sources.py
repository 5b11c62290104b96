import gzip
import json
import struct
import zlib

import numpy as np
import pytest

from brickwise.sources import images, raw


def voxels(df, value="grey"):
    return {(r.x, r.y, r.z): r[value] for r in df.collect()}


@pytest.fixture
def volume():
    return np.random.default_rng(0).integers(0, 65536, (5, 4, 3)).astype(np.uint16)  # z, y, x


def expected(v):
    return {(x, y, z): int(v[z, y, x]) for z in range(5) for y in range(4) for x in range(3)}


@pytest.mark.parametrize("endian", ["little", "big"])
def test_raw_with_header(spark, tmp_path, volume, endian):
    path = tmp_path / "scan.raw"
    path.write_bytes(b"head" * 4 + volume.astype("<u2" if endian == "little" else ">u2").tobytes())
    df = raw.read_raw(spark, str(path), nx=3, ny=4, nz=5, endian=endian, slices=2)
    assert voxels(df) == expected(volume) and df.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="smaller"):
        raw.read_raw(spark, str(path), nx=30, ny=40, nz=50).count()


def test_raw_gzip_with_sidecar(spark, tmp_path, volume):
    with gzip.open(tmp_path / "scan.raw.gz", "wb") as f:
        f.write(volume.tobytes())
    (tmp_path / "scan.json").write_text(json.dumps({"nx": 3, "ny": 4, "nz": 5}))
    assert voxels(raw.read_raw(spark, str(tmp_path / "scan.raw.gz"))) == expected(volume)


def test_raw_written_and_read(spark, tmp_path, volume):
    rows = [(x, y, z, g) for (x, y, z), g in expected(volume).items()]
    raw.write_raw(spark.createDataFrame(rows, raw.SCHEMA), str(tmp_path / "out"), 3, 4)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").iterdir()))
    assert data == volume.tobytes()


def test_png_stack_in_natural_order(spark, tmp_path, volume):
    for z in range(5):
        (tmp_path / f"slice{z + 8}.png").write_bytes(images.encode_png(volume[z]))
    assert voxels(images.read_stack(spark, str(tmp_path), "png"), "value") == expected(volume)


def tiff(page, packing, predictor=1):
    body = page.astype("<u2")
    if predictor == 2:
        body = np.diff(body, axis=1, prepend=np.uint16(0)).astype("<u2")
    data = body.tobytes()
    if packing == 8:
        data = zlib.compress(data)
    elif packing == 32773:
        data = b"".join(bytes([len(data[k : k + 100]) - 1]) + data[k : k + 100] for k in range(0, len(data), 100))
    tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, 16), (259, 3, packing), (273, 4, 8), (277, 3, 1), (279, 4, len(data)), (317, 3, predictor)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + ifd


@pytest.mark.parametrize(("packing", "predictor"), [(1, 1), (8, 1), (8, 2), (32773, 1)])
def test_tiff_stack(spark, tmp_path, volume, packing, predictor):
    for z in range(5):
        (tmp_path / f"s{z + 9}.tif").write_bytes(tiff(volume[z], packing, predictor))
    assert voxels(images.read_stack(spark, str(tmp_path), "tiff"), "value") == expected(volume)


def test_lzw():
    codes = [256, 65, 66, 258, 260, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert images.unpack_lzw(data) == b"ABABABA"


def dicom(page, along, series):
    def tag(g, e, vr, body):
        body += b"\0" * (len(body) % 2)
        if vr in (b"OW",):
            return struct.pack("<HH", g, e) + vr + b"\0\0" + struct.pack("<I", len(body)) + body
        return struct.pack("<HH", g, e) + vr + struct.pack("<H", len(body)) + body

    us = lambda v: struct.pack("<H", v)
    return b"\0" * 128 + b"DICM" + tag(0x20, 0x0E, b"UI", series) + tag(0x20, 0x32, b"DS", f"0\\0\\{along}".encode()) + tag(0x28, 0x10, b"US", us(page.shape[0])) + tag(0x28, 0x11, b"US", us(page.shape[1])) + tag(0x7FE0, 0x10, b"OW", page.astype("<u2").tobytes())


def test_dicom_series(spark, tmp_path, volume):
    for z in range(5):
        (tmp_path / f"{9 - z}.dcm").write_bytes(dicom(volume[z], 0.5 * z, b"1.2.3"))
    (tmp_path / "other.dcm").write_bytes(dicom(volume[0], 7, b"1.2.4"))
    assert voxels(images.read_dicom(spark, str(tmp_path))) == expected(volume)


def test_stl(spark, tmp_path):
    t = np.random.default_rng(1).normal(size=(7, 3, 3)).astype(np.float32)
    (tmp_path / "a.stl").write_bytes(images.encode_stl(t))
    ascii_ = "solid x\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join("vertex %.9g %.9g %.9g\n" % tuple(v) for v in tri) + "endloop\nendfacet\n" for tri in t) + "endsolid\n"
    (tmp_path / "b.stl").write_text(ascii_)
    rows = images.read_stl(spark, str(tmp_path)).collect()
    for name in ("a.stl", "b.stl"):
        got = np.array(sorted(tuple(r)[1:] for r in rows if r.path.endswith(name)))
        assert np.allclose(got, np.array(sorted(map(tuple, t.reshape(-1, 9).tolist()))), atol=1e-6)
    with pytest.raises(ValueError):
        images.decode_stl(b"nothing")
