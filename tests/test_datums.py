import gzip
import zipfile

import numpy as np
import pytest

from brickwise.operators.dimensional import datum_frame, reference_points
from brickwise.sources.archives import xml_elements, zip_members


def motion(a, shift):
    m = np.eye(4)
    m[:2, :2] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]
    m[:3, 3] = shift
    return m


def test_datum_frame():
    m = motion(0.3, [1, 2, 3])
    planes = [np.stack([m[:3, :3] @ p + m[:3, 3], m[:3, :3] @ n]) for p, n in (([5, 6, 0], [0, 0, 1]), ([0, 7, 8], [1, 0, 0]), ([3, 0, 9], [0, 1, 0]))]
    assert np.allclose(datum_frame(*planes) @ m, np.eye(4))
    with pytest.raises(ValueError):
        datum_frame(planes[0], planes[0], planes[2])


def test_reference_points():
    rng = np.random.default_rng(0)
    nominal, directions = rng.normal(size=(9, 3)) * 10, rng.normal(size=(9, 3))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    back = motion(-0.02, [0.1, 0.2, -0.1])
    actual = (nominal - back[:3, 3]) @ back[:3, :3]
    assert np.allclose(reference_points(nominal, actual, directions), back, atol=1e-8)
    with pytest.raises(ValueError):
        reference_points(nominal, actual, np.tile([0, 0, 1.0], (9, 1)))


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.dcm", b"1")
        z.writestr("note.txt", b"2")
    assert [(r.member, bytes(r.content)) for r in zip_members(spark, str(tmp_path), "*.dcm").collect()] == [("d/one.dcm", b"1")]
    (tmp_path / "p.xmlz").write_bytes(gzip.compress(b"<p><v id='1'>a</v><g><v id='2'/></g></p>"))
    got = xml_elements(spark, str(tmp_path / "p.xmlz"), "v").collect()
    assert [(r.place, r.attributes, r.text) for r in got] == [(0, {"id": "1"}, "a"), (1, {"id": "2"}, "")]
