import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.operators import bricks, report, shape, synthetic
from brickwise.plans.registry import OPERATIONS, Project
from brickwise.sources.images import encode_stl

#: The operations that a user can name.
NAMES = """open_dataset import_raw import_tiff import_dicom import_gzipped_xml porosity fibre_orientation battery_inspection battery_images surface compare_cad
wall_thickness inspection_regions report segment_materials material_meshes measure_objects segment_model denoise beam_hardening isolate_part add_mesh move
align_points align_surfaces compare_objects measure_dimensions first_article_report battery_report export_diconde""".split()
from tests.test_compare import box_mesh


def test_every_operation_is_registered():
    assert len(NAMES) == 30 and set(NAMES) <= set(OPERATIONS)


@pytest.fixture
def box(spark, tmp_path):
    """A project with a box of 10 x 8 x 6 voxels' half sizes, its surface and its design."""
    p = Project.open(spark, str(tmp_path / "project"))
    scan = synthetic.Scan(synthetic.box((2.5, 2.0, 1.5)), size=32, pitch=0.25)
    bricks.unpack(synthetic.scan(spark, scan)).write.parquet(str(tmp_path / "volume"))
    p.run("open_dataset", {"path": str(tmp_path / "volume")})
    p.run("surface", {"iso": 10500.0, "fill": 1000.0})
    half = np.array([10.0, 8.0, 6.0])
    t = box_mesh(2 * half) + 15.5 - half
    (tmp_path / "stl").mkdir()
    (tmp_path / "stl" / "box.stl").write_bytes(encode_stl(t))
    p.run("add_mesh", {"path": str(tmp_path / "stl")})
    return p


def test_comparison_alignment_and_dimensions(spark, box):
    distance = box.result(box.run("compare_objects")).agg(F.max(F.abs("distance"))).first()[0]
    assert distance < 0.6
    pose = box.result(box.run("align_surfaces", {"coarse": False})).first()["matrix"]
    assert np.allclose(np.reshape(pose, (4, 4)), np.eye(4), atol=0.1)
    pose = box.result(box.run("align_points", {"pairs": [[0, 0, 0, 1, 2, 3], [1, 0, 0, 1, 3, 3], [0, 1, 0, 0, 2, 3], [0, 0, 1, 1, 2, 4]]})).first()["matrix"]
    assert np.allclose(np.reshape(pose, (4, 4)), [[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]], atol=1e-9)
    with pytest.raises(ValueError):
        box.run("move", {"matrix": [2.0] * 16})
    assert box.result(box.run("move", {"matrix": np.eye(4).ravel().tolist()})).first()["matrix"][0] == 1.0
    assert box.result(box.run("compare_cad", {"align": False})).agg(F.avg(F.abs("distance"))).first()[0] < 0.2
    plan = {
        "elements": [{"id": "L", "type": "plane", "at": [5.5, 15.5, 15.5], "direction": [1, 0, 0], "length": 30}, {"id": "R", "type": "plane", "at": [25.5, 15.5, 15.5], "direction": [1, 0, 0], "length": 30}],
        "characteristics": [{"number": 1, "type": "distance", "elements": ["L", "R"], "nominal": 20.0, "tolerance": 0.1}, {"number": 2, "type": "angle", "elements": ["L", "R"], "nominal": 0.0, "tolerance": 0.5}, {"number": 3, "type": "flatness", "element": "L", "nominal": 0.0, "tolerance": 0.2}],
    }
    rated = {r.number: r for r in box.result(box.run("measure_dimensions", {"plan": json.dumps(plan)}, {"comparison": -1})).collect()}
    assert {k: r.rating for k, r in rated.items()} == {1: "pass", 2: "pass", 3: "pass"} and abs(rated[1].measured - 20) < 0.05
    decided = {r.section: json.loads(r.json) for r in box.result(box.run("first_article_report")).where("section = 'decision'").collect()}
    assert decided["decision"]["accepted"]
    box.run("segment_materials", {"threshold": 10500, "cuts": [], "min_neighbours": 6})
    assert box.result(box.run("material_meshes")).select("path").distinct().count() == 1
    sections = {r.section for r in box.result(box.run("report")).collect()}
    assert {"volume", "comparison", "materials"} <= sections


def test_regions_export_and_xml(spark, box, tmp_path):
    order = {"acceptance": {"zones": [{"name": "a", "box_mm": [[0, 0, 0], [1, 2, 3]]}]}}
    mesh = box.result(box.run("inspection_regions", {"order": json.dumps(order)})).collect()
    corners = np.array([[r[f"{c}{k}"] for k in (1, 2, 3) for c in "xyz"] for r in mesh]).reshape(-1, 3, 3)
    assert len(mesh) == 12 and abs(np.einsum("ij,ij->i", corners[:, 0], np.cross(corners[:, 1], corners[:, 2])).sum() / 6) == pytest.approx(6.0)
    made = box.result(box.run("export_diconde", {"folder": str(tmp_path / "dcm"), "pitch": 0.25, "series": "1.2.3"})).first()
    assert made.slices == 32
    back = Project.open(spark, str(tmp_path / "other"))
    assert back.result(back.run("import_dicom", {"path": str(tmp_path / "dcm")})).count() == 32**3
    values = np.arange(24, dtype="<u2")
    values.tofile(tmp_path / "v.raw")
    (tmp_path / "x.xml.gz").write_bytes(gzip.compress(b'<p><volume name="v" file="v.raw" dims="4 3 2" type="uint16"/></p>'))
    got = back.result(back.run("import_gzipped_xml", {"path": str(tmp_path / "x.xml.gz"), "folder": str(tmp_path)})).orderBy("z", "y", "x").collect()
    assert [r.grey for r in got] == list(range(24))


def test_models_hardening_and_cells(spark, tmp_path):
    p = Project.open(spark, str(tmp_path / "project"))
    bricks.unpack(synthetic.stacked_cell(spark, (40, 36, 30), 3, 5, 5)).write.parquet(str(tmp_path / "cell"))
    p.run("open_dataset", {"path": str(tmp_path / "cell")})
    levels = {"threshold": 1500, "anode": 9000, "cathode": 14000, "tolerance": 100}
    found = p.result(p.run("battery_inspection", levels))
    assert {r.overhang_mm for r in found.collect()} == {5.0}
    rated = [json.loads(r.json) for r in p.result(p.run("battery_report", {"limits": {"min_overhang_mm": 4.0, "max_edge_spread_mm": 1.0}})).collect()]
    assert len(rated) == 2 and all(r["ok"] for r in rated)
    two = np.array([[[[[1.0]]]], [[[[-1.0]]]]], np.float32)
    (tmp_path / "m.model").write_bytes(shape.write_model([{"type": "conv", "weight": two, "bias": np.array([-2000, 2000], np.float32)}]))
    labels = p.result(p.run("segment_model", {"path": str(tmp_path / "m.model")}))
    assert labels.where("material = 0").count() == p.result(p.latest("dataset")).where("grey > 2000").count()
    p.run("beam_hardening", {"level": 0, "order": 2})
    assert p.result(p.latest("dataset")).count() == 40 * 36 * 30


def test_telemetry(spark):
    t = report.Telemetry(spark)
    assert t.measure("count", lambda: spark.range(1000).count()) == 1000
    (r,) = t.table().collect()
    assert r.phase == "count" and r.jobs >= 1 and r.tasks >= 1 and r.seconds > 0
