"""Cases of tables that grow: values beyond a range, crowded places, and work that has to be shared between tasks."""

import math

import duckdb
import numpy as np
import pytest

from brickwise.operators import dimensional, histogram, porosity, surface, walls
from brickwise.operators.graph import connected_components, dense_roots
from brickwise.plans import catalogue, inspection_queries


def test_a_pore_without_void_has_a_volume_and_no_centre(spark):
    voxels = spark.range(27).selectExpr("int(id % 3) AS x", "int(id div 3 % 3) AS y", "int(id div 9) AS z", "3000 AS grey")
    pore = spark.createDataFrame([(7, 1, 1, 1)], "component long, x int, y int, z int")
    got = porosity.pore_volumes(voxels, pore, 2000.0, 10.0).first()
    assert got.volume_mm3 == pytest.approx(-27 * 1000 / 1990)
    assert all(math.isnan(v) for v in (got.cx, got.cy, got.cz))


@pytest.mark.parametrize("high", [3, 500])
def test_too_few_values_for_four_classes_are_null(spark, tmp_path, high):
    """Three bins, and none at all below the query's limit."""
    rows = spark.range(3).selectExpr("id AS l_partkey", "id AS l_suppkey", "id AS l_orderkey", f"double((id + 1) * {high}) AS l_quantity")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(inspection_queries.SQL["multi_otsu_4"]).fetchall()
    assert [tuple(r) for r in inspection_queries.multi_otsu_4(spark, str(tmp_path)).collect()] == want == [(None, None)]


def test_no_query_hides_another(monkeypatch):
    assert "surface_band_codes" in catalogue.queries()
    assert catalogue.queries()["surface_codes"].__module__.endswith("analysis_queries")
    monkeypatch.setitem(inspection_queries.Q, "surface_codes", None)
    with pytest.raises(ValueError, match="surface_codes"):
        catalogue.queries()


@pytest.mark.parametrize("halve", [False, True])
def test_thin_regions_of_crowded_and_scattered_points(spark, monkeypatch, halve):
    rng = np.random.default_rng(3)
    p = np.r_[rng.uniform(-9, 9, (150, 3)).round(2), np.repeat(rng.uniform(20, 30, (3, 3)), 20, 0), [[50, 50, 50], [52, 50, 50], [54.0000001, 50, 50]]]
    if halve:
        monkeypatch.setattr(walls, "FEW_EDGES", -64 * len(np.unique(p, axis=0)))
    monkeypatch.setattr(walls, "connected_components", lambda e, few: connected_components(e, 1 << 20))
    got = walls.thin_regions(spark.createDataFrame([(i, *map(float, v), 0.5) for i, v in enumerate(p)], "id long, x double, y double, z double, thickness double"), 1.0, 2.0).collect()
    i, j = np.nonzero(((p[:, None] - p[None]) ** 2).sum(2) <= 4.0)
    roots = dense_roots(len(p), i, j)
    want = sorted(((-n, r) for r, n in zip(*np.unique(roots, return_counts=True), strict=True)))
    assert [(r.region, r.n) for r in sorted(got, key=lambda r: r.region)] == [(k + 1, -n) for k, (n, _) in enumerate(want)]
    assert [r.cx for r in sorted(got, key=lambda r: r.region)] == pytest.approx([p[roots == r, 0].mean() for _, r in want])


def test_repeated_points_fit_like_their_rows(spark):
    rng = np.random.default_rng(5)
    p = np.repeat(rng.normal(size=(40, 3)) * [5, 4, 0.01], rng.integers(1, 9, 40), 0)
    rows = spark.createDataFrame([("e", "plane", *map(float, v)) for v in p], "element string, kind string, x double, y double, z double")
    got, want = dimensional.fit_elements(rows).first().asDict(), dimensional.fit_element("plane", p)
    assert got["n"] == want["n"] and [got[c] for c in ("cx", "dz", "rms", "form")] == pytest.approx([want[c] for c in ("cx", "dz", "rms", "form")])


def test_no_kernel_gets_a_row_for_each_repeated_point(spark):
    rows = spark.range(5000).selectExpr("'e' AS element", "'point' AS kind", "double(id % 3) AS x", "0D AS y", "0D AS z")
    assert dimensional.fit_elements(rows).first().n == 5000
    assert "count(1)" in dimensional.fit_elements(rows)._jdf.queryExecution().optimizedPlan().toString()


def test_medians_of_one_group_are_shared_between_parts(spark):
    rows = spark.range(4001).selectExpr("id * 7919 % 4001 AS v", "IF(id % 5 = 0, NULL, 'k') AS k")
    got = {r.k: r.median for r in histogram.upper_median(rows, "v", ["k"]).collect()}
    host = rows.toPandas()
    assert got == {k: sorted(host["v"][host["k"].isna() if k is None else host["k"] == k])[int((host["k"].isna() if k is None else host["k"] == k).sum()) // 2] for k in (None, "k")}
    windows = histogram.upper_median(rows, "v", ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(part" in windows


def test_nearest_and_nominal_of_points_in_one_place(spark):
    rng = np.random.default_rng(7)
    p = np.r_[rng.normal(size=(120, 3)), np.zeros((30, 3)), np.full((1, 3), 40.0)]
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    assert {r.id: r.nearest for r in surface.nearest(rows, rows).collect()} == dict(enumerate(d2.argmin(1).tolist()))
    thick = rows.selectExpr("*", "double(id) AS thickness")
    assert {r.id: r.nominal for r in walls.against_nominal(thick, thick, 2.0).collect()} == {i: float(120 if 120 <= i < 150 else i) for i in range(151)}


def test_closest_pores_of_crowded_voxels(spark):
    rng = np.random.default_rng(11)
    p = np.unique(np.c_[k := rng.integers(0, 4, 400), rng.integers(0, 60, 400), k * 12 + rng.integers(0, 4, 400), rng.integers(-30, 30, 400)], axis=0)
    size = np.array([0.5, 1.0, 2.0])
    gap = np.sqrt(((np.maximum(np.abs(p[:, None, 1:] - p[None, :, 1:]) - 1, 0) * size) ** 2).sum(2))
    want = min((gap[i, j], p[i, 0], p[j, 0]) for i in range(len(p)) for j in range(len(p)) if p[i, 0] < p[j, 0])
    got = porosity.closest_pores(spark.createDataFrame(p.tolist(), "component long, x int, y int, z int"), tuple(size)).first()
    assert (got.gap, got.a, got.b) == (pytest.approx(want[0]), want[1], want[2])
