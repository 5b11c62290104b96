import os

import duckdb
import pytest

from brickwise.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str(tuple(clean(r[k]) for k in order)) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, FOLDER)
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert canonical(got.collect(), got.columns) == canonical(cur.fetchall(), names)


def test_flagship_finds_the_planted_pores(spark):
    found = sorted(r.voxels for r in catalogue.queries()["flagship_porosity_phantom"](spark, FOLDER).collect())
    assert found == [36, 112, 268, 125000]
