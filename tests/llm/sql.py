"""Holds a DataFrame against DuckDB SQL over the same small tables."""

import duckdb


def rows(frame):
    return sorted(str(tuple(r[c] for c in sorted(frame.columns))) for r in frame.collect())


def same_as_sql(got, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = sorted(str(tuple(r[names.index(c)] for c in sorted(names))) for r in cur.fetchall())
    assert sorted(names) == sorted(got.columns)
    assert rows(got) == want
