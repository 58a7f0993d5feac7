"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from shiftkit import catalog

SF = "/root/testdata/sf0.001"

def same(a, b, digits=5):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return abs(float(a) - float(b)) <= 10**-digits * max(1, abs(float(b)))
    return a == b


@pytest.mark.parametrize("name", sorted(set(catalog.SQL)))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([r[c] for c in cols] for r in df.collect()), key=repr)
    cur = con.execute(catalog.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(([r[names.index(c)] for c in cols] for r in cur.fetchall()), key=lambda r: repr([type(g)(x) if x is not None and isinstance(g, (int, float, str)) and not isinstance(x, str) else x for g, x in zip(got[0] if got else r, r, strict=False)]))
    assert len(got) == len(want)
    if not all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True)):
        key = lambda r: [str(x) if not isinstance(x, float) else f"{x:.4f}" for x in r]
        assert sorted(map(key, got)) == sorted(key([float(x) if isinstance(g, float) and x is not None else x for g, x in zip(got[0], r, strict=True)]) for r in want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1
