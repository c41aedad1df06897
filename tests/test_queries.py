"""Every registered query of the graph engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from pathloom.plans import catalogue
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF_SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_SMALL}/{f}')")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: round(float(v), 4) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    return sorted((tuple(clean(r[k]) for k in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF_SMALL)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, found.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4) for x, y in zip(a, b)), (a, b)
