"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import pytest

from fieldtrace.plans import catalog, measures, paths, play  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(found):
    return sorted(tuple("null" if v is None or v != v else f"{float(v):.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.execute(catalog.SQL[name])
    names = [c[0] for c in expected.description]
    assert columns == sorted(names)
    order = [names.index(c) for c in columns]
    assert rows(map(tuple, df.select(*columns).collect())) == rows(tuple(r[k] for k in order) for r in expected.fetchall())
