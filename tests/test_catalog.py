"""Every catalogue query against its SQL on the smallest test tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from bibliolith.plans import catalog

DATA = Path(os.environ.get("TESTDATA", "/root/testdata")) / "sf0.001"
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v).replace("T", " ") if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    rows = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in sorted(df.columns)]
    assert sorted(rows) == sorted(tuple(norm(r[k]) for k in at) for r in want.fetchall())
