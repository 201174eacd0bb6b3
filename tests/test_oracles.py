"""Every reference query against its DuckDB oracle on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from vellum.plans import registry


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return f"{float(v):.6g}" if isinstance(v, int) and abs(v) < 1 << 20 else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLES:
        return
    found = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall()) == rows
