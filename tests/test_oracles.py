"""Each query of the catalogue against its SQL on a second engine."""

import glob
import math
import os

import pytest

from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def close(a, b):
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rel = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert {c: KINDS[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    order = [c for c in columns if dict(df.dtypes)[c] != "double"] + [c for c in columns if dict(df.dtypes)[c] == "double"]
    got = sorted((tuple(r) for r in df.select(*order).collect()), key=repr)
    want = sorted(con.sql("select " + ", ".join(f'"{c}"' for c in order) + f" from ({ORACLES[name]})").fetchall(), key=repr)
    assert len(got) == len(want)
    assert all(map(close, got, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, sf, name):
    if "bpe" in name:
        pytest.importorskip("public_tokenizers")
    assert QUERIES[name](spark, sf).count() > 0
