"""Every reference-coverage query with an oracle equals DuckDB on the small tables."""

import decimal

import duckdb
import pytest
from conftest import SMALL

from loomfield.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SMALL)
    r = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted((tuple(plain(w[cols.index(k)]) for k in order) for w in r.fetchall()), key=repr)
    got = sorted((tuple(plain(x[k]) for k in order) for x in df.collect()), key=repr)
    assert got == want
