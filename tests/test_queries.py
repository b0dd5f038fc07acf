import math
import os

import duckdb
import pytest

from weftline.plans import more_queries, oracle, recipe_queries
from weftline.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql() | recipe_queries.oracle_sql() | more_queries.SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return "nan" if math.isnan(x) else repr(round(float(x), 4) + 0.0)
    return x.isoformat()[:19] if hasattr(x, "isoformat") else str(x)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        r = duck.execute(SQL[name])
        at = [x[0] for x in r.description]
        assert sorted(at) == cols
        assert got == sorted(tuple(plain(row[at.index(c)]) for c in cols) for row in r.fetchall())
