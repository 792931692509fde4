"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from lakelore.plans.queries import QUERIES, SQL
from lakelore.session import TABLES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "tzinfo"):
        return str(v)[:26]
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = sorted([tuple(plain(r[n]) for n in names) for r in df.collect()], key=repr)
    if name in SQL:
        found = duck.execute(SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        want = sorted([tuple(plain(r[columns.index(n)]) for n in names) for r in found.fetchall()], key=repr)
        assert got == want
    else:
        assert got
