"""Every registered query of the library's own operators beside its SQL."""

import math
from decimal import Decimal

import duckdb
import pytest

from vellumspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return plain(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    r = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted((tuple(plain(row[cols.index(c)]) for c in sorted(cols)) for row in r.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in sorted(cols)) for row in df.collect()), key=repr)
    assert got == want and got


def test_sql_is_only_for_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
