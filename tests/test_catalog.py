"""Every query of the library against its oracle on the smallest tables."""

import duckdb
import pytest

from benchloom.plans import catalog
from benchloom.plans.views import TABLES

SF = "/root/testdata/sf0.001"


def rows(df, columns):
    norm = lambda v: None if v is None else round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(norm(r[c]) for c in columns) for r in df), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    want = [dict(zip(columns, r)) for r in found.fetchall()]
    assert rows([r.asDict() for r in got.collect()], sorted(columns)) == rows(want, sorted(columns))
