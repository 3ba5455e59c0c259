"""Every statement gives the same rows in Spark and in DuckDB on the smallest tables."""

import duckdb
import pytest

from folioforge.functions.dialect import ACCENTED, FOLDED
from folioforge.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.STATEMENTS))
def test_same_rows(spark, duck, name):
    got, want = catalog.run(name, spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_fold_tables_match():
    assert len(ACCENTED) == len(FOLDED) == 67
