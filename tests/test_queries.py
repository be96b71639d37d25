"""Every query with an oracle against DuckDB on the smallest tables; the others by their rows."""

import os
from collections import Counter

import duckdb
import pytest

from pagemill import catalog

SF = "/root/testdata/sf0.001"
TABLES = "events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(str(r[k]) for k in order) for r in found)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
