"""Every query with SQL is held against DuckDB on the smallest tables; the others must give rows."""

import glob

import duckdb
import numpy as np
import pytest

from tidemill.plans import catalog, collected, diagnostics, judged, learned, more, searches, series_queries, streams, symbolic, tables  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet({glob.glob(f'{DIR}/{t}.parquet/*.parquet') or [f'{DIR}/{t}.parquet']})")
    return c


def plain(x):
    if isinstance(x, (list, np.ndarray)):
        return tuple(map(plain, x))
    if x is None or (isinstance(x, (float, np.floating)) and np.isnan(x)):
        return None
    return round(float(x), 5) + 0.0 if isinstance(x, (float, np.floating)) else x.item() if hasattr(x, "item") else x


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    if name in catalog.ORACLE_SQL:
        assert rows(got.toPandas()) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert got.count() > 0  # tests/test_models.py and tests/test_operators.py hold these operators against plain versions
