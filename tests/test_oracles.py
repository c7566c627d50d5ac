"""Registered cohort queries against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from cohortspark import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def canonical(frame):
    def cell(x):
        if isinstance(x, (float, np.floating)):
            return "nan" if math.isnan(x) else str(round(float(x), 5) + 0.0)
        return str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, row)) for row in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    mine = catalog.QUERIES[name](spark, FOLDER).toPandas()
    theirs = duck.execute(catalog.ORACLES[name]).df()
    assert canonical(mine) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
