"""Every query over the small tables against its SQL."""

import glob
import os

import duckdb
import pytest

from weftwork.plans.oracle import SQL
from weftwork.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, row)) for row in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    ours = ours.astype(object).where(ours.notna(), None)
    theirs = theirs.astype(object).where(theirs.notna(), None)
    number = lambda f: f.map(lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)
    assert _rows(number(ours)) == _rows(number(theirs))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
