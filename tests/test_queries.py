"""Every query with an SQL twin gives its rows, in DuckDB and in Spark."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from peakforge.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "-") in "iuf":
        return float(v)
    return str(v)


def rows(frame):
    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
