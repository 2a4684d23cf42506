"""Every query with SQL against DuckDB on the smallest tables; the others return a stable schema."""

import os
from pathlib import Path

import duckdb
import pytest

from pagemill.plans import registry


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for f in Path(tiny).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return c


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(tuple, pdf[cols].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_duckdb(spark, duck, tiny, name):
    got, want = registry.QUERIES[name](spark, tiny).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, tiny, name):
    df = registry.QUERIES[name](spark, tiny)
    assert df.columns and df.limit(5).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 200
    assert os.path.exists(Path(entry.__file__).parent / "bench.py")
