"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillspark.plans import details, parts, registry


assert parts and details  # add their queries to the registry


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):
            return f"{x:.6g}"
        if isinstance(x, pd.Timestamp):
            return x.isoformat()
        return str(int(x)) if hasattr(x, "item") and isinstance(x.item(), int) else str(x)

    return sorted(tuple("null" if v == "<NA>" else v for v in map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, data, duck, name):
    got, want = registry.QUERIES[name](spark, data).toPandas(), duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or abs(float(p) - float(q)) <= 1e-4 * abs(float(q)) for p, q in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
