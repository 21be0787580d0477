"""Every registered query against its SQL at the smallest scale, and the registry's rules."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return repr(float(value))
    return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    got = registry.queries()[name](spark, small).toPandas()
    expected = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_probed_recall_grows_with_probes(spark, small):
    rows = registry.queries()["f3_probed_recall"](spark, small).orderBy("probes").collect()
    shares = [r["recall"] for r in rows]
    assert shares == sorted(shares) and shares[-1] == 1.0
    # Cells picked at random would find the share of passages they hold.
    assert all(r["recall"] > r["probes"] / 16 for r in rows[:-1])


def test_entry(spark):
    out = registry.entry(spark)
    assert out.columns == ["query_idx", "n_docs", "n_robust", "n_misleading", "mean_robustness"]
    assert out.count() == 500
