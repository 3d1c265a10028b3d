"""Every query of the registry against its SQL, at the smallest size; and the driver's entry."""

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str([None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v for v in r]) for r in frame.values.tolist())


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    assert rows(registry.queries()[name](spark, SMALL).toPandas()) == rows(sql.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
