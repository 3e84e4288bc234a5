"""Every query with SQL gives the rows that DuckDB gives (smallest tables)."""

import os

import pytest

import __spark_entry__ as entry
from cellsight.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def frame(df, columns):
    df = df[columns].copy()
    for c in columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
    return df.astype(str).replace({"<NA>": "nan", "None": "nan"}).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    want, got = duck.sql(catalogue.ORACLES[name]).df(), catalogue.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = frame(want, columns), frame(got, columns)
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head(3).to_string() + "\n" + b[(a != b).any(axis=1)].head(3).to_string()


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
