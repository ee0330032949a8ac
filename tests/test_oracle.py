"""Every registered query of the library against its SQL, at the smallest scale."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from gridwise.plans import domain, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in domain.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if pd.isna(v):
        return None
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and not isinstance(v, str) else str(v)


def rows(df):
    k = sorted(df.columns)
    return k, sorted(repr([plain(v) for v in r]) for r in df[k].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(db.sql(registry.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
