"""Every registered query of the library against its SQL at the smallest scale."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from folioforge.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, cols):
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, (str, bool)) else round(float(v), 9)
    return sorted(str([plain(v) for v in r]) for r in frame[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got) > 0
        return
    exp = con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(exp.columns)
    assert rows(got, cols) == rows(exp, cols)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
