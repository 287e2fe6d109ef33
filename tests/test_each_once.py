"""Costly columns are made once for each different combination of what they depend on."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.plans.queries import QUERIES
from folioforge.plans.tables import each_once


def test_rows_stay(spark):
    rows = [(1, "x", None), (2, "x", None), (3, None, None), (4, "", "y"), (5, None, "y"), (5, None, "y")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    got = each_once(df, ["a", "b"], F.concat_ws("-", "a", "b").alias("c"))
    assert got.columns == ["k", "a", "b", "c"]
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("c", F.concat_ws("-", "a", "b")).collect()))


def test_pairs_of_titles_are_compared_once(spark):
    lines = QUERIES["title_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "regexp_replace" in x)
    assert any("Aggregate" in x for x in lines[at:])
