"""Work that costs much for each row of a small table is dealt over the cores."""

from __future__ import annotations

import pytest

from folioforge.plans.queries import QUERIES
from folioforge.plans.tables import spread


@pytest.mark.parametrize("name", ["description_price_lines", "numbers_in_text", "seller_price_cascade", "volume_responses"])
def test_small_tables_are_dealt(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_rows_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k long, v string")
    got = spread(rows, "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
