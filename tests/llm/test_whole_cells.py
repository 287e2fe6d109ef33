"""A cell comes to one task whole, also right after a join by cell."""

from __future__ import annotations

from folioforge.llm import jaccard


def test_cells_are_dealt_after_a_join_by_cell(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(1, 2, "a b c d")], "cell long, u long, text string")
        found = jaccard._cell_links(rows.join(rows.select("cell").distinct(), "cell", "left_semi"), jaccard.Rule())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "REPARTITION_BY_NUM" in plan
