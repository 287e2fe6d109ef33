"""Lines are cut into tokens once, however many steps of the similarity joins read them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.plans.tables import line_sides, read

SF = "/root/testdata/sf0.001"


def test_lines_are_stored(spark):
    for side in line_sides(spark, SF):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan and "Generate" not in plan and "Join" not in plan


def test_sides_are_those_of_the_lines(spark):
    left, _, members, _ = line_sides(spark, SF)
    lines = read(spark, SF, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("t")).distinct()
    exp = lines.select(F.xxhash64("t").alias("l"), T.similarity_tokens(F.col("t")).alias("tokens")).distinct()
    assert {(r.l, *r.tokens) for r in left.collect()} == {(r.l, *r.tokens) for r in exp.collect()}
    assert {(r.g, r.l) for r in members.collect()} == {(r.doc_id, r.l) for r in lines.select("doc_id", F.xxhash64("t").alias("l")).collect()}
