"""A turn that is longer than the JSON parser takes."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.llm import chat


def test_long_turn(spark):
    n = 20_000_001
    df = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("x"), F.lit(n)).alias("text"))
    row = chat.chat_digest(df).first()
    assert row.n_turns == 1 and row.loss_chars == n
