"""Scores of documents against benchmark items by brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioforge.functions import similarity
from folioforge.plans.queries import QUERIES

DOCS = [
    (1, "Nothing here\nThe red castle of winter"),
    (2, "castle winter"),
    (3, None),
    (None, "deep sea stories\nred castle"),
    (45, "of the la les un\nzzz"),
    (6, "of the la les un: other words\n"),
]
ITEMS = [(0, "unrelated words entirely"), (77, "Red castle of winter"), (120, "deep sea stories"), (121, "of the la les un: deep")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("candidates"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, line) for i, t in DOCS if t is not None for line in t.split("\n")], "doc_id long, a string")
    pairs = docs.crossJoin(spark.createDataFrame(ITEMS, "item_id long, b string"))
    exact = {}
    for r in pairs.select("doc_id", "item_id", similarity.token_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        exact[r.doc_id, r.item_id] = max(r.s, exact.get((r.doc_id, r.item_id), 0.0))
    return path, exact


def test_token_similarity(spark, tables):
    path, exact = tables
    got = {r.doc_id: r.similarity for r in QUERIES["token_similarity"](spark, path).collect()}
    assert got == {i: max((s for (d, _), s in exact.items() if d == i), default=0.0) for i, _ in DOCS}


def test_candidate_score_top10(spark, tables):
    path, exact = tables
    got = {(r.doc_id, r.item_id) for r in QUERIES["candidate_score_top10"](spark, path).collect()}
    assert got == {k for k, s in exact.items() if s > 0} and {(None, 120), (1, 77), (6, 121)} <= got
