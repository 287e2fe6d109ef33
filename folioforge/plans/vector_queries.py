"""Registered queries of vector comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, vectors
from .registry import query
from .tables import read


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, a.label = b.label AS same, round(list_cosine_similarity(a.e, b.e), 9) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS rank FROM p QUALIFY rank <= 5)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(similarity, 6) AS similarity, CASE WHEN same AND similarity >= 0.85 THEN 'match' WHEN same AND similarity >= 0.6 THEN 'likely_match' WHEN NOT same AND similarity >= 0.6 THEN 'mismatch' ELSE 'uncertain' END AS status FROM r""")
def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """UD5, CLS20: pictures as vectors: the five nearest of every row, each with the verdict that its similarity and label give."""
    rows = read(spark, d, "embeddings")
    label = lambda c: rows.select(F.col("vec_id").alias(c), F.col("label").alias(f"{c}_label"))
    near = vectors.nearest(rows).join(label("vec_id"), "vec_id").join(label("neighbour"), "neighbour")
    status = classify.vision_status(F.col("vec_id_label") == F.col("neighbour_label"), F.col("similarity"))
    return near.select("vec_id", "rank", "neighbour", F.round("similarity", 6).alias("similarity"), status.alias("status"))
