"""Registered query of a whole payload run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isbn
from ..operators import relational
from . import pipelines
from .registry import query
from .tables import read


@query("""WITH l AS (SELECT o_orderkey, 'L' || o_orderkey AS ads_id, o_orderkey % 5 = 0 AS bare, o_orderkey % 4 = 1 AS film FROM orders WHERE o_orderkey % 7 <> 0),
x AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 AS n, l_partkey % 11 <> 0 AS named, (l_partkey % 100) / 100.0 AS conf, l_suppkey % 10 = 0 AS shown FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
b AS (SELECT l.*, x.*, CASE WHEN NOT named THEN 'no_isbn' WHEN conf < 0.5 THEN 'weak_candidate' WHEN conf < 0.85 THEN 'medium_candidate' ELSE 'strong_candidate' END AS candidate, named AND (shown OR conf >= 0.8) AS may FROM l JOIN x ON l_orderkey = o_orderkey WHERE NOT bare AND NOT film),
-- a number that one book of a listing may send is priced for all its books
g AS (SELECT *, named AND bool_or(may) OVER (PARTITION BY o_orderkey, CASE WHEN named THEN n END) AS sent FROM b),
p AS (SELECT *, CASE WHEN sent THEN CASE n % 3 WHEN 0 THEN n % 20 + 1 WHEN 1 THEN 0 END END AS mp, CASE WHEN sent THEN CASE WHEN n % 4 = 0 THEN n % 15 + 0.5 ELSE 0 END END AS gp,
  CASE WHEN NOT sent THEN 'not_sent' WHEN n % 3 = 0 THEN 'momox_price_found' WHEN n % 3 = 1 THEN 'momox_no_offer' ELSE 'momox_failed' END AS ms, CASE WHEN NOT sent THEN 'not_sent' WHEN n % 4 = 0 THEN 'gibert_price_found' WHEN n % 4 = 1 THEN 'gibert_non_repris' ELSE 'gibert_missing' END AS gs FROM g),
s AS (SELECT o_orderkey, count(*) FILTER (sent AND candidate IN ('strong_candidate', 'medium_candidate')) AS taking, count(*) FILTER (sent AND candidate IN ('strong_candidate', 'medium_candidate') AND ms = 'momox_failed') AS failed FROM p GROUP BY 1)
SELECT l.ads_id, CASE WHEN l.bare THEN 'no_image' WHEN l.film THEN 'rejected_non_book' WHEN coalesce(failed, 0) > 0 THEN 'provider_incomplete' WHEN coalesce(taking, 0) = 0 THEN 'no_books_detected' ELSE 'processed' END AS listing, l_linenumber AS line, candidate, ms AS momox_status, gs AS gibert_status,
  CAST(CASE WHEN sent THEN greatest(coalesce(mp, 0), gp) END AS DOUBLE) AS best, CASE WHEN sent AND (mp > 0 OR gp > 0) THEN CASE WHEN gp > coalesce(mp, 0) THEN 'gibert' ELSE 'momox' END END AS platform, CAST(gp - 2 AS DOUBLE) AS profit_b,
  CASE WHEN candidate IS NOT NULL AND NOT may THEN CASE WHEN NOT named THEN 'no_isbn' ELSE 'isbn_confidence_below_threshold' END END AS reason
FROM l LEFT JOIN p ON p.o_orderkey = l.o_orderkey LEFT JOIN s ON s.o_orderkey = l.o_orderkey""")
def payload_run(spark: SparkSession, d: str) -> DataFrame:
    """QS16 with SRC1, SNK1, CLS1, CLS2, CLS3, JN3, SNK4, AG2, SNK14: from payload bodies to priced rows and the listings' states."""
    key = F.concat(F.lit("L"), "o_orderkey")
    o = read(spark, d, "orders")
    title = F.when(F.col("o_orderkey") % 4 == 0, "Lot de livres").when(F.col("o_orderkey") % 4 == 1, "DVD du film").otherwise("Une chose")
    item = F.to_json(F.struct(key.alias("id"), title.alias("title"), F.when(F.col("o_orderkey") % 5 != 0, F.array(F.lit("p"))).alias("pictureUrls")))
    # a payload of each customer; a listing comes in one payload
    bodies = o.select(F.col("o_custkey").alias("payload_id"), item.alias("item")).groupBy("payload_id").agg(F.concat(F.lit('{"items":['), F.array_join(F.sort_array(F.collect_list("item")), ","), F.lit("]}")).alias("body"))
    names = "ads_id string, url string, title string, description string, price_text string, price_amount decimal(10,2), first_picture_url string, picture_urls array<string>, tags array<string>, location_text string, location_city string, location_postal_code string, date_of_post timestamp, source string, search_title string, scraped_at timestamp, status string, process_attempts int"
    known = spark.createDataFrame([], names).unionByName(o.filter("o_orderkey % 7 = 0").select(key.alias("ads_id"), F.lit("processed").alias("status"), F.lit(1).alias("process_attempts")), allowMissingColumns=True)
    li = relational.first_wins(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    number = F.when(F.col("l_partkey") % 11 != 0, isbn.synthetic(F.col("l_partkey") % 500))
    detected = li.select(
        F.concat(F.lit("L"), "l_orderkey").alias("ads_id"), F.col("l_linenumber").alias("book_id"), number.alias("isbn"), F.lit(True).alias("isbn_is_valid"), ((F.col("l_partkey") % 100) / 100).alias("isbn_confidence"), F.lit("").alias("isbn_source"),
        F.when(F.col("l_suppkey") % 10 == 0, number).alias("visible_isbn"), F.lit(2).cast("decimal(10,2)").alias("cost"),
    )
    n = read(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("n")).distinct()
    offers_a = n.filter("n % 3 <> 2").select(isbn.synthetic(F.col("n")).alias("isbn"), F.when(F.col("n") % 3 == 0, F.col("n") % 20 + 1).otherwise(0).alias("price"), F.when(F.col("n") % 3 == 0, "offer").otherwise("no_offer").alias("status"), F.lit(0).alias("ord"))
    offers_b = n.filter("n % 4 < 2").select(isbn.synthetic(F.col("n")).alias("isbn"), F.when(F.col("n") % 4 == 0, F.col("n") % 15 + 0.5).otherwise(0.0).alias("price"), F.when(F.col("n") % 4 == 0, "gibert_price_found").otherwise("gibert_non_repris").alias("status"), F.lit(0).alias("ord"))
    listings, books = pipelines.processed_payload(known, bodies, detected, offers_a, offers_b)
    rows = books.select("ads_id", F.col("book_id").alias("line"), F.col("candidate_status").alias("candidate"), "momox_status", "gibert_status", F.col("best_resale_price").cast("double").alias("best"), F.col("best_resale_platform").alias("platform"), F.col("profit_gibert").cast("double").alias("profit_b"), F.col("not_sent_reason").alias("reason"))
    return listings.select("ads_id", F.col("processing_status").alias("listing")).join(rows, "ads_id", "left")
