"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express it.

The queries of the ladders, sources and flows are in modules of their own, which register with the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import isbn, misc, numbers, price, similarity
from ..functions import text as T
from ..operators import classify, ledger, merge, relational, set_join
from ..sources import pages
from ..streaming import queue
from .queue_queries import ROCKS, streamed
from .registry import ORACLE_SQL, QUERIES, query
from .tables import best_offers, book_states, line_measure, line_sides, offers, priced_books, read, spread, token_sides

# --- SQL fragments


def isbn_check_sql(core: str) -> str:
    return f"CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({core}, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR)"


def isbn_sql(key: str) -> str:
    core = f"('978' || lpad(CAST({key} AS VARCHAR), 9, '0'))"
    return f"({core} || {isbn_check_sql(core)})"


OFFERS_SQL = """offers AS (
  SELECT l_orderkey AS ads_id, l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line,
    CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS price
  FROM lineitem
)"""
PRICED_SQL = OFFERS_SQL + """, sides AS (
  SELECT ads_id, part, max(price) FILTER (supplier % 2 = 0) AS a, max(price) FILTER (supplier % 2 = 1) AS b FROM offers GROUP BY ALL
), priced AS (
  SELECT ads_id, part, a, b, CAST(p_retailprice AS DECIMAL(12,2)) AS retail FROM sides JOIN part ON p_partkey = part
)"""
STATES_SQL = f"""k AS (SELECT *, l_orderkey * 7 + l_linenumber * 3 + l_partkey AS k, CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS DECIMAL(10,2)) AS pr FROM lineitem),
books AS (
  SELECT l_orderkey AS ads_id, l_linenumber AS line, CASE WHEN k % 11 <> 0 THEN {isbn_sql('l_partkey')} END AS isbn,
    (['isbn_strong', 'isbn_medium', 'isbn_weak', 'momox_pending', 'isbn_invalid'])[k % 5 + 1] AS status,
    (['not_sent', 'momox_pending', 'momox_price_found', 'momox_no_offer', 'momox_failed'])[(k // 2) % 5 + 1] AS momox_status,
    (['not_sent', 'gibert_pending', 'gibert_price_found', 'gibert_non_repris', 'gibert_failed', 'gibert_missing', ''])[(k // 3) % 7 + 1] AS gibert_status,
    CASE WHEN l_linenumber % 2 = 0 THEN pr END AS momox_price, CASE WHEN l_linenumber % 3 = 0 THEN pr END AS gibert_price,
    (['strong_candidate', 'medium_candidate', 'weak_candidate', 'duplicate_selected', 'rejected'])[(k // 5) % 5 + 1] AS candidate_status,
    (['new', 'validated', 'pending', 'pending_edition_choice', 'new', 'new', 'rejected'])[(k // 7) % 7 + 1] AS admin_status,
    (['match', 'likely_match', 'mismatch', 'uncertain', 'not_checked', 'not_checked'])[(k // 4) % 6 + 1] AS provider_match_status,
    (['catalog_no_match', 'visible_isbn', 'not_eligible'])[(k // 6) % 3 + 1] AS not_sent_reason
  FROM k
), states AS (
  SELECT *, CASE WHEN momox_status = 'not_sent' THEN 'not_sent' WHEN momox_status = 'momox_pending' THEN 'pending' WHEN momox_status = 'momox_failed' THEN 'failed' ELSE 'done' END AS a,
    CASE WHEN gibert_status IN ('not_sent', '') THEN 'not_sent' WHEN gibert_status = 'gibert_pending' THEN 'pending' WHEN gibert_status = 'gibert_failed' THEN 'failed' ELSE 'done' END AS b
  FROM books
)"""
BACKEND_SQL = """CASE
  WHEN admin_status = 'rejected' OR candidate_status = 'rejected' THEN 'rejected'
  WHEN admin_status = 'validated' THEN 'ready_for_admin'
  WHEN isbn IS NULL THEN 'detected_no_isbn'
  WHEN provider_match_status IN ('mismatch', 'uncertain') THEN 'needs_admin_review'
  WHEN admin_status = 'pending_edition_choice' OR candidate_status = 'duplicate_selected' THEN 'needs_admin_review'
  WHEN a = 'failed' OR b = 'failed' THEN 'provider_failed'
  WHEN a = 'pending' OR b = 'pending' THEN 'isbn_confirmed'
  WHEN coalesce(momox_price, 0) > 0 OR coalesce(gibert_price, 0) > 0 THEN CASE WHEN provider_match_status IN ('match', 'likely_match') THEN 'ready_for_admin' ELSE 'provider_price_found' END
  WHEN a = 'done' AND b = 'done' THEN 'provider_no_offer'
  WHEN a = 'done' OR b = 'done' THEN 'isbn_confirmed'
  WHEN status <> 'isbn_invalid' AND (candidate_status IN ('strong_candidate', 'medium_candidate') OR status IN ('isbn_strong', 'isbn_medium') OR not_sent_reason IN ('catalog_no_match', 'not_eligible')) THEN 'needs_admin_review'
  ELSE 'provider_not_sent' END"""
ASCII_SQL = lambda x: f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
DEC = "CAST({} AS DECIMAL(12,2))"


# --- offers and prices


@query(f"WITH {PRICED_SQL} SELECT ads_id, part, CAST(CASE WHEN coalesce(a, 0) <= 0 AND coalesce(b, 0) <= 0 THEN 0 ELSE greatest(coalesce(a, 0), coalesce(b, 0)) END AS DECIMAL(12,2)) AS best_price, CASE WHEN coalesce(a, 0) <= 0 AND coalesce(b, 0) <= 0 THEN NULL WHEN coalesce(b, 0) > coalesce(a, 0) THEN 'gibert' ELSE 'momox' END AS platform, CAST(greatest(coalesce(a, 0), coalesce(b, 0), 0) - CAST((CAST(retail * 100 AS BIGINT) + 50) // 100 AS DECIMAL(14,2)) / 100 AS DECIMAL(12,2)) AS profit FROM priced")
def best_offer_per_listing(spark: SparkSession, d: str) -> DataFrame:
    """JN3, AG20, PR9."""
    return best_offers(spark, d)


@query(f"WITH {STATES_SQL}, s AS (SELECT {BACKEND_SQL} AS backend_status FROM states) SELECT backend_status, count(*) AS n FROM s GROUP BY 1")
def backend_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """CLS13, CLS15, AG1."""
    return ledger.backend_counts(book_states(spark, d))


@query(f"""WITH {STATES_SQL}, e AS (SELECT *, isbn IS NOT NULL AND status NOT IN ('isbn_invalid', 'isbn_weak') AND candidate_status <> 'weak_candidate' AND (status = 'momox_pending' OR candidate_status = 'strong_candidate'
  OR admin_status = 'pending_edition_choice' OR momox_status NOT IN ('', 'not_sent') OR gibert_status NOT IN ('', 'not_sent')) AS eligible FROM states)
SELECT ads_id, count(*) FILTER (eligible) AS eligible_rows, count(*) FILTER (eligible AND (a IN ('pending', 'failed', 'not_sent') OR b IN ('pending', 'failed', 'not_sent'))) AS incomplete,
  count(*) FILTER (eligible AND (a IN ('pending', 'failed') OR b IN ('pending', 'failed'))) AS blocking,
  CASE WHEN count(*) FILTER (eligible AND (a IN ('pending', 'failed') OR b IN ('pending', 'failed'))) > 0 THEN 'provider_incomplete' WHEN count(*) FILTER (eligible) = 0 THEN 'no_books_detected' ELSE 'processed' END AS processing_status
FROM e GROUP BY ads_id""")
def listing_completion(spark: SparkSession, d: str) -> DataFrame:
    """CLS14, AG2, SNK14."""
    rows = book_states(spark, d)
    rows = rows.withColumn("eligible", classify.provider_eligible({c: F.col(c) for c in rows.columns}))
    return ledger.completion(ledger.state_counts(rows)).select("ads_id", "eligible_rows", "incomplete", "blocking", "processing_status")


@query(f"WITH {STATES_SQL} SELECT ads_id, line, CASE WHEN coalesce(momox_status, 'not_sent') <> 'not_sent' THEN momox_price END AS momox_price, CASE WHEN gibert_status <> 'not_sent' THEN gibert_price END AS gibert_price FROM states")
def null_price_backfill(spark: SparkSession, d: str) -> DataFrame:
    """SNK19."""
    return merge.null_price_backfill(book_states(spark, d)).select("ads_id", "line", "momox_price", "gibert_price")


@query(f"WITH {OFFERS_SQL} SELECT o.ads_id, CAST(sum(price) AS DECIMAL(18,2)) AS offer_sum, count(*) AS offers, abs(CAST(sum(price) AS DECIMAL(18,2)) - CAST(round(CAST(max(o_totalprice) AS DECIMAL(14,2)), 2) AS DECIMAL(18,2))) < 0.01 AS matches_total FROM offers o JOIN orders ON o_orderkey = o.ads_id GROUP BY 1")
def offer_total_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """AG6."""
    totals = read(spark, d, "orders").select(F.col("o_orderkey").alias("ads_id"), F.col("o_totalprice").cast("decimal(14,2)").alias("total"))
    return ledger.reconcile(offers(spark, d), totals, "ads_id").filter("total is not null").drop("total")


@query("SELECT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def missing_items(spark: SparkSession, d: str) -> DataFrame:
    """JN2."""
    found = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"))
    return relational.missing(read(spark, d, "part").select(F.col("p_partkey").alias("part")), found, "part")


@query(f"WITH {OFFERS_SQL}, f AS (SELECT part, price, ads_id, line FROM offers WHERE supplier % 5 = 0 QUALIFY row_number() OVER (PARTITION BY part ORDER BY ads_id, line, price) = 1) SELECT p_partkey AS part, CASE WHEN f.part IS NULL THEN CAST(0 AS DECIMAL(12,2)) ELSE f.price END AS price, CASE WHEN f.part IS NULL THEN 'gibert_missing' ELSE 'gibert_price_found' END AS status FROM part LEFT JOIN f ON f.part = p_partkey")
def requested_with_default(spark: SparkSession, d: str) -> DataFrame:
    """JN1, JN3."""
    own = relational.first_wins(offers(spark, d).filter("supplier % 5 = 0"), ["part"], ["ads_id", "line", "price"]).select("part", "price", F.lit("gibert_price_found").alias("status"))
    asked = read(spark, d, "part").select(F.col("p_partkey").alias("part"))
    return relational.with_default(asked, own, "part", {"price": F.lit(0).cast("decimal(12,2)"), "status": F.lit("gibert_missing")})


@query(f"WITH {OFFERS_SQL} SELECT part, CASE WHEN min(price) = max(price) THEN max(price) END AS price FROM offers GROUP BY 1")
def single_distinct_price(spark: SparkSession, d: str) -> DataFrame:
    """AG19."""
    return ledger.single_price(offers(spark, d), "part")


# --- joins, dedupe, sets


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    """JN12, PRD4."""
    who = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return relational.exists(read(spark, d, "orders"), who, ["o_custkey"]).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    """JN13."""
    return relational.not_exists(read(spark, d, "customer"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


_A = "SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_quantity > 45"
_B = "SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_discount < 0.02"


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = read(spark, d, "lineitem")
    of = lambda c: li.filter(c).select(F.col("l_partkey").alias("part"))
    return of("l_quantity > 45"), of("l_discount < 0.02")


@query(f"WITH a AS ({_A}), b AS ({_B}) SELECT part, 'left_only' AS side FROM a WHERE part NOT IN (SELECT part FROM b) UNION ALL SELECT part, 'right_only' FROM b WHERE part NOT IN (SELECT part FROM a)")
def two_way_difference(spark: SparkSession, d: str) -> DataFrame:
    """JN16, ST5."""
    return relational.two_way_difference(*_sets(spark, d), ["part"])


@query(f"({_A}) INTERSECT ({_B})")
def intersect_allowed(spark: SparkSession, d: str) -> DataFrame:
    """JN23, ST4."""
    a, b = _sets(spark, d)
    return a.intersect(b)


@query(f"WITH u AS (SELECT part, 0 AS s FROM ({_A}) UNION ALL SELECT part, 1 FROM ({_B})), m AS (SELECT part, min(s) AS s FROM u GROUP BY 1) SELECT part FROM m ORDER BY s, part LIMIT 50")
def union_distinct_capped(spark: SparkSession, d: str) -> DataFrame:
    """ST1 (the cap is the feature)."""
    a, b = _sets(spark, d)
    return relational.union_capped(a.withColumn("o", F.col("part")), b.withColumn("o", F.col("part")), "part", "o", 50)


@query(f"WITH {OFFERS_SQL} SELECT part, ads_id, line, price FROM offers QUALIFY row_number() OVER (PARTITION BY part ORDER BY price DESC, ads_id, line) = 1")
def best_per_key_argmax(spark: SparkSession, d: str) -> DataFrame:
    """AG9."""
    return relational.first_wins(offers(spark, d), ["part"], [F.desc("price"), "ads_id", "line"]).select("part", "ads_id", "line", "price")


@query("SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """AG10."""
    return relational.first_wins(read(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"])


@query(f"WITH {OFFERS_SQL} SELECT part, ads_id, line, price, CAST(row_number() OVER (PARTITION BY part ORDER BY price DESC, ads_id, line) AS INT) AS rank FROM offers QUALIFY rank <= 2")
def alternatives_topk(spark: SparkSession, d: str) -> DataFrame:
    """TK7, WN4."""
    return relational.top_per_key(offers(spark, d), ["part"], [F.desc("price"), "ads_id", "line"], 2, "rank").select("part", "ads_id", "line", "price", "rank")


@query(f"""WITH {OFFERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ads_id ORDER BY CASE WHEN supplier % 3 = 0 THEN 0 ELSE 1 END, price DESC, line, part) AS place_no FROM offers),
c AS (SELECT ads_id, supplier % 7 AS image_url, min(place_no) AS f, array_to_string(list(part ORDER BY place_no), ',') AS isbns FROM r GROUP BY 1, 2)
SELECT ads_id, CAST(image_url AS VARCHAR) AS image_url, isbns, CAST(row_number() OVER (PARTITION BY ads_id ORDER BY f) AS INT) AS place FROM c""")
def cover_group_collect(spark: SparkSession, d: str) -> DataFrame:
    """TK6, AG12."""
    rows = offers(spark, d).select(
        "ads_id", F.col("part").alias("isbn13"), (F.col("supplier") % 7).cast("string").alias("image_url"), (F.col("supplier") % 3 == 0).alias("is_pipeline"), F.col("price").alias("title_similarity"), (F.col("line").cast("long") * 1_000_000_000 + F.col("part")).alias("ord")
    )
    return relational.cover_plan(rows, "ads_id", 3).select("ads_id", "image_url", F.array_join(F.transform("isbns", lambda x: x.cast("string")), ",").alias("isbns"), "place")


_COVERS = """covers AS (SELECT l_orderkey AS ads_id, l_partkey AS isbn13, 1 - CAST(round(l_discount * 100) AS INT) / 40.0 - (l_linenumber % 3) / 50.0 AS similarity,
  0.6 + (l_linenumber % 4) / 10.0 AS confidence, CASE WHEN l_partkey % 4 = 0 THEN 'mismatch' ELSE 'match' END AS match_status FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY ads_id ORDER BY similarity DESC, confidence DESC, isbn13) AS rk, match_status = 'match' AND similarity >= 0.8 AND confidence >= 0.7 AS strong FROM covers)"""


def _covers(spark: SparkSession, d: str) -> DataFrame:
    sim = 1 - F.round(F.col("l_discount") * 100).cast("int") / 40.0 - (F.col("l_linenumber") % 3) / 50.0
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("ads_id"), F.col("l_partkey").alias("isbn13"), sim.cast("double").alias("similarity"),
        (F.lit(0.6) + (F.col("l_linenumber") % 4) / 10.0).alias("confidence"), F.when(F.col("l_partkey") % 4 == 0, "mismatch").otherwise("match").alias("match_status"),
    )


@query(f"""WITH {_COVERS}, g AS (SELECT *, coalesce(round(similarity - lead(similarity) OVER (PARTITION BY ads_id ORDER BY rk), 2), 1) AS gap FROM rk)
SELECT ads_id, CASE WHEN strong AND gap >= 0.15 THEN 'selected' WHEN similarity < 0.45 THEN 'no_match' ELSE 'needs_verification' END AS decision FROM g WHERE rk = 1""")
def rank_gap_decision(spark: SparkSession, d: str) -> DataFrame:
    """WN5, TK5, CLS21."""
    return relational.single_winner(_covers(spark, d), "ads_id").select("ads_id", "decision")


@query(f"""WITH {_COVERS}, p AS (SELECT *, CASE WHEN strong THEN sum(CAST(strong AS INT)) OVER (PARTITION BY ads_id ORDER BY rk) END AS place FROM rk),
t AS (SELECT *, max(similarity) FILTER (place = 1) OVER (PARTITION BY ads_id) AS top FROM p),
g AS (SELECT ads_id, max(similarity) AS best, count(*) FILTER (strong) AS n, count(*) FILTER (strong AND round(top - similarity, 6) <= 0.1) AS size, max(top) AS top, max(similarity) FILTER (place = 2) AS second, max(isbn13) FILTER (place = 1) AS top_isbn FROM t GROUP BY 1),
c AS (SELECT *, CASE WHEN best < 0.45 THEN 'no_match' WHEN n = 0 THEN 'needs_verification' WHEN n = 1 OR (size = 1 AND round(top - second, 2) >= 0.15) THEN 'selected_exact_isbn' WHEN size BETWEEN 2 AND 3 THEN 'selected_cover_ambiguous_isbn' ELSE 'needs_verification' END AS decision FROM g)
SELECT ads_id, decision, CASE WHEN decision = 'selected_exact_isbn' THEN top_isbn END AS isbn13, CAST(CASE decision WHEN 'selected_exact_isbn' THEN 1 WHEN 'selected_cover_ambiguous_isbn' THEN size ELSE 0 END AS INT) AS cluster_size FROM c""")
def cover_cluster_decision(spark: SparkSession, d: str) -> DataFrame:
    """WN6, CLS22."""
    return relational.cover_cluster(_covers(spark, d), "ads_id")


@query("SELECT p_partkey AS part, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 10) AS INT) AS batch_no FROM part")
def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    """TK14."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_brand")
    return relational.batches(rows, ["p_brand"], ["part"], 10).select("part", "batch_no")


@query(f"WITH {OFFERS_SQL}, o AS (SELECT ads_id, part, min(line) AS line FROM offers GROUP BY 1, 2) SELECT ads_id, part FROM o QUALIFY row_number() OVER (PARTITION BY ads_id ORDER BY line, part) <= 3")
def distinct_capped_per_listing(spark: SparkSession, d: str) -> DataFrame:
    """WN9 (the cap is the feature)."""
    return relational.distinct_capped(offers(spark, d), ["ads_id"], "part", ["line", "part"], 3).select("ads_id", "part")


@query(f"WITH {OFFERS_SQL} SELECT ads_id, line, coalesce(sum(price) OVER (PARTITION BY ads_id ORDER BY line, part, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5000 AS allowed FROM offers")
def budget_in_order(spark: SparkSession, d: str) -> DataFrame:
    """WN8."""
    return relational.within_budget(offers(spark, d), ["ads_id"], ["line", "part", "price"], "price", 5000).select("ads_id", "line", "allowed")


# --- merges


_TARGET = "t AS (SELECT p_partkey AS part, p_size AS size, CASE WHEN p_partkey % 5 = 0 THEN 'validated' ELSE 'new' END AS admin_status, CASE WHEN p_partkey % 3 = 0 THEN 'momox_price_found' ELSE 'momox_pending' END AS momox_status FROM part WHERE p_partkey % 4 <> 0)"
_SOURCE = "s AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 7 <> 0 THEN p_size + 1 END AS size, 'pending' AS admin_status, CASE WHEN p_partkey % 2 = 0 THEN 'momox_pending' ELSE 'momox_no_offer' END AS momox_status FROM part WHERE p_partkey % 3 = 0)"


def _merge_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, d, "part").withColumn("part", F.col("p_partkey"))
    target = p.filter("p_partkey % 4 <> 0").selectExpr("part", "p_size AS size", "CASE WHEN part % 5 = 0 THEN 'validated' ELSE 'new' END AS admin_status", "CASE WHEN part % 3 = 0 THEN 'momox_price_found' ELSE 'momox_pending' END AS momox_status")
    source = p.filter("p_partkey % 3 = 0").selectExpr("part", "CASE WHEN part % 7 <> 0 THEN p_size + 1 END AS size", "'pending' AS admin_status", "CASE WHEN part % 2 = 0 THEN 'momox_pending' ELSE 'momox_no_offer' END AS momox_status")
    return target, source


@query(f"""WITH {_TARGET}, {_SOURCE} SELECT coalesce(t.part, s.part) AS part, coalesce(s.size, t.size) AS size,
  CASE WHEN t.part IS NULL THEN s.admin_status WHEN s.part IS NULL OR t.admin_status IN ('validated', 'rejected') THEN t.admin_status ELSE coalesce(s.admin_status, t.admin_status) END AS admin_status,
  CASE WHEN t.part IS NULL THEN s.momox_status WHEN s.part IS NULL OR (t.momox_status IN ('momox_price_found', 'momox_no_offer') AND s.momox_status IN ('momox_pending', 'not_sent')) THEN t.momox_status ELSE s.momox_status END AS momox_status
FROM t FULL JOIN s ON t.part = s.part""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SNK2, SNK3."""
    return merge.merge(*_merge_sides(spark, d), ["part"], merge.BOOK_POLICY)


@query(f"WITH {_TARGET}, {_SOURCE} SELECT * FROM t UNION ALL SELECT * FROM s WHERE part NOT IN (SELECT part FROM t)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """SNK11, QS1."""
    return merge.insert_if_absent(*_merge_sides(spark, d), ["part"])


@query(f"WITH {_TARGET}, {_SOURCE} SELECT part, size, admin_status, CASE WHEN part IN (SELECT part FROM s) AND momox_status IN ('not_sent', 'momox_pending', 'gibert_pending') AND admin_status NOT IN ('validated', 'rejected') THEN 'momox_failed' ELSE momox_status END AS momox_status FROM t")
def guarded_update(spark: SparkSession, d: str) -> DataFrame:
    """SNK7, SNK8."""
    t, s = _merge_sides(spark, d)
    return merge.mark_failed(t, s, ["part"], "momox_status", "momox_failed")


# --- queue, timeline, ledger


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def last_n_events_per_key(spark: SparkSession, d: str) -> DataFrame:
    """WN1."""
    return relational.top_per_key(read(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1")
def latest_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    """WN2, WN3."""
    return relational.first_wins(read(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 200")
def queue_claim_order(spark: SparkSession, d: str) -> DataFrame:
    """TK1, TK2, QS4 (the limit is the feature)."""
    rows = read(spark, d, "orders").filter("o_orderstatus = 'O'")
    return relational.queue_head(rows, ["o_orderpriority", "o_orderdate", "o_orderkey"], 200).select("o_orderkey", "o_orderpriority")


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first_of_type FROM events")
def event_timeline_running_progress(spark: SparkSession, d: str) -> DataFrame:
    """WN7."""
    return relational.running_progress(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "progress", "first_of_type")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_props_filter(spark: SparkSession, d: str) -> DataFrame:
    """PRD14, PRD15."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return read(spark, d, "events").select("event_id", k.alias("k")).filter("k > 50")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG1."""
    return ledger.status_counts(read(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"))


@query(f"WITH {OFFERS_SQL} SELECT ads_id, CAST(sum(CASE WHEN supplier % 2 = 0 THEN CAST(price AS DECIMAL(18,6)) ELSE CAST(round(CAST(price AS DECIMAL(18,6)) * CAST('0.00015' AS DECIMAL(10,6)), 6) AS DECIMAL(18,6)) END) AS DECIMAL(28,6)) AS usd, count(*) AS events FROM offers GROUP BY 1")
def cost_by_listing(spark: SparkSession, d: str) -> DataFrame:
    """AG7, NM3, SNK13."""
    rows = offers(spark, d).withColumn("amount_usd", numbers.amount_usd(F.col("price"), F.when(F.col("supplier") % 2 == 0, "USD").otherwise("SCRAPFLY_CREDIT")))
    return ledger.cost_totals(rows, "ads_id")


@query(f"WITH {OFFERS_SQL}, n AS (SELECT DISTINCT supplier, ads_id FROM offers), c AS (SELECT supplier, count(*) AS n FROM n GROUP BY 1), r AS (SELECT supplier, sum(price) AS cost FROM offers GROUP BY 1) SELECT n.supplier AS run_id, n.ads_id, CAST((CAST(cost * 100 AS HUGEINT) * 10000 * 2 + c.n) // (2 * c.n) AS BIGINT) AS share_millionths FROM n JOIN c USING (supplier) JOIN r USING (supplier)")
def cost_equal_allocation(spark: SparkSession, d: str) -> DataFrame:
    """AG17."""
    rows = offers(spark, d).withColumnRenamed("supplier", "run_id")
    runs = rows.groupBy("run_id").agg(F.sum("price").alias("cost_usd"))
    out = ledger.equal_shares(runs, rows.select("run_id", "ads_id"))
    return out.select("run_id", "ads_id", (F.col("share_usd") * 1_000_000).cast("bigint").alias("share_millionths"))


@query("SELECT user_id, sha256(CAST(user_id AS VARCHAR) || '|' || event_type || '|' || CAST(epoch_us(ts) // 60000000 AS VARCHAR)) AS idempotency_key, min(event_id) AS event_id FROM events GROUP BY ALL")
def idempotent_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """QS1, HS1, DT2."""
    ev = read(spark, d, "events")
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", queue.minute_bucket(F.col("ts")).cast("string")), 256)
    return queue.enqueue_once(ev.withColumn("idempotency_key", key), "idempotency_key", ["event_id"]).select("user_id", "idempotency_key", "event_id")


_ACTIVE = "SELECT user_id, event_id FROM (SELECT *, event_type IN ('view', 'click') AS start, lag(event_type IN ('view', 'click')) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE start AND before IS DISTINCT FROM true"


def _job_events(ev: DataFrame) -> DataFrame:
    return ev.select("user_id", "event_id", F.when(F.col("event_type").isin("view", "click"), "enqueue").otherwise("end").alias("kind"))


@query(_ACTIVE)
def active_job_per_key(spark: SparkSession, d: str) -> DataFrame:
    """QS3 in batch."""
    return queue.accepted_jobs(_job_events(read(spark, d, "events")), "user_id", ["event_id"]).select("user_id", "event_id")


@query("SELECT DISTINCT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def stream_idempotent_ingest(spark: SparkSession, d: str) -> DataFrame:
    """QS1 on a stream: the key is user, event type and day, so that a key's state can go two days after it."""
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    keyed = lambda ev: ev.select("ts", "user_id", "event_type", day.alias("day"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type", day).alias("key"))
    return streamed(spark, d, lambda ev: queue.stream_once(keyed(ev), "key", "ts", "2 days")).select("user_id", "event_type", "day")


@query(_ACTIVE)
def stream_active_job(spark: SparkSession, d: str) -> DataFrame:
    """QS3 on a stream."""
    return streamed(spark, d, lambda ev: queue.stream_active_jobs(_job_events(ev), "user_id", "event_id"), **ROCKS)


# --- scalars


@query(f"SELECT p_partkey AS part, {isbn_sql('p_partkey')} AS isbn13, true AS valid, false AS broken_valid FROM part")
def isbn13_validate(spark: SparkSession, d: str) -> DataFrame:
    """IS1, IS2: numbers of all parts, and the same with another check digit."""
    n = isbn.synthetic(F.col("p_partkey"))
    broken = F.concat(F.substring(n, 1, 12), F.pmod(F.substring(n, 13, 1).cast("int") + 1, F.lit(10)).cast("string"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("part"), n.alias("isbn13"), isbn.valid13(isbn.clean(F.concat(F.lit(" "), n))).alias("valid"), isbn.valid13(broken).alias("broken_valid"))


_TEN = "(lpad(CAST(p_partkey AS VARCHAR), 9, '0'))"
_CHECK10 = f"(11 - list_sum(list_transform(range(1, 10), lambda i: CAST(substr({_TEN}, CAST(i AS INT), 1) AS INT) * (11 - i))) % 11) % 11"


@query(f"SELECT p_partkey AS part, {_TEN} || CASE WHEN {_CHECK10} = 10 THEN 'X' ELSE CAST({_CHECK10} AS VARCHAR) END AS isbn10, {isbn_sql('p_partkey')} AS back FROM part")
def isbn13_to_10(spark: SparkSession, d: str) -> DataFrame:
    """IS4, IS5: to ten digits and back."""
    ten = isbn.thirteen_to_ten(isbn.synthetic(F.col("p_partkey")))
    return read(spark, d, "part").select(F.col("p_partkey").alias("part"), ten.alias("isbn10"), isbn.ten_to_thirteen(ten).alias("back"))


@query(f"SELECT p_partkey AS part, {isbn_sql('p_partkey')} AS isbn13, p_partkey % 2 = 1 AS repaired FROM part")
def isbn_repair(spark: SparkSession, d: str) -> DataFrame:
    """IS6, IS7: every other number has a wrong check digit and hyphens."""
    n = isbn.synthetic(F.col("p_partkey"))
    wrong = F.concat(F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 9), F.lit("-"), F.pmod(F.substring(n, 13, 1).cast("int") + 3, F.lit(10)).cast("string"))
    r = isbn.resolve(F.when(F.col("p_partkey") % 2 == 1, wrong).otherwise(n))
    return read(spark, d, "part").select(F.col("p_partkey").alias("part"), r["isbn13"].alias("isbn13"), r["repaired"].alias("repaired"))


@query(f"SELECT p_partkey AS part, {isbn_sql('p_partkey')} AS isbn13, 'isbn13' AS via FROM part")
def isbn_in_text(spark: SparkSession, d: str) -> DataFrame:
    """IS8: a number inside a sentence."""
    n = isbn.synthetic(F.col("p_partkey"))
    said = F.concat(F.col("p_name"), F.lit(", ISBN "), F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 10), F.lit("; order 123456789X."))
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.explode(isbn.find_in_text(said)).alias("f"))
    return rows.select("part", "f.isbn13", "f.via").filter("via = 'isbn13'")


@query(f"SELECT doc_id, {ASCII_SQL('text')} AS norm FROM documents")
def normalize_text_ascii(spark: SparkSession, d: str) -> DataFrame:
    """TX2."""
    return read(spark, d, "documents").select("doc_id", T.normalize_ascii(F.col("text")).alias("norm"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM documents")
def normalize_text_unicode(spark: SparkSession, d: str) -> DataFrame:
    """TX1."""
    return read(spark, d, "documents").select("doc_id", T.normalize_unicode(F.col("text")).alias("norm"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(strip_accents(replace(replace(lower(text), 'œ', 'oe'), 'æ', 'ae')), '&', ' and '), '+', ' plus '), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM documents")
def normalize_match_text(spark: SparkSession, d: str) -> DataFrame:
    """TX5."""
    return read(spark, d, "documents").select("doc_id", T.normalize_match(F.col("text")).alias("norm"))


def _shared_sql(tokens: str) -> str:
    """(doc_id, item_id, n, m, shared) for each document and benchmark item with a token in common."""
    each = lambda t, k: f"SELECT {k}, len(w) AS {'n' if k == 'doc_id' else 'm'}, unnest(w) AS token FROM (SELECT {k}, {tokens} AS w FROM {t})"
    return f"a AS ({each('documents', 'doc_id')}), b AS ({each('benchmark', 'item_id')}), c AS (SELECT doc_id, item_id, n, m, count(*) AS shared FROM a JOIN b USING (token) GROUP BY ALL)"


_TOKENS = f"list_distinct(list_filter(string_split({ASCII_SQL('text')}, ' '), lambda t: length(t) > 1))"
_STOPPED = f"list_distinct(list_filter(string_split({ASCII_SQL('text')}, ' '), lambda t: length(t) > 0 AND NOT list_contains({list(T.STOP_TITLE)!r}, t)))"


@query(f"WITH {_shared_sql(_TOKENS)}, s AS (SELECT doc_id, round(CAST(shared AS DOUBLE) / (n + m - shared), 3) AS similarity FROM c) SELECT d.doc_id, coalesce(max(similarity), 0) AS similarity FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY 1")
def title_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """SIM4: the best similarity of each whole document to any benchmark item."""
    best = set_join.best_of_left(*token_sides(spark, d, lambda c: T.token_set(T.normalize_ascii(c), 2)))
    best = best.select(F.col("l").alias("doc_id"), F.round("score", 3).alias("similarity"))
    return read(spark, d, "documents").select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


@query(f"WITH {_shared_sql(_STOPPED)}, s AS (SELECT doc_id, count(*) AS items FROM c WHERE shared * 2 >= least(n, m) GROUP BY 1) SELECT d.doc_id, coalesce(items, 0) AS compatible_items FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id")
def titles_compatible(spark: SparkSession, d: str) -> DataFrame:
    """SIM5: with how many benchmark items each whole document is compatible."""
    items = set_join.overlapping(*token_sides(spark, d, T.title_tokens)).groupBy(F.col("l").alias("doc_id")).agg(F.count("*").alias("items"))
    return read(spark, d, "documents").select("doc_id").join(items, "doc_id", "left").select("doc_id", F.coalesce("items", F.lit(0)).alias("compatible_items"))


_NORM = lambda x: f"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SIDE = lambda t: f"list_distinct(list_filter(string_split({_NORM(t)}, ' '), lambda w: length(w) >= 2 AND NOT list_contains({list(T.STOP_SIMILARITY)!r}, w))) AS w, {_NORM(f'string_split_regex({t}, {chr(39)}[:;(\\[]{chr(39)})[1]')} AS p"
_LINE_SQL = f"""l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), x AS (SELECT t, {_SIDE('t')} FROM (SELECT DISTINCT t FROM l)), y AS (SELECT item_id, {_SIDE('text')} FROM benchmark),
c AS (SELECT t, item_id, CAST(len(list_intersect(x.w, y.w)) AS DOUBLE) AS i, least(len(x.w), len(y.w)) AS low, greatest(len(x.w), len(y.w)) AS high, least(length(x.p), length(y.p)) >= 12 AND (x.p = y.p OR starts_with(x.p, y.p || ' ') OR starts_with(y.p, x.p || ' ')) AS pre FROM x, y),
s AS (SELECT t, item_id, CASE WHEN low = 0 THEN 0.0 WHEN pre THEN greatest(i / high, 0.9) WHEN low >= 2 AND i / low >= 0.85 THEN greatest(i / high, i / low) ELSE i / high END AS sim FROM c),
b AS (SELECT doc_id, item_id, max(sim) AS similarity FROM l JOIN s USING (t) GROUP BY 1, 2)"""


@query(f"WITH {_LINE_SQL} SELECT doc_id, max(similarity) AS similarity FROM b GROUP BY 1")
def token_similarity(spark: SparkSession, d: str) -> DataFrame:
    """SIM1 (prefix and containment rules): each document's best similarity of any of its lines to any benchmark item."""
    left, right, members, started = line_sides(spark, d)
    best = set_join.best_by_group(left, right, members, line_measure, started).select(F.col("g").alias("doc_id"), F.col("score").alias("similarity"))
    ids = read(spark, d, "documents").select(F.col("doc_id").alias("id")).distinct()
    return ids.join(best, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(F.col("id").alias("doc_id"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


@query(f"WITH {_LINE_SQL}, o AS (SELECT item_id, doc_id, floor(least(1.0, similarity * 0.8 + CASE WHEN similarity >= 0.9 THEN 0.1 ELSE 0 END) * 100 + 0.5) / 100 AS score FROM b WHERE similarity > 0) SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM o QUALIFY rank <= 10")
def candidate_score_top10(spark: SparkSession, d: str) -> DataFrame:
    """SIM3, AG9, WN4, JN5: for each benchmark item, the best of all documents of which a line has a similarity above 0 to it."""
    left, right, members, started = line_sides(spark, d)
    score = lambda c: similarity.candidate_score([c], F.lit(None).cast("double"), F.lit(False))
    top = set_join.top_by_right(left, right, members, line_measure, 10, started, score)
    rows = top.select(F.col("r").alias("item_id"), F.col("g").alias("doc_id"), score(F.col("score")).alias("score"))
    return relational.top_per_key(rows, ["item_id"], [F.desc("score"), "doc_id"], 10, "rank").select("item_id", "doc_id", "score", "rank")


_RAW = "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) || ',5 €' WHEN 1 THEN CAST(p_size AS VARCHAR) || '€' WHEN 2 THEN 'abc' WHEN 3 THEN CAST(p_size AS VARCHAR) || '.25' ELSE '1 2' || CAST(p_size AS VARCHAR) || ',123' END"


@query(f"SELECT part, raw, CASE WHEN regexp_full_match(s, '[0-9]+(\\.[0-9]{{1,2}})?') THEN CAST(s AS DECIMAL(10,2)) END AS strict, CASE WHEN x = '' THEN 0.0 ELSE CAST(x AS DOUBLE) END AS lax FROM (SELECT *, replace(regexp_replace(replace(raw, '€', ''), '\\s+', '', 'g'), ',', '.') AS s, regexp_replace(replace(raw, ',', '.'), '[^0-9.]', '', 'g') AS x FROM (SELECT p_partkey AS part, {_RAW} AS raw FROM part))")
def price_text_parse(spark: SparkSession, d: str) -> DataFrame:
    """PR1, PR2, PR3."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.expr(_RAW.replace("VARCHAR", "STRING")).alias("raw"))
    return rows.select("part", "raw", price.french_price(F.col("raw")).alias("strict"), price.lax_price(F.col("raw")).alias("lax"))


@query("""SELECT p_partkey AS ads_id, v - 1 AS ord, p_name AS title, NULL AS author, v AS volume, CAST(round(CAST(p_size AS DECIMAL(10,2)) / 2, 2) AS DECIMAL(10,2)) AS price, true AS distributed, 2 AS group_size FROM part, (SELECT unnest([1, 2]) AS v)
  UNION ALL SELECT p_partkey, 1000, p_brand, 'Auteur', NULL, CAST(2.50 AS DECIMAL(10,2)), false, 1 FROM part""")
def description_price_lines(spark: SparkSession, d: str) -> DataFrame:
    """PR5, PR6, UD3: two lines in each part's description, a row for each entry."""
    text = F.concat_ws("\n", F.concat(F.lit("- "), F.col("p_name"), F.lit(" tome 1 et 2 : "), F.col("p_size").cast("string"), F.lit(" €")), F.concat(F.lit("« "), F.col("p_brand"), F.lit(" » Auteur / 2,50€")), F.lit("Envoi rapide possible 3€"))
    rows = spread(read(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("ads_id"), text.alias("description"))
    return price.description_entries(rows).select("ads_id", "ord", "title", "author", "volume", "price", "distributed", "group_size")


@query(f"""WITH c AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS x FROM documents),
h AS (SELECT doc_id, list_filter({list(classify.STRONG_BOOK)!r}, lambda w: contains(x, ' ' || w || ' ')) AS s, list_filter({list(classify.NON_BOOK)!r}, lambda w: contains(x, ' ' || w || ' ')) AS n, list_filter({list(classify.WEAK_BOOK)!r}, lambda w: contains(x, ' ' || w || ' ')) AS w FROM c)
SELECT doc_id, NOT (len(s) = 0 AND len(n) > 0) AS relevant, CASE WHEN len(s) > 0 OR len(n) > 0 THEN 'high' WHEN len(w) > 0 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN len(s) > 0 THEN 'book_signal:' || s[1] WHEN len(n) > 0 THEN 'non_book_signal:' || n[1] WHEN len(w) > 0 THEN 'weak_book_signal:' || w[1] ELSE 'no_clear_signal' END AS reason FROM h""")
def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    """CLS1, TX4."""
    v = classify.book_relevance(T.padded_corpus(F.col("text")))
    return read(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", "v.relevant", "v.confidence", "v.reason")


@query("""WITH c AS (SELECT doc_id, quality, toxic, (doc_id % 120) / 100.0 AS raw FROM labels), n AS (SELECT *, CASE WHEN raw > 1 THEN round(raw / 100, 2) ELSE round(raw, 2) END AS conf FROM c)
SELECT doc_id, conf, CASE WHEN quality = 0 THEN 'isbn_not_found' WHEN toxic = 1 THEN 'isbn_invalid' WHEN conf < 0.5 THEN 'isbn_weak' WHEN conf < 0.85 AND doc_id % 2 = 0 THEN 'isbn_medium_promoted' WHEN conf < 0.85 THEN 'isbn_medium' ELSE 'isbn_strong' END AS status,
  CASE WHEN quality = 0 THEN 'No valid ISBN found' WHEN toxic = 1 THEN 'Invalid ISBN' WHEN conf < 0.5 THEN 'ISBN confidence below Momox threshold' WHEN conf < 0.85 AND doc_id % 2 = 0 THEN 'Medium ISBN promoted: main title prefix + author match' END AS skip_reason,
  CASE WHEN quality = 0 THEN 'no_isbn' WHEN toxic = 1 THEN 'isbn_invalid' WHEN conf >= 0.8 THEN 'strong_isbn' WHEN conf >= 0.5 THEN 'needs_verification_medium' ELSE 'needs_verification_low' END AS reason FROM n""")
def confidence_ladder(spark: SparkSession, d: str) -> DataFrame:
    """NM1, CLS2, CLS3."""
    rows = read(spark, d, "labels").withColumn("conf", numbers.confidence((F.col("doc_id") % 120) / 100.0))
    number = F.when(F.col("quality") != 0, F.lit("x"))
    cls = classify.candidate_class(number, F.col("toxic") != 1, F.col("conf"), F.col("doc_id") % 2 == 0)
    why = classify.provider_eligibility(number, F.col("toxic") != 1, F.col("conf"), F.lit(""), F.lit(""))
    return rows.select("doc_id", "conf", cls["status"].alias("status"), cls["skip_reason"].alias("skip_reason"), why["reason"].alias("reason"))


@query("""WITH b AS (SELECT p_partkey AS part, p_size / 100.0 AS x0, 0.1 AS y0, least(1.0, p_size / 100.0 + (p_partkey % 10) / 10.0) AS x1, 0.1 + (p_partkey % 7) / 10.0 AS y1 FROM part), a AS (SELECT part, round(abs(x1 - x0) * abs(y1 - y0), 9) AS area FROM b)
SELECT part, area, CASE WHEN area < 0.05 THEN 'poor' WHEN area < 0.3 THEN 'risky' ELSE 'good' END AS level FROM a""")
def crop_quality(spark: SparkSession, d: str) -> DataFrame:
    """CLS25, NM5."""
    x0 = F.col("p_size") / 100.0
    box = F.array(x0, F.lit(0.1), F.least(F.lit(1.0), x0 + (F.col("p_partkey") % 10) / 10.0), F.lit(0.1) + (F.col("p_partkey") % 7) / 10.0)
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("part"), box.alias("box")).withColumn("area", F.round(numbers.bbox_area(F.col("box")), 9))
    level = classify.crop_level(F.array(F.lit(0.0), F.lit(0.0), F.col("area"), F.lit(1.0)))
    return rows.select("part", "area", level.alias("level"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host FROM pages")
def page_host(spark: SparkSession, d: str) -> DataFrame:
    """UR1."""
    return read(spark, d, "pages").select("page_id", pages.host(F.col("url")).alias("host"))


@query("""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title, len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS links FROM pages""")
def page_links_and_title(spark: SparkSession, d: str) -> DataFrame:
    """SRC3 in shape: title and links of each page."""
    return read(spark, d, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"), F.size(pages.page_links(F.col("html"))).cast("long").alias("links"))


@query("SELECT text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS text_hash FROM documents) GROUP BY 1")
def dedupe_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """HS1, QS14."""
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash")).groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN 'apify-webhook-run:' || p_partkey ELSE 'apify-webhook-body:' || sha256('{\"a\":' || p_size || ',\"b\":{\"c\":\"x\",\"d\":[2,1]}}') END AS key FROM part")
def idempotency_key(spark: SparkSession, d: str) -> DataFrame:
    """HS2: by run id, else by the body; the same fields in another order, at any depth, are the same body."""
    size = F.col("p_size").cast("string")
    one = F.concat(F.lit('{"b":{"d":[2,1],"c":"x"}, "a": '), size, F.lit("}"))
    other = F.concat(F.lit('{"a":'), size, F.lit(',"b":{"c":"x","d":[2,1]}}'))
    run = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("part"), misc.idempotency_key(run, F.when(F.col("p_partkey") % 2 == 0, one).otherwise(other)).alias("key"))


@query(f"WITH {PRICED_SQL} SELECT ads_id, part, CAST(CASE WHEN a IS NULL AND b IS NULL THEN -1 WHEN coalesce(a, 0) > 0 OR coalesce(b, 0) > 0 THEN 100 + least(20, CAST(floor(abs(CAST(coalesce(a, 0) AS DOUBLE) - CAST(coalesce(b, 0) AS DOUBLE)) + 0.5) AS INT)) ELSE -1 END AS INT) AS priority FROM priced")
def verify_priority(spark: SparkSession, d: str) -> DataFrame:
    """CLS32, TK9."""
    none = F.lit("")
    return priced_books(spark, d).select("ads_id", "part", classify.verify_priority(none, none, F.col("a"), F.col("b"), none).alias("priority"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'payload_processing_timeout' WHEN event_type = 'click' THEN 'duplicate_payload' WHEN event_type = 'view' THEN 'invalid_payload_timestamp' WHEN event_type = 'signup' THEN 'unsupported_webhook_mode' ELSE 'apify_payload_processing_failed' END AS code FROM events")
def job_error_codes(spark: SparkSession, d: str) -> DataFrame:
    """CLS28."""
    said = F.when(F.col("event_type") == "error", "Query read TIMEOUT").when(F.col("event_type") == "click", "duplicate key value").when(F.col("event_type") == "view", "invalid input syntax for type timestamp").when(F.col("event_type") == "signup", "Unsupported webhook mode x").otherwise("boom")
    return read(spark, d, "events").select("event_id", classify.job_error_code(said).alias("code"))


@query("SELECT l_orderkey AS ads_id, l_linenumber AS line, CASE WHEN l_quantity <= 10 THEN 'momox_no_price' WHEN l_linenumber % 2 = 0 THEN 'momox_not_real_offer' WHEN l_discount * 10 < 0.3 THEN 'momox_title_mismatch' WHEN l_discount * 10 < 0.85 THEN 'momox_price_found_needs_review' ELSE 'momox_price_found' END AS status FROM lineitem")
def offer_decision(spark: SparkSession, d: str) -> DataFrame:
    """CLS17, CLS18."""
    url = F.when(F.col("l_linenumber") % 2 == 0, "https://x.test/search").otherwise("https://x.test/offer/1")
    st = classify.offer_decision(F.col("l_quantity") > 10, F.col("l_extendedprice"), url, F.lit("t"), F.col("l_discount") * 10)
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ads_id"), F.col("l_linenumber").alias("line"), st.alias("status"))


from . import counter_queries, flow_queries, ladder_queries, metadata_queries, page_queries, queue_queries, run_queries, source_queries, text_queries, vector_queries  # noqa: E402, F401  they register their queries

__all__ = ["ORACLE_SQL", "QUERIES"]
