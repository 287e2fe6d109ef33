"""Registered queries of counters, totals, provider B's updates, predicates and SQL table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import ledger, merge
from .registry import made, made_sql, query, share, turn
from .tables import read

_DECIDED = {
    "decision": turn(1, "selected_exact_isbn", "selected_cover_ambiguous_isbn", "needs_verification", "no_match", None), "sends": turn(3, 0, 1, 2, None), "union_candidates": turn(5, 0, 1, 4, None), "send_isbns": turn(7, 0, 2, 3),
    "searches": turn(11, 0, 1, None), "vision_usd": share(13),
}


@query(f"""WITH {made_sql(_DECIDED)} SELECT ads_id, count(*) AS detected_books, count(*) FILTER (decision = 'selected_exact_isbn') AS selected_exact_isbn, count(*) FILTER (decision = 'selected_cover_ambiguous_isbn') AS selected_cover_ambiguous_isbn,
  count(*) FILTER (decision = 'needs_verification') AS needs_verification, count(*) FILTER (decision = 'no_match') AS no_match, count(*) FILTER (sends > 0) AS books_with_sends, CAST(coalesce(sum(sends), 0) AS BIGINT) AS total_would_send,
  CAST(coalesce(sum(union_candidates), 0) AS BIGINT) AS total_candidates, CAST(coalesce(sum(greatest(0, coalesce(union_candidates - send_isbns, 0))), 0) AS BIGINT) AS provider_sends_avoided,
  CAST(coalesce(sum(searches), 0) AS BIGINT) AS keyword_searches_used, CAST(round(sum(CAST(vision_usd AS DECIMAL(18,6))), 2) AS DOUBLE) AS est_vision_usd, CAST(coalesce(sum(searches), 0) AS BIGINT) AS est_scrapfly_credits FROM r GROUP BY 1""")
def decision_totals(spark: SparkSession, d: str) -> DataFrame:
    """AG3: all twelve totals of each listing."""
    sends = F.when(F.col("sends").isNotNull(), F.slice(F.array(F.lit("a"), F.lit("b")), 1, F.col("sends")))
    return ledger.decision_totals(made(spark, d, _DECIDED).withColumn("would_send", sends)).withColumn("est_vision_usd", F.col("est_vision_usd").cast("double"))


_RUN = {
    "outcome": turn(1, "processed", "error", "non_book", "no_image", "retry", "already_processed", "processed"), "read": turn(3, True, False), "step": turn(5, None, "momox_batch", "gibert_batch", "momox_apify_fallback"),
    **{c: turn(i + 2, 0, 1, i, None) for i, c in enumerate(ledger.SUMMED)},
}


@query(f"""WITH {made_sql(_RUN)} SELECT 'counter' AS kind, name, CAST(value AS BIGINT) AS value FROM (SELECT count(*) FILTER (outcome <> 'already_processed') AS ads_to_process, count(*) FILTER (outcome = 'already_processed') AS skipped_already_processed_ads,
  count(*) FILTER (outcome = 'no_image') AS skipped_no_image, count(*) FILTER (outcome = 'non_book') AS early_rejected_non_book, count(*) FILTER (read) AS openai_processed, count(*) FILTER (outcome IN ('processed', 'no_image', 'non_book', 'error')) AS ads_processed,
  count(*) FILTER (outcome = 'retry') AS ads_kept_new_for_retry, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ledger.SUMMED)} FROM r) UNPIVOT (value FOR name IN (*))
UNION ALL SELECT 'error', step || ': ' || outcome, count(*) FROM r WHERE step IS NOT NULL GROUP BY ALL""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """AG13, UD7: the counters of a run, observed while its listings are written, and its errors by step."""
    import uuid

    from ..shipping import shared_dir

    ads = made(spark, d, _RUN).withColumn("errors", F.when(F.col("step").isNotNull(), F.array(F.struct("step", F.col("outcome").alias("error")))).otherwise(F.array().cast("array<struct<step:string,error:string>>")))
    counters, errors = ledger.counted_write(ads, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}")
    rows = spark.createDataFrame([("counter", n, v) for n, v in counters.items()], "kind string, name string, value long")
    return rows.union(errors.groupBy(F.concat_ws(": ", "step", "error").alias("name")).agg(F.count("*").alias("value")).select(F.lit("error"), "name", "value"))


# --- provider B

_B_BOOKS = {
    "status": turn(1, "momox_no_price", "momox_failed", "momox_price_found", "isbn_strong"), "momox_price": turn(2, 0, 3.5, None, 1), "gibert_price": turn(3, None, 2.25, 0), "cost": turn(5, None, 2, 0.5), "candidate_status": turn(7, "strong_candidate", "duplicate_selected", "alternative_edition"),
    "admin_status": turn(11, "pending", "validated", "pending_edition_choice", "new"), "b_price": turn(13, "4.5", "0", None, "2.25", "x"), "b_title": turn(17, None, "", "t"), "hit": turn(19, True, True, False), "ok": turn(23, True, False),
}
_NUMBER = "CASE WHEN b_price IN ('4.5', '2.25', '0') THEN CAST(b_price AS DOUBLE) ELSE 0 END"
_BEST = "greatest(coalesce(momox_price, 0), p)"
_PLATFORM = "CASE WHEN coalesce(momox_price, 0) <= 0 AND p <= 0 THEN NULL WHEN p > coalesce(momox_price, 0) THEN 'gibert' ELSE 'momox' END"


def _b_books(spark: SparkSession, d: str) -> DataFrame:
    dec = lambda c: F.col(c).cast("decimal(10,2)").alias(c)
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = made(spark, d, _B_BOOKS).withColumn("book_id", F.monotonically_increasing_id())
    return rows.select(
        "ads_id", "line", "k", "book_id", "status", dec("momox_price"), dec("gibert_price"), dec("cost"), "candidate_status", "admin_status", F.lit("old").alias("gibert_title"), none("gibert_image_url", "string"), F.lit("before").alias("gibert_status"),
        none("gibert_checked_at", "timestamp"), none("profit_gibert", "decimal(10,2)"), F.lit(9).cast("decimal(10,2)").alias("best_resale_price"), F.lit("x").alias("best_resale_platform"), none("updated_at", "timestamp"), "b_price", "b_title", "hit", "ok",
    )


def _b_shown(out: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).cast("double").alias(c)
    return out.select("ads_id", "line", "k", "status", number("gibert_price"), "gibert_title", "gibert_status", F.col("gibert_checked_at").isNotNull().alias("checked"), number("profit_gibert"), number("best_resale_price"), "best_resale_platform", "candidate_status", "admin_status")


@query(f"""WITH {made_sql(_B_BOOKS)}, b AS (SELECT *, {_NUMBER} AS p FROM r)
SELECT ads_id, line, k, status, CAST(CASE WHEN hit THEN p ELSE gibert_price END AS DOUBLE) AS gibert_price, CASE WHEN hit AND b_title = 't' THEN 't' ELSE 'old' END AS gibert_title, CASE WHEN hit THEN 'said' ELSE 'before' END AS gibert_status, hit AS checked,
  CAST(CASE WHEN hit THEN p - cost END AS DOUBLE) AS profit_gibert, CAST(CASE WHEN hit THEN {_BEST} ELSE 9 END AS DOUBLE) AS best_resale_price, CASE WHEN hit THEN {_PLATFORM} ELSE 'x' END AS best_resale_platform,
  CASE WHEN NOT hit OR candidate_status IN ('duplicate_selected', 'alternative_edition') THEN candidate_status WHEN p > 0 THEN 'resale_price_found' WHEN {_PLATFORM} IS NULL AND status IN ('momox_no_price', 'momox_price_found') THEN 'no_resale_offer' ELSE candidate_status END AS candidate_status,
  CASE WHEN hit AND p > 0 AND admin_status NOT IN ('validated', 'pending_edition_choice') THEN 'new' ELSE admin_status END AS admin_status FROM b""")
def provider_b_batch(spark: SparkSession, d: str) -> DataFrame:
    """SNK5: provider B's batch on its books."""
    books = _b_books(spark, d)
    rows = books.filter("hit").select("book_id", F.col("b_price").alias("price"), F.col("b_title").alias("title"), F.lit(None).cast("string").alias("image_url"), F.lit("said").alias("status"))
    return _b_shown(merge.apply_provider_b_batch(books.drop("b_price", "b_title", "hit", "ok"), rows, F.lit("2024-01-01").cast("timestamp")))


@query(f"""WITH {made_sql(_B_BOOKS)}, b AS (SELECT *, {_NUMBER} AS p, hit AND ok AS good FROM r)
SELECT ads_id, line, k, CASE WHEN good AND p > 0 THEN 'gibert_price_found' ELSE status END AS status, CAST(CASE WHEN good THEN p ELSE gibert_price END AS DOUBLE) AS gibert_price, 'old' AS gibert_title,
  CASE WHEN NOT hit THEN 'before' WHEN NOT ok THEN 'gibert_failed' WHEN p > 0 THEN 'gibert_price_found' ELSE 'gibert_non_repris' END AS gibert_status, good AS checked, CAST(CASE WHEN good THEN p - cost END AS DOUBLE) AS profit_gibert,
  CAST(CASE WHEN good THEN {_BEST} ELSE 9 END AS DOUBLE) AS best_resale_price, CASE WHEN good THEN {_PLATFORM} ELSE 'x' END AS best_resale_platform, CASE WHEN good AND p > 0 THEN 'resale_price_found' ELSE candidate_status END AS candidate_status,
  CASE WHEN good AND p > 0 AND admin_status <> 'validated' THEN 'new' ELSE admin_status END AS admin_status FROM b""")
def provider_b_lookup(spark: SparkSession, d: str) -> DataFrame:
    """SNK6: provider B's single lookups; a failed one changes its status alone."""
    books = _b_books(spark, d)
    rows = books.filter("hit").select("book_id", "ok", F.col("b_price").alias("price"))
    return _b_shown(merge.apply_provider_b_lookup(books.drop("b_price", "b_title", "hit", "ok"), rows, F.lit("2024-01-01").cast("timestamp")))


# --- predicates, table functions


@query("""SELECT event_id, event_type AS kind, value, CASE WHEN value >= 50 THEN 'high' WHEN value >= 10 THEN 'middle' ELSE 'low' END AS level, coalesce(nullif(event_type, 'view'), 'seen') AS role, nullif(value, 0) IS NULL AS nothing
FROM events WHERE event_type IN ('error', 'purchase', 'view') AND event_type NOT IN ('click', 'signup') AND event_type IS DISTINCT FROM 'error' AND (event_type = 'view' OR user_id % 3 = 0) AND value IS NOT NULL AND props IS NOT NULL""")
def predicate_forms(spark: SparkSession, d: str) -> DataFrame:
    """PRD1 to PRD9: projection with alias, =, IN, NOT IN, ANY of a list, optional parameters, null tests, IS DISTINCT FROM, COALESCE, NULLIF, CASE.

    The query's parameters are bound, not written into the text; one that is null asks for nothing.
    """
    read(spark, d, "events").createOrReplaceTempView("folioforge_events")
    text = """
        SELECT event_id, event_type AS kind, value, CASE WHEN value >= 50 THEN 'high' WHEN value >= 10 THEN 'middle' ELSE 'low' END AS level, coalesce(nullif(event_type, 'view'), 'seen') AS role, nullif(value, 0) IS NULL AS nothing
        FROM folioforge_events WHERE event_type IN ('error', 'purchase', 'view') AND event_type NOT IN ('click', 'signup') AND event_type IS DISTINCT FROM 'error'
        AND (:users IS NULL OR event_type = 'view' OR array_contains(:users, CAST(user_id % 3 AS INT))) AND (:least IS NULL OR value >= :least) AND value IS NOT NULL AND NOT props IS NULL"""
    return spark.sql(text, {"users": F.array(F.lit(0)), "least": None})


@query("""WITH t AS (SELECT p_partkey AS part, '978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS core FROM part),
n AS (SELECT part, core, CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(core, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR) AS c FROM t)
SELECT part, core || c AS isbn13, via, place FROM n, (VALUES ('isbn13', 0), ('amazon_dp', 2), ('isbn10', 3)) AS v(via, place)""")
def numbers_by_table_function(spark: SparkSession, d: str) -> DataFrame:
    """UD3, IS8: a table function of SQL, called sideways: a row for each number in a text."""
    from ..functions import isbn

    sql.register(spark)
    n = isbn.synthetic(F.col("p_partkey"))
    ten = isbn.thirteen_to_ten(n)
    wrong = F.concat(F.substring(n, 1, 12), (F.substring(n, 13, 1).cast("int") + 1) % 10)  # its check digit is off
    spaced = F.concat(F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 5), F.lit(" "), F.substring(n, 9, 5))
    read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit("see "), spaced, F.lit(" or https://x/dp/"), ten, F.lit(" not "), wrong, F.lit("; ten "), ten, F.lit(".")).alias("said")).createOrReplaceTempView("folioforge_texts")
    rows = spark.sql("SELECT part, f.isbn13, f.via, f.at FROM folioforge_texts, LATERAL numbers_in(said) AS f")
    # the path's ten digits are found as bare ones too; the first of each way of finding a number stays
    return rows.groupBy("part", "isbn13", "via").agg(F.min("at").alias("place"))


@query("""WITH c AS (SELECT l_orderkey AS book_id, l_linenumber AS pos, l_partkey % 5 AS number, l_suppkey % 4 AS kind, CAST(l_discount * 10 AS DOUBLE) AS score, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY book_id, number ORDER BY pos) AS first FROM c WHERE score >= 0.5 AND number <> 0), k AS (SELECT * FROM s WHERE first = 1 AND kind > 0 AND number <> 1)
SELECT book_id, 'n' || number AS isbn, CAST(row_number() OVER (PARTITION BY book_id ORDER BY pos) AS INTEGER) AS place FROM k QUALIFY place <= 2""")
def alternatives_by_table_function(spark: SparkSession, d: str) -> DataFrame:
    """UD3, JS4: a book's alternative rows by a table function of SQL over its candidates (two a book, the cap is the feature)."""
    from ..operators import relational

    sql.register(spark)
    li = relational.first_wins(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    n, kind = F.col("l_partkey") % 5, F.col("l_suppkey") % 4
    one = F.struct(F.col("l_linenumber").alias("pos"), F.when(n != 0, F.concat(F.lit("n"), n)).otherwise("").alias("isbn"), F.lit(None).cast("string").alias("isbn13"), (kind == 1).alias("exact_title_match"), F.when(kind > 1, True).alias("article_insensitive_title_match"), (F.col("l_discount") * 10).alias("score"))
    li.groupBy(F.col("l_orderkey").alias("book_id")).agg(F.sort_array(F.collect_list(one)).alias("candidates")).createOrReplaceTempView("folioforge_candidates")
    return spark.sql("SELECT book_id, f.isbn, f.place FROM folioforge_candidates, LATERAL alternatives_of(candidates, 'n1', 2) AS f")
