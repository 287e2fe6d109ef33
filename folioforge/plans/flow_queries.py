"""Registered queries of joins, aggregates, merges and queues that the other modules do not run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, ledger, merge, relational
from ..streaming import queue
from . import pipelines
from .registry import made, made_sql, query, share, turn
from .tables import offers, read, spread

_O = "o AS (SELECT l_orderkey AS ads_id, l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line, CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS price FROM lineitem)"

# --- joins


@query(f"WITH {_O} SELECT ads_id, line, part, p_size AS size FROM o JOIN part ON p_partkey = part WHERE p_partkey % 7 <> 0")
def expanded_results(spark: SparkSession, d: str) -> DataFrame:
    """JN4: one result on all books with its number; failed chunks are left out."""
    found = read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 7 == 0, "failed_chunk").otherwise("ok").alias("status"))
    return relational.expand_results(offers(spark, d), found, "part").select("ads_id", "line", "part", "size")


@query(f"""WITH {_O}, h AS (SELECT ads_id AS book_id, part AS isbn, price AS score, line AS ord FROM o), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY book_id, isbn ORDER BY score DESC, ord) = 1)
SELECT book_id, isbn, score, CAST(row_number() OVER (PARTITION BY book_id ORDER BY score DESC, ord, isbn) AS INT) AS rank, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, ord, isbn) = 1 AS selected FROM b QUALIFY rank <= 10""")
def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """JN5, AG9, WN4: candidates by normalised query, the best score of each number, ten at most (the cap is the feature)."""
    books = read(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"), F.concat(F.lit("q"), F.col("o_orderkey")).alias("query_key"))
    found = offers(spark, d).select(F.concat(F.lit("q"), F.col("ads_id")).alias("query_key"), F.col("part").alias("isbn"), F.col("price").alias("score"), F.col("line").alias("ord"))
    return relational.best_candidates(books, found).select("book_id", "isbn", "score", "rank", "selected")


@query("SELECT o_orderkey AS book_id, l_partkey AS isbn13, CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE p_brand END AS publisher FROM orders JOIN (SELECT l_orderkey, l_partkey, count(*) AS c FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey, range(CAST(c AS BIGINT)) AS x(i)")
def expanded_covers(spark: SparkSession, d: str) -> DataFrame:
    """JN7: a row for each number of a cover's group, missing values from the metadata."""
    groups = offers(spark, d).groupBy(F.col("ads_id").alias("book_id")).agg(F.collect_list("part").alias("isbns")).withColumn("publisher", F.when(F.col("book_id") % 2 == 0, "own"))
    meta = read(spark, d, "part").select(F.col("p_partkey").alias("isbn13"), F.col("p_brand").alias("publisher"))
    return relational.expand_cover_groups(groups, meta, fill=["publisher"]).select("book_id", "isbn13", "publisher")


@query("SELECT a.l_orderkey AS ads_id, a.l_linenumber AS mine, b.l_linenumber AS held FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 3 = b.l_linenumber % 3 WHERE a.l_linenumber % 2 = 0 AND b.l_linenumber % 2 = 1")
def same_boxes(spark: SparkSession, d: str) -> DataFrame:
    """JN8, AG4: recovered and held books meet on the text of their box."""
    box = F.array(F.lit(0.0), (F.col("l_linenumber") % 3) / 10.0, F.lit(0.5), F.lit(1.0))
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("ads_id"), F.col("l_linenumber").alias("line"), box.alias("bbox"))
    return relational.by_box(rows.filter("line % 2 = 0").withColumnRenamed("line", "mine"), rows.filter("line % 2 = 1").withColumnRenamed("line", "held")).select("ads_id", "mine", "held")


@query("""WITH e AS (SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3)
SELECT c_custkey AS job_id, coalesce(array_to_string(list(event_id ORDER BY ts, event_id) FILTER (event_id IS NOT NULL), ','), '') AS events FROM customer LEFT JOIN e ON user_id = c_custkey GROUP BY 1""")
def jobs_with_events(spark: SparkSession, d: str) -> DataFrame:
    """JN9, QS18: jobs with their last three events, oldest first."""
    ev = read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    jobs = read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"))
    return relational.with_recent_events(jobs, ev, 3).select("job_id", F.array_join(F.transform("events", lambda e: e["event_id"].cast("string")), ",").alias("events"))


@query("SELECT p_partkey AS book_id, o_orderkey AS job_id, o_orderstatus AS job_status FROM part LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = p_partkey WHERE p_partkey % 2 = 0 ORDER BY p_partkey LIMIT 500")
def price_status_of_books(spark: SparkSession, d: str) -> DataFrame:
    """JN10, WN2, TK3: the latest job of at most 500 requested books (the cap is the feature)."""
    books = read(spark, d, "part").select(F.col("p_partkey").alias("book_id"), "p_name")
    jobs = read(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("job_status"))
    ids = books.filter("book_id % 2 = 0").select("book_id", F.col("book_id").alias("ord"))
    return pipelines.price_status(ids, books, jobs).select("book_id", "job_id", "job_status")


@query(f"WITH {_O}, s AS (SELECT ads_id, part, 'r' || line AS reason FROM o WHERE line % 2 = 0 QUALIFY row_number() OVER (PARTITION BY ads_id, part ORDER BY line) = 1) SELECT o.ads_id, line, reason FROM o LEFT JOIN s USING (ads_id, part)")
def first_reasons(spark: SparkSession, d: str) -> DataFrame:
    """JN11."""
    rows = offers(spark, d)
    skips = rows.filter("line % 2 = 0").select("ads_id", "part", "line", F.concat(F.lit("r"), "line").alias("reason"))
    return relational.first_reason(rows, skips, ["ads_id", "part"], ["line"]).select("ads_id", "line", "reason")


@query("SELECT p.o_orderkey AS parent_id, c.o_orderkey AS child_id, c.o_orderstatus AS child_status FROM orders c JOIN orders p ON p.o_orderkey = c.o_orderkey - c.o_custkey % 3 * 4 WHERE c.o_custkey % 3 <> 0")
def parents_and_children(spark: SparkSession, d: str) -> DataFrame:
    """JN17."""
    jobs = read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderkey") - F.col("o_custkey") % 3 * 4).alias("parent_job_id"))
    return relational.children(jobs)


@query("""WITH i AS (SELECT l_orderkey AS b, l_linenumber AS pos, CASE WHEN l_orderkey % 3 = 0 THEN 'u' || (l_linenumber + 1) WHEN l_orderkey % 3 = 1 AND l_linenumber > 1 THEN 'u1' END AS url FROM lineitem), n AS (SELECT l_orderkey AS b, l_linenumber AS pos, 'u' || l_linenumber AS url FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_linenumber > 1),
f AS (SELECT b, count(*) AS items, count(url) AS with_url FROM i GROUP BY 1), g AS (SELECT b, count(*) AS inputs FROM n GROUP BY 1), h AS (SELECT i.b, count(*) AS hits FROM i JOIN n ON i.b = n.b AND i.url = n.url GROUP BY 1),
w AS (SELECT f.b, CASE WHEN with_url = items AND hits > 0 THEN 'url' WHEN items = inputs THEN 'position' ELSE 'failed' END AS how FROM f LEFT JOIN g USING (b) LEFT JOIN h USING (b))
SELECT n.b AS batch_id, n.pos AS input_pos, min(i.pos) AS item_pos, 'url' AS how FROM n JOIN i ON i.b = n.b AND i.url = n.url JOIN w ON w.b = n.b AND how = 'url' GROUP BY 1, 2 UNION ALL SELECT n.b, n.pos, n.pos, 'position' FROM n JOIN i ON i.b = n.b AND i.pos = n.pos JOIN w ON w.b = n.b AND how = 'position'""")
def paired_items(spark: SparkSession, d: str) -> DataFrame:
    """JN18: items to inputs by URL if all have one and some match, by position if the counts are equal, else not."""
    li, b, pos = read(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_linenumber")
    items = li.select(b.alias("batch_id"), pos.alias("pos"), F.when(b % 3 == 0, F.concat(F.lit("u"), pos + 1)).when((b % 3 == 1) & (pos > 1), "u1").alias("url"))
    inputs = li.filter((b % 5 != 0) | (pos > 1)).select(b.alias("batch_id"), pos.alias("pos"), F.concat(F.lit("u"), pos).alias("url"))
    return relational.pair_items(items, inputs)


@query("""WITH j AS (SELECT o_orderkey AS job_id, 'r' || o_orderkey AS run_id, 'u' || o_custkey AS url, o_orderstatus = 'O' AS active FROM orders), h AS (SELECT event_id AS hook_id, CASE WHEN event_id % 3 = 0 THEN 'r' || (event_id % 1000) END AS run_id, 'u' || user_id AS url FROM events),
m AS (SELECT hook_id, job_id, 1 AS p, 'run_id' AS matched_by FROM h JOIN j USING (run_id) UNION ALL SELECT hook_id, job_id, 2, 'url' FROM h JOIN j USING (url) WHERE active) SELECT hook_id, job_id, matched_by FROM m QUALIFY row_number() OVER (PARTITION BY hook_id ORDER BY p, job_id DESC) = 1""")
def correlated_webhooks(spark: SparkSession, d: str) -> DataFrame:
    """JN19: by run id, else by URL; there are several active jobs, so none is the only one."""
    jobs = read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("r"), "o_orderkey").alias("run_id"), F.concat(F.lit("u"), "o_custkey").alias("url"), (F.col("o_orderstatus") == "O").alias("active"))
    hooks = read(spark, d, "events").select(F.col("event_id").alias("hook_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), F.col("event_id") % 1000)).alias("run_id"), F.concat(F.lit("u"), "user_id").alias("url"))
    return relational.correlate(hooks, jobs).select("hook_id", "job_id", "matched_by")


@query("SELECT l_orderkey AS chunk, l_linenumber AS line, CASE WHEN p_partkey % 2 = 0 AND l_linenumber % 2 = 0 THEN p_size END AS found, CASE WHEN p_partkey % 2 = 0 AND l_linenumber % 2 = 0 THEN 'ok' ELSE 'failed' END AS outcome FROM lineitem JOIN part ON p_partkey = l_partkey")
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN20: a chunk's items find their entry by type and key; what has none has failed."""
    key = lambda t, k: F.concat(t, F.lit(":"), k)
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("line"), key(F.when(F.col("l_linenumber") % 2 == 0, "isbn").otherwise("title"), F.col("l_partkey").cast("string")).alias("entry"))
    entries = read(spark, d, "part").filter("p_partkey % 2 = 0").select(key(F.lit("isbn"), F.col("p_partkey").cast("string")).alias("entry"), F.col("p_size").alias("found"), F.lit("ok").alias("outcome"))
    return relational.with_default(items, entries, "entry", {"found": F.lit(None).cast("int"), "outcome": F.lit("failed")}).select("chunk", "line", "found", "outcome")


@query("SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS isbn, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS note FROM part")
def composite_key_update(spark: SparkSession, d: str) -> DataFrame:
    """JN21, JN22, SNK9: catalogue columns by a composite key of which parts may be null."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("isbn"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("title"), F.lit("old").alias("note"))
    change = p.filter("part % 2 = 0").withColumn("note", F.lit("new"))
    return merge.merge(p, change, ["part", "isbn", "title"], {}, insert=False).select("part", "isbn", "title", "note")


# --- aggregates and order


_SHOWN = {"image": turn(1, None, "", "i1", "i2")}


@query(f"WITH {made_sql(_SHOWN)} SELECT ads_id, line, image FROM r QUALIFY row_number() OVER (PARTITION BY ads_id ORDER BY coalesce(image, '') = '', k, line) = 1")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    """AG5."""
    rows = made(spark, d, _SHOWN).withColumn("ord", F.col("k") * 10 + F.col("line"))
    return ledger.representative(rows, ["ads_id"], "image", "ord").select("ads_id", "line", "image")


_CALLS = {"images": turn(1, 0, 1, 2), "input_tokens": turn(3, 100, 200), "output_tokens": turn(5, 10, 20, 30), "usd": turn(2, 0.25, 0.5), "ok": turn(7, True, True, False), "site": turn(11, "vision", "crop")}


@query(f"WITH {made_sql(_CALLS)} SELECT ads_id, count(*) AS calls, CAST(sum(images) AS BIGINT) AS images, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(usd) AS DOUBLE) AS usd, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (site = 'crop') AS crops FROM r GROUP BY 1")
def model_usage(spark: SparkSession, d: str) -> DataFrame:
    """AG8, AG21, UD6, UD7."""
    out = ledger.usage(made(spark, d, _CALLS))
    return out.select("ads_id", "calls", F.col("images").cast("long"), F.col("input_tokens").cast("long"), F.col("usd").cast("double").alias("usd"), "failed", F.coalesce(F.try_element_at("by_site", F.lit("crop")), F.lit(0)).alias("crops"))


_MERGED = {"isbn": "CAST(floor(k / 3) AS BIGINT) % 50", "flag": turn(1, "isbnsearch", "volumes", "ai"), "title": turn(2, None, "t1", "t2"), "price": turn(7, None, 1, 2)}


@query(f"WITH {made_sql(_MERGED)}, g AS (SELECT * FROM r) SELECT isbn, array_to_string(list_sort(list_distinct(list(flag))), ',') AS flags, first(title ORDER BY ads_id, line, k) FILTER (title IS NOT NULL) AS title, first(price ORDER BY ads_id, line, k) FILTER (price IS NOT NULL) AS price FROM g GROUP BY 1")
def merged_flags(spark: SparkSession, d: str) -> DataFrame:
    """AG11, ST2: the union of provenance flags, the first value of each attribute that is there."""
    return relational.merge_flags(made(spark, d, _MERGED), ["isbn"], ["ads_id", "line", "k"], "flag", ["title", "price"]).select("isbn", F.array_join("flags", ",").alias("flags"), "title", "price")


_PRICED = {"book_price_source": turn(1, "single_ad_price", "description", "title_per_unit", "none"), "provider_match_status": turn(3, "match", "mismatch", "not_checked")}


@query(f"WITH {made_sql(_PRICED)} SELECT book_price_source, provider_match_status, count(*) AS n FROM r GROUP BY ALL")
def price_source_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AG14, AG15."""
    return ledger.histogram(made(spark, d, _PRICED), "book_price_source", "provider_match_status")


_PHYSICAL = {"place": turn(1, 0, 1, 2), "eligible": turn(3, True, False)}


@query(f"WITH {made_sql(_PHYSICAL)} SELECT ads_id, count(DISTINCT place) AS detected, count(DISTINCT CASE WHEN eligible THEN place END) AS eligible FROM r GROUP BY 1")
def distinct_boxes(spark: SparkSession, d: str) -> DataFrame:
    """AG16."""
    return ledger.distinct_boxes(made(spark, d, _PHYSICAL).withColumn("bbox", F.array(F.lit(0.0), F.col("place") / 10)))


_CHUNKS = {"attempts": turn(1, 1, 2), "ok": turn(3, True, False), "cost_usd": turn(5, 0.25, 0.125)}


@query(f"WITH {made_sql(_CHUNKS)} SELECT ads_id AS batch_id, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) FILTER (NOT ok) AS failures, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM r GROUP BY 1")
def chunk_sums(spark: SparkSession, d: str) -> DataFrame:
    """AG22."""
    return ledger.chunk_sums(made(spark, d, _CHUNKS).withColumnRenamed("ads_id", "batch_id")).select("batch_id", F.col("attempts").cast("long"), "failures", F.col("cost_usd").cast("double").alias("cost_usd"))


@query(f"WITH {_O} SELECT DISTINCT ads_id, supplier AS run_id FROM o WHERE (ads_id, supplier) NOT IN (SELECT ads_id, supplier FROM o WHERE line = 1)")
def new_cost_events(spark: SparkSession, d: str) -> DataFrame:
    """QS15: calls that the ledger does not hold yet, each once."""
    rows = offers(spark, d).withColumnRenamed("supplier", "run_id")
    return ledger.cost_events(rows, rows.filter("line = 1")).select("ads_id", "run_id")


_MEDIUM = {"confidence": share(3), "lookup_score": share(2), "title_sim": turn(5, 0, 0.5, 1), "catalog_sim": turn(7, 0, 1), "valid": turn(11, True, True, False), "source": turn(13, "isbnsearch", "visible_isbn")}


@query(f"WITH {made_sql(_MEDIUM)} SELECT ads_id, line FROM r WHERE valid AND source <> 'visible_isbn' AND confidence < 0.9 AND confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY ads_id ORDER BY confidence DESC, lookup_score DESC, title_sim DESC, catalog_sim DESC, line) = 1")
def best_medium_candidate(spark: SparkSession, d: str) -> DataFrame:
    """TK8: the best medium candidate of a listing."""
    return relational.best_medium(made(spark, d, _MEDIUM), ["ads_id"], "line").select("ads_id", "line")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END, o_orderkey DESC LIMIT 50")
def active_first(spark: SparkSession, d: str) -> DataFrame:
    """TK3, TK11 (the limit is the feature)."""
    return relational.queue_head(read(spark, d, "orders"), [F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), F.desc("o_orderkey")], 50, 200).select("o_orderkey", "o_orderstatus")


@query("SELECT event_id FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 1000")
def job_timeline(spark: SparkSession, d: str) -> DataFrame:
    """TK4 (the limit is the feature)."""
    ev = read(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").alias("created_at"))
    return pipelines.job_timeline(ev, 7).select("event_id")


@query("SELECT r_regionkey AS only FROM region WHERE r_name = 'ASIA'")
def uniqueness_probe(spark: SparkSession, d: str) -> DataFrame:
    """TK12: the one row of a condition; none where there are several."""
    r = read(spark, d, "region")
    return relational.exactly_one(r.filter("r_name = 'ASIA'")).unionByName(relational.exactly_one(r)).select(F.col("r_regionkey").alias("only"))


_ASKED = {"a": turn(1, " un livre ", "deux mots", None, "le la"), "b": turn(3, "deux mots", "trois  livres", "")}


@query(f"WITH {made_sql(_ASKED)} SELECT ads_id, line, CASE WHEN x = '' THEN b WHEN b IN ('', x) THEN x ELSE x || '|' || b END AS queries FROM (SELECT *, trim(coalesce(a, '')) AS x FROM r)")
def query_lists(spark: SparkSession, d: str) -> DataFrame:
    """TK13."""
    from ..functions import misc

    return made(spark, d, _ASKED).select("ads_id", "line", F.array_join(misc.query_strings(6, F.col("a"), F.col("b")), "|").alias("queries"))


# --- sets


_SIDES = {"isbn": turn(1, "1", "2", "3", None), "title": turn(3, "a", "b"), "upstream": turn(5, True, False), "eligible": turn(7, True, False)}


@query(f"WITH {made_sql(_SIDES)}, k AS (SELECT *, coalesce(isbn, '') || '|' || title AS key FROM r WHERE upstream OR eligible) SELECT ads_id, line FROM k QUALIFY row_number() OVER (PARTITION BY ads_id, key ORDER BY upstream DESC, line) = 1")
def valid_union_eligible(spark: SparkSession, d: str) -> DataFrame:
    """ST3: what upstream holds for valid, then what is eligible here, each key once."""
    rows = made(spark, d, _SIDES)
    return relational.union_first(rows.filter("upstream"), rows.filter("eligible"), ["ads_id", F.concat_ws("|", F.coalesce("isbn", F.lit("")), "title")], ["line"]).select("ads_id", "line")


@query("SELECT p_brand, min_by(p_name, p_partkey) AS spelling, lower(strip_accents(trim(p_name))) AS key FROM (SELECT p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS p_name, p_partkey FROM part) GROUP BY p_brand, lower(strip_accents(trim(p_name)))")
def first_spellings(spark: SparkSession, d: str) -> DataFrame:
    """ST7: distinct by normalised key; the first spelling stays."""
    p = read(spark, d, "part").withColumn("p_name", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")))
    p = p.withColumn("key", F.lower(F.trim("p_name")))
    return relational.first_wins(p, ["p_brand", "key"], ["p_partkey"]).select("p_brand", F.col("p_name").alias("spelling"), "key")


_LISTED = {"isbn": turn(1, "i1", "i2", "i3", None), "isbn_is_valid": turn(5, True, False), "isbn_confidence": share(3), "isbn_source": turn(7, "isbnsearch", "visible_isbn"), "visible_isbn": turn(11, None, "")}
_LIST_REASON = "CASE WHEN isbn IS NULL THEN 'no_isbn' WHEN NOT isbn_is_valid THEN 'isbn_invalid' WHEN isbn_source = 'visible_isbn' THEN 'visible_isbn' WHEN isbn_confidence >= 0.8 THEN 'strong_isbn' ELSE 'isbn_confidence_below_threshold' END"


@query(f"WITH {made_sql(_LISTED)}, v AS (SELECT *, {_LIST_REASON} AS reason FROM r) SELECT DISTINCT ads_id, isbn AS what, 'send' AS kind FROM v WHERE reason IN ('visible_isbn', 'strong_isbn') UNION ALL SELECT ads_id, reason, 'held' FROM v WHERE reason NOT IN ('visible_isbn', 'strong_isbn')")
def send_and_hold(spark: SparkSession, d: str) -> DataFrame:
    """CLS3, ST6, WN9, JN11: numbers to price, and rows held with their reason (30 numbers a listing are never reached)."""
    send, held = pipelines.send_list(made(spark, d, _LISTED).withColumn("book_id", F.col("line")))
    return send.select("ads_id", F.col("isbn").alias("what"), F.lit("send").alias("kind")).union(held.select("ads_id", F.col("reason").alias("what"), F.lit("held").alias("kind")))


# --- merges


@query("SELECT p_partkey AS part, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS DECIMAL(10,2)) AS price, CASE WHEN p_partkey % 3 = 0 THEN 'momox_price_found' WHEN p_partkey % 3 = 1 THEN 'momox_failed' ELSE 'momox_no_offer' END AS status, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size - 2 WHEN p_partkey % 3 = 2 THEN -2 END AS DECIMAL(10,2)) AS profit, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size >= 5 THEN 'momox' ELSE 'gibert' END WHEN p_partkey % 3 = 2 THEN 'gibert' END AS platform FROM part")
def provider_batch_update(spark: SparkSession, d: str) -> DataFrame:
    """SNK4, SNK5, SNK6, PRD10, PRD12: a failed call erases nothing, no offer is 0, profit and best offer only where a price came."""
    dec, m = lambda x: F.lit(x).cast("decimal(10,2)"), F.col("p_partkey") % 3
    p = read(spark, d, "part")
    books = p.select(F.col("p_partkey").alias("isbn"), dec(1).alias("momox_price"), F.lit("momox_pending").alias("momox_status"), dec(5).alias("gibert_price"), dec(2).alias("cost"), dec(None).alias("profit_momox"), dec(None).alias("best_resale_price"), F.lit(None).cast("string").alias("best_resale_platform"))
    rows = p.select(F.col("p_partkey").alias("isbn"), F.when(m == 0, F.col("p_size").cast("decimal(10,2)")).when(m == 2, dec(0)).alias("price"), F.when(m == 0, "momox_price_found").when(m == 1, "momox_failed").otherwise("momox_no_offer").alias("status"))
    out = merge.apply_provider_rows(books, rows, "momox")
    return out.select(F.col("isbn").alias("part"), F.col("momox_price").alias("price"), F.col("momox_status").alias("status"), F.col("profit_momox").cast("decimal(10,2)").alias("profit"), F.col("best_resale_platform").alias("platform"))


@query("SELECT p_partkey AS book_id, CASE WHEN p_partkey % 4 = 0 THEN 'rejected' ELSE 'new' END AS admin_status, CASE WHEN p_partkey % 4 = 0 THEN 'rejected' ELSE p_brand END AS candidate_status FROM part")
def rejected_books(spark: SparkSession, d: str) -> DataFrame:
    """SNK15."""
    books = read(spark, d, "part").select(F.col("p_partkey").alias("book_id"), F.lit("new").alias("admin_status"), F.col("p_brand").alias("candidate_status"), F.lit("x").alias("review_status"), F.lit("x").alias("backend_status"))
    return merge.reject(books, books.filter("book_id % 4 = 0")).select("book_id", "admin_status", "candidate_status")


@query("SELECT p_partkey AS book_id, CASE p_partkey % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'uncertain' ELSE 'not_checked' END AS verdict, CASE WHEN p_partkey % 2 = 0 THEN 110 ELSE 60 END AS priority FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY priority DESC, p_partkey) <= 10")
def verified_images(spark: SparkSession, d: str) -> DataFrame:
    """QS17, TK9, CLS20, SNK10: verdicts on the ten rows of a group most worth a look (the cap is the feature)."""
    k = F.col("p_partkey")
    money = lambda x: F.when(k % 2 == 0, F.lit(x))
    rows = read(spark, d, "part").select(k.alias("book_id"), F.col("p_brand").alias("ads_id"), F.when((k % 3 == 0) | (k % 2 == 0), "i").alias("momox_image_url"), F.lit(None).cast("string").alias("gibert_image_url"), money(12).alias("momox_price"), money(2).alias("gibert_price"), F.lit("weak_candidate").alias("candidate_status"))
    said = read(spark, d, "part").filter("p_partkey % 4 <> 3").select(k.alias("book_id"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("same_book"), F.lit(0.9).alias("confidence"))
    return pipelines.verified_images(rows, said).select("book_id", F.col("provider_match_status").alias("verdict"), "priority")


@query("SELECT p_brand AS book_id, substr(sha1(p_type), 1, 16) AS content, replace(p_brand, '#', '_') || '/' AS folder FROM part GROUP BY p_brand, p_type QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) <= 5")
def crop_file_names(spark: SparkSession, d: str) -> DataFrame:
    """SNK16, HS1: content-addressed names, equal bytes once, five a book (the cap is the feature)."""
    crops = read(spark, d, "part").select(F.col("p_brand").alias("ads_id"), F.col("p_brand").alias("book_id"), F.col("p_partkey").alias("variant"), F.col("p_type").cast("binary").alias("bytes"))
    out = pipelines.crop_files(crops)
    return out.select("book_id", "content", F.concat(F.substring_index("file", "/", 1), F.lit("/")).alias("folder"))


# --- queue


@query("SELECT event_id, page FROM (SELECT event_id, user_id, CAST(epoch_us(ts) // 60000000 AS BIGINT) AS minute, unnest(range(1, CAST(user_id % 4 AS BIGINT) + 2)) AS page, ts FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, page, minute ORDER BY ts, event_id) = 1")
def page_jobs(spark: SparkSession, d: str) -> DataFrame:
    """QS2, DT2: a job for each page, equal URL, page and minute once."""
    ev = read(spark, d, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("u"), "user_id").alias("url"), F.lit(1).cast("long").alias("page_from"), (F.col("user_id") % 4 + 1).cast("long").alias("page_to"), F.col("ts"))
    return queue.start_jobs(ev, 10).select(F.col("request_id").alias("event_id"), "page")


_JOB = "j AS (SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' ELSE 'failed' END AS status, user_id % 5 AS attempts, ts FROM events)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing").otherwise("failed")
    return read(spark, d, "events").select(F.col("event_id").alias("job_id"), status.alias("status"), (F.col("user_id") % 5).alias("attempts"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"WITH {_JOB} SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'processed' ELSE status END AS status, CASE WHEN job_id % 3 = 0 THEN 100 ELSE 40 END AS progress, job_id % 3 <> 0 AS has_error FROM j")
def finished_jobs(spark: SparkSession, d: str) -> DataFrame:
    """QS5."""
    jobs = _jobs(spark, d).withColumns({"progress": F.lit(40), "finished_at": F.lit(None).cast("timestamp"), "locked_at": F.col("ts"), "error_code": F.lit("e")})
    return queue.succeed(jobs, jobs.filter("job_id % 3 = 0"), F.lit("2030-01-01").cast("timestamp")).select("job_id", "status", "progress", F.col("error_code").isNotNull().alias("has_error"))


@query(f"WITH {_JOB} SELECT job_id, 'processing' AS status, attempts + 1 AS attempts FROM j WHERE status = 'queued' ORDER BY attempts DESC, ts, job_id LIMIT 25")
def claimed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """QS4, JN14, TK1: the claim, with what it changes (the number claimed is the feature)."""
    jobs = _jobs(spark, d).withColumns({"priority": F.col("attempts"), "created_at": F.col("ts"), "next_run_at": F.lit(None).cast("timestamp"), "progress": F.lit(0)})
    return queue.claim(jobs, F.lit("2100-01-01").cast("timestamp"), 25).select("job_id", "status", "attempts")


@query("SELECT p_partkey AS part, 'new' AS a, 'x' AS b, CASE WHEN p_partkey % 2 = 0 THEN 'y' END AS c FROM part")
def merged_progress(spark: SparkSession, d: str) -> DataFrame:
    """QS10: a shallow merge, the new values first."""
    p = read(spark, d, "part")
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("x"))
    new = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("y"))).otherwise(F.create_map(F.lit("a"), F.lit("new")))
    out = p.select(F.col("p_partkey").alias("part"), queue.merged_result(old, new).alias("m"))
    return out.select("part", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, count(*) FILTER (event_type = 'error') = 0 AS clean FROM events GROUP BY 1")
def last_attempts(spark: SparkSession, d: str) -> DataFrame:
    """QS13, QS11: the last attempt of each item; users without a dead letter."""
    ev = read(spark, d, "events")
    last = queue.last_attempt(ev.withColumn("attempt_no", F.col("event_id")), ["user_id"]).select("user_id", "event_id")
    _, dead = queue.isolated(ev, F.col("event_type") == "error")
    return last.join(dead.select("user_id", F.lit(False).alias("clean")).distinct(), "user_id", "left").select("user_id", "event_id", F.coalesce("clean", F.lit(True)).alias("clean"))


@query("""WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, l_partkey AS book_id FROM lineitem), j AS (SELECT DISTINCT o_custkey AS book_id FROM orders WHERE o_orderstatus = 'P') SELECT request_id, q.book_id, CASE WHEN q.book_id % 7 = 0 THEN 'rejected' WHEN q.book_id % 5 = 0 THEN 'already_priced'
  WHEN j.book_id IS NOT NULL OR row_number() OVER (PARTITION BY q.book_id ORDER BY request_id) > 1 THEN 'pending' ELSE 'queued' END AS answer FROM q LEFT JOIN j USING (book_id)""")
def price_requests(spark: SparkSession, d: str) -> DataFrame:
    """QS3, QS16: the answer to each price request."""
    from ..functions import isbn

    asked = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_partkey").alias("book_id"))
    k = F.col("p_partkey")
    books = read(spark, d, "part").select(k.alias("book_id"), F.when(k % 7 != 0, isbn.synthetic(k)).alias("isbn"), F.when(k % 5 == 0, "momox_no_offer").otherwise("not_sent").alias("momox_status"), F.lit("not_sent").alias("gibert_status"))
    jobs = read(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.when(F.col("o_orderstatus") == "P", "queued").otherwise("done").alias("status"))
    return pipelines.request_prices(asked, books, jobs)


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '_-_IG%' AND o_orderdate >= DATE '1995-01-01' - INTERVAL 30 DAY")
def like_and_interval(spark: SparkSession, d: str) -> DataFrame:
    """PRD11, PRD13: the underscore is a wildcard."""
    return read(spark, d, "orders").filter(F.col("o_orderpriority").like("_-_IG%") & (F.col("o_orderdate") >= F.expr("DATE '1995-01-01' - INTERVAL 30 DAY"))).select("o_orderkey")


@query("""SELECT event_id, CASE WHEN NOT (event_type = 'error' AND value > 40) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_type = 'error' AND value > 40 THEN 'JSONDecodeError: Expecting value: line 1 column 1 (char 0)' END AS error FROM events""")
def guarded_calls(spark: SparkSession, d: str) -> DataFrame:
    """UD2: each item's parsed answer or its error; the answers of some events are no JSON."""
    import json

    answer = F.when((F.col("event_type") == "error") & (F.col("value") > 40), "<html>").otherwise(F.col("props"))
    return pipelines.guarded_each(read(spark, d, "events").select("event_id", answer.alias("answer")), lambda event_id, answer: (event_id, json.loads(answer)["k"]), "event_id long, k long", ["event_id"])


@query("""WITH b AS (SELECT o_orderkey AS book_id, o_custkey, o_orderkey % 4 AS m FROM orders) SELECT book_id, CASE m WHEN 0 THEN 'visible_isbn' WHEN 1 THEN 'isbnsearch' WHEN 2 THEN 'ai_verified' ELSE 'volumes' END AS isbn_source, CAST(CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 ELSE 0.55 END AS DOUBLE) AS isbn_confidence FROM b WHERE NOT (m = 3 AND o_custkey % 2 = 0)""")
def resolution_cascade(spark: SparkSession, d: str) -> DataFrame:
    """RS1: visible number, then the search's best, then a model's suggestion that passes its gate, then the volumes source; numbers without a page are dropped."""
    from ..functions import isbn

    o = read(spark, d, "orders").withColumn("m", F.col("o_orderkey") % 4)
    n = isbn.synthetic(F.col("o_orderkey"))
    books = o.select(F.col("o_orderkey").alias("book_id"), F.when(F.col("m") == 0, n).alias("visible_isbn"))
    found = o.filter("m <= 1").select(F.col("o_orderkey").alias("book_id"), n.alias("isbn"), F.lit(0.9).alias("score"), F.lit(True).alias("selected"))
    said = o.filter("m >= 1").select(F.col("o_orderkey").alias("book_id"), F.col("o_orderkey").alias("ads_id"), n.alias("isbn"), F.explode(F.array(F.lit("ai"), F.lit("volumes"))).alias("source"), F.when(F.col("m") == 3, 0.1).otherwise(0.5).alias("ai_confidence"), F.lit(0.95).alias("title_similarity"), F.lit(0.0).alias("author_similarity"), F.lit(True).alias("has_author"))
    said = said.withColumn("score", F.when(F.col("source") == "ai", 0.6).otherwise(0.55))
    gone = o.select(n.alias("isbn"), F.when((F.col("m") == 3) & (F.col("o_custkey") % 2 == 0), False).otherwise(F.when(F.col("m") != 2, True)).alias("found"))
    return pipelines.resolved(books, found, said, gone).select("book_id", "isbn_source", "isbn_confidence")


@query("""SELECT p_partkey AS ads_id, 1 AS book_no, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size WHEN 2 THEN 3.5 END AS DECIMAL(10,2)) AS price, CASE p_partkey % 4 WHEN 0 THEN 'single_ad_price' WHEN 1 THEN 'description' WHEN 2 THEN 'title_per_unit' ELSE 'none' END AS source FROM part
UNION ALL SELECT p_partkey, 2, CAST(CASE WHEN p_partkey % 4 = 2 THEN 3.5 END AS DECIMAL(10,2)), CASE WHEN p_partkey % 4 = 2 THEN 'title_per_unit' ELSE 'none' END FROM part WHERE p_partkey % 4 <> 0""")
def seller_price_cascade(spark: SparkSession, d: str) -> DataFrame:
    """PR5, PR7, PR8, JN15, AG19: the listing's price for its only book, the description's line, the title's price per unit, or none."""
    from ..functions import price

    k, m = F.col("p_partkey"), F.col("p_partkey") % 4
    part = spread(read(spark, d, "part"), "p_partkey")
    ads = part.select(k.alias("ads_id"), F.when(m == 0, F.col("p_size") + F.lit(0.5)).alias("price_amount"), F.when(m == 2, "Lot de livres 3,50 € piece").otherwise("Livres").alias("title"), F.when(m == 1, F.concat(F.lit("« Premier grand livre » Ann Bee "), F.col("p_size"), F.lit(" €"))).alias("description"))
    lone = lambda c: F.lit(None).cast("string").alias(c)
    books = part.select(k.alias("ads_id"), F.explode(F.when(m == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("book_no"))
    books = books.select("ads_id", "book_no", F.when(F.col("book_no") == 1, "Premier grand livre").otherwise("Autre chose").alias("title"), lone("possible_corrected_title"), lone("lookup_title"), lone("raw_visible_text"), lone("author"), lone("lookup_authors"))
    return price.seller_prices(books, ads).select("ads_id", "book_no", "price", "source")


@query("SELECT p_partkey AS part, CASE p_partkey % 5 WHEN 0 THEN 'held_checksum' WHEN 1 THEN 'seen' WHEN 2 THEN 'held_no_lookup' WHEN 3 THEN 'held_title' ELSE 'merged' END AS outcome FROM part")
def recovered_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """UD1: the outcome of a suggested number for a held book."""
    from ..functions import isbn

    k, m, p = F.col("p_partkey"), F.col("p_partkey") % 5, read(spark, d, "part")
    n = isbn.synthetic(k)
    held = p.select(k.alias("book_id"), k.alias("ads_id"), F.lit("petit prince rouge").alias("title"))
    said = p.select(k.alias("book_id"), F.lit(0).alias("ord"), F.when(m == 0, "12").otherwise(n).alias("isbn"))
    looked = p.filter("p_partkey % 5 <> 2").select(n.alias("isbn"), F.when(m == 3, "autre livre").otherwise("petit prince rouge").alias("title"), F.lit(True).alias("gate_ok"))
    seen = p.filter("p_partkey % 5 = 1").select(k.alias("ads_id"), n.alias("isbn"))
    return pipelines.recovered(held, said, looked, seen).select(F.col("book_id").alias("part"), "outcome")


@query("SELECT p_partkey AS part, CASE WHEN p_partkey % 2 = 0 THEN 'i' || p_partkey ELSE 'old' END AS isbn, CASE WHEN p_partkey % 2 = 0 THEN 't' END AS lookup_title, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0.5 END AS DOUBLE) AS lookup_score FROM part")
def assigned_resolution(spark: SparkSession, d: str) -> DataFrame:
    """JS5: a resolution's fields are set as one, and cleared as one; the number of a book without one stays."""
    k = F.col("p_partkey")
    books = read(spark, d, "part").select(k.alias("book_id"), F.lit("old").alias("isbn"), F.lit("stale").alias("lookup_title"), F.lit(0.1).alias("lookup_score"))
    found = read(spark, d, "part").filter("p_partkey % 2 = 0").select(k.alias("book_id"), F.concat(F.lit("i"), k).alias("isbn"), F.lit("t").alias("lookup_title"), F.lit(0.5).alias("lookup_score"))
    return merge.assign_resolution(books, found, ["book_id"], ["isbn"]).select(F.col("book_id").alias("part"), "isbn", "lookup_title", "lookup_score")


@query(f"""WITH {_O}, f AS (SELECT ads_id, part, min(CAST(line AS BIGINT) * 1000000000 + part) AS ord FROM o GROUP BY 1, 2), c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ads_id ORDER BY ord) <= 3), g AS (SELECT ads_id, count(*) FILTER (part % 2 = 0) AS n, max(part) FILTER (part % 2 = 0) AS p FROM c GROUP BY 1)
SELECT ads_id AS book_id, CASE n WHEN 0 THEN 'no_match' WHEN 1 THEN 'selected_exact_isbn' ELSE 'selected_cover_ambiguous_isbn' END AS decision, CASE WHEN n = 1 THEN p END AS isbn13, CAST(n AS INT) AS cluster_size FROM g""")
def compared_covers(spark: SparkSession, d: str) -> DataFrame:
    """JN6, JN7, TK6, CLS22: the first three covers of a book are compared (the cap is the feature), then its numbers are decided."""
    o = offers(spark, d)
    found = o.select(F.col("ads_id").alias("book_id"), F.col("part").alias("isbn13"), F.concat(F.lit("u"), "part").alias("image_url"), F.lit(False).alias("is_pipeline"), F.lit(0.5).alias("title_similarity"), (F.col("line").cast("long") * 1_000_000_000 + F.col("part")).alias("ord"))
    found = relational.first_wins(found, ["book_id", "isbn13"], ["ord"])
    even = F.col("p_partkey") % 2 == 0
    compared = read(spark, d, "part").select(F.concat(F.lit("u"), "p_partkey").alias("image_url"), F.when(even, 0.95).otherwise(0.3).alias("similarity"), F.lit(0.9).alias("confidence"), F.when(even, "match").otherwise("mismatch").alias("match_status"))
    return pipelines.cover_decisions(found, compared)


_VERIFIED = {"score": share(2), "ai": share(3)}


@query(f"WITH {made_sql(_VERIFIED)} SELECT ads_id, line FROM r ORDER BY score + 0.1 * ai DESC, k, ads_id, line LIMIT 50")
def ai_verified_order(spark: SparkSession, d: str) -> DataFrame:
    """TK10: score and a tenth of the model's confidence (the limit is the feature)."""
    return relational.queue_head(made(spark, d, _VERIFIED), [F.desc(F.col("score") + F.lit(0.1) * F.col("ai")), "k", "ads_id", "line"], 50).select("ads_id", "line")


_LOOKUPS = {**{f"i{n}": turn(n, "a", "b", None, "") for n in (1, 3, 5)}, **{f"j{n}": turn(n + 1, None, "a", "c") for n in (1, 3, 5)}, **{f"s{n}": share(n + 6) for n in (1, 3, 5)}}


@query(f"""WITH {made_sql(_LOOKUPS)}, c AS ({' UNION ALL '.join(f'SELECT rid, {n} AS n, i{n} AS i, j{n} AS j, s{n} AS s FROM r' for n in (1, 3, 5))}), g AS (SELECT rid, n, coalesce(nullif(i, ''), nullif(j, '')) AS number FROM c WHERE coalesce(i, j, '') <> '' AND s >= 0.5 QUALIFY row_number() OVER (PARTITION BY rid, coalesce(nullif(i, ''), nullif(j, '')) ORDER BY n) = 1)
SELECT ads_id, line, coalesce(numbers, '') AS numbers FROM r LEFT JOIN (SELECT rid, string_agg(number, ',' ORDER BY n) AS numbers FROM g GROUP BY 1) USING (rid)""")
def strong_lookup_candidates(spark: SparkSession, d: str) -> DataFrame:
    """JS4: candidates with a number and enough score, the first of each number."""
    from ..functions import misc

    each = F.array(*[F.struct(F.col(f"i{n}").alias("isbn"), F.col(f"j{n}").alias("isbn13"), F.col(f"s{n}").alias("score")) for n in (1, 3, 5)])
    numbers = F.transform(misc.strong_lookups(F.col("c")), lambda c: F.coalesce(F.when(c["isbn"] != "", c["isbn"]), c["isbn13"]))
    return made(spark, d, _LOOKUPS).withColumn("c", each).select("ads_id", "line", F.array_join(numbers, ",").alias("numbers"))
