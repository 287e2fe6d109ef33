"""Aggregates, cost ledger and job timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .classify import backend_status, provider_a_state, provider_b_state


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """AG1."""
    return df.groupBy(status).agg(F.count("*").alias("n"))


def state_counts(books: DataFrame, key: str = "ads_id") -> DataFrame:
    """AG2: per listing, rows in each provider state, rows taking part, and how complete it is."""
    a, b = provider_a_state(F.col("momox_status")), provider_b_state(F.col("gibert_status"), F.col("gibert_checked_at"))
    rows = books.withColumn("a", a).withColumn("b", b)
    each = [F.count_if((F.col("eligible")) & (F.col(p) == s)).alias(f"{p}_{s}") for p in "ab" for s in ("not_sent", "pending", "failed", "done")]
    open_ = lambda *v: F.count_if(F.col("eligible") & (F.col("a").isin(*v) | F.col("b").isin(*v)))
    return rows.groupBy(key).agg(F.count_if("eligible").alias("eligible_rows"), *each, open_("pending", "failed", "not_sent").alias("incomplete"), open_("pending", "failed").alias("blocking"))


def completion(counts: DataFrame) -> DataFrame:
    """SNK14: a listing's processing status from :func:`state_counts`."""
    status = F.when(F.col("blocking") > 0, "provider_incomplete").when(F.col("eligible_rows") == 0, "no_books_detected").otherwise("processed")
    return counts.withColumn("processing_status", status)


def backend_counts(books: DataFrame) -> DataFrame:
    """CLS15 and AG1 together."""
    row = {c: F.col(c) for c in books.columns}
    a, b = provider_a_state(F.col("momox_status")), provider_b_state(F.col("gibert_status"), F.col("gibert_checked_at"))
    return books.select(backend_status(row, a, b).alias("backend_status")).groupBy("backend_status").agg(F.count("*").alias("n"))


def decision_totals(rows: DataFrame, key: str = "ads_id") -> DataFrame:
    """AG3: the twelve totals of a listing's decisions, in one aggregation.

    ``rows`` has decision, would_send (numbers that would go to providers), union_candidates, send_isbns (counts before
    the budget), searches (keyword searches used) and vision_usd. Avoided sends never count below 0 for a book.
    """
    kinds = ("selected_exact_isbn", "selected_cover_ambiguous_isbn", "needs_verification", "no_match")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    sends = F.coalesce(F.size("would_send"), F.lit(0))
    return rows.groupBy(key).agg(
        F.count("*").alias("detected_books"), *[F.count_if(F.col("decision") == k).alias(k) for k in kinds], F.count_if(sends > 0).alias("books_with_sends"),
        total(sends, "total_would_send"), total("union_candidates", "total_candidates"), total(F.greatest(F.lit(0), F.col("union_candidates") - F.col("send_isbns")), "provider_sends_avoided"),
        total("searches", "keyword_searches_used"), F.round(F.coalesce(F.sum(F.col("vision_usd").cast("decimal(18,6)")), F.lit(0)), 2).cast("decimal(18,2)").alias("est_vision_usd"), total("searches", "est_scrapfly_credits"),
    )


def representative(rows: DataFrame, keys: Sequence[str], image: str, order: str) -> DataFrame:
    """AG5: of each group the first row with an image, else the first."""
    w = Window.partitionBy(*keys).orderBy(F.col(image).isNull() | (F.col(image) == ""), order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def reconcile(offers: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """AG6: sum of a page's offers against its stated total; null where no total is stated."""
    sums = offers.groupBy(key).agg(F.round(F.sum(F.col("price").cast("decimal(18,4)")), 2).cast("decimal(18,2)").alias("offer_sum"), F.count("*").alias("offers"))
    joined = sums.join(totals, key, "left")
    return joined.withColumn("matches_total", F.when(F.col("total").isNotNull(), F.abs(F.col("offer_sum") - F.col("total").cast("decimal(18,2)")) < 0.01))


def cost_totals(events: DataFrame, *keys: str) -> DataFrame:
    """AG7, SNK13: sums of USD by key."""
    return events.groupBy(*keys).agg(F.sum(F.col("amount_usd").cast("decimal(18,6)")).cast("decimal(28,6)").alias("usd"), F.count("*").alias("events"))


def usage(calls: DataFrame, key: str = "ads_id") -> DataFrame:
    """AG8: model use per listing: calls, tokens, USD, failures, and calls by place as a map.

    One pass: sums by listing and place, then by listing.
    """
    sums = ("images", "input_tokens", "output_tokens", "usd")
    by_site = calls.withColumn("usd", F.col("usd").cast("decimal(18,6)")).groupBy(key, "site").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums], F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    return by_site.groupBy(key).agg(
        F.sum("n").alias("calls"), *[F.sum(c).alias(c) for c in sums], F.sum("ok").alias("ok"), F.sum("failed").alias("failed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("site").isNotNull(), F.struct("site", "n"))))).alias("by_site"),
    )


def equal_shares(runs: DataFrame, members: DataFrame, run: str = "run_id", member: str = "ads_id") -> DataFrame:
    """AG17: a run's cost in equal shares to its distinct listings, 6 decimals."""
    once = members.select(run, member).distinct()
    sizes = once.groupBy(run).agg(F.count("*").alias("n"))
    share = F.round(F.col("cost_usd").cast("decimal(18,6)") / F.col("n"), 6).cast("decimal(18,6)")
    return once.join(sizes, run).join(runs, run).select(run, member, share.alias("share_usd"))


def per_unit(credits: Column, usd: Column, units: Column) -> Column:
    """AG18: struct(credits_per_unit, usd_per_unit) with 4 and 6 decimals; null without units."""
    n = F.when(units > 0, units)
    return F.struct(F.round(credits.cast("decimal(18,6)") / n, 4).cast("decimal(18,4)").alias("credits_per_unit"), F.round(usd.cast("decimal(18,6)") / n, 6).cast("decimal(18,6)").alias("usd_per_unit"))


def single_price(df: DataFrame, *keys: str, price: str = "price") -> DataFrame:
    """AG19: the price if all are equal, else null."""
    return df.groupBy(*keys).agg(F.when(F.min(price) == F.max(price), F.max(price)).alias(price))


#: Counters of a run that are sums of a listing's numbers.
SUMMED = ("books_detected", "books_accepted", "books_rejected", "books_needs_review", "books_skipped_already_processed", "books_duplicate_skipped", "momox_triggered", "momox_errors", "momox_fallback_triggered", "gibert_triggered", "gibert_errors")


def run_counters(ads: DataFrame) -> dict[str, Column]:
    """AG13: the seventeen counters of a run over its listings, as aggregates.

    A listing has outcome (processed, no_image, non_book, error, retry or already_processed), read (whether a model
    read it) and the numbers in :data:`SUMMED`. All but a retry and what was done before count as processed.
    """
    is_ = lambda *o: F.col("outcome").isin(*o)
    counts = {
        "ads_to_process": F.count_if(~is_("already_processed")), "skipped_already_processed_ads": F.count_if(is_("already_processed")), "skipped_no_image": F.count_if(is_("no_image")),
        "early_rejected_non_book": F.count_if(is_("non_book")), "openai_processed": F.count_if("read"), "ads_processed": F.count_if(is_("processed", "no_image", "non_book", "error")), "ads_kept_new_for_retry": F.count_if(is_("retry")),
    }
    return counts | {c: F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in SUMMED}


def counted_write(ads: DataFrame, path: str) -> tuple[dict[str, int], DataFrame]:
    """AG13, UD7: writes the listings and counts the run in the same pass: (counters, errors of the run).

    The counters are observed while rows go by, so the input is read once; the errors, an array ``errors`` of
    structs (step, error) in each listing, are rows of the written table.
    """
    seen = Observation("run")
    kinds = run_counters(ads)
    ads.observe(seen, *[c.alias(n) for n, c in kinds.items()]).write.parquet(path)
    written = ads.sparkSession.read.schema(ads.schema).parquet(path)
    errors = written.select("ads_id", F.explode("errors").alias("e")).select("ads_id", "e.step", F.substring("e.error", 1, 2000).alias("error"))
    return {n: int(seen.get[n]) for n in kinds}, errors


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    """AG14, AG15."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_boxes(books: DataFrame, key: str = "ads_id") -> DataFrame:
    """AG16: distinct physical books against those taking part."""
    box = F.to_json("bbox")
    return books.groupBy(key).agg(F.count_distinct(box).alias("detected"), F.count_distinct(F.when(F.col("eligible"), box)).alias("eligible"))


def chunk_sums(runs: DataFrame, key: str = "batch_id") -> DataFrame:
    """AG21, AG22."""
    return runs.groupBy(key).agg(F.sum("attempts").alias("attempts"), F.count_if(~F.col("ok")).alias("failures"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).alias("cost_usd"))


def cost_events(calls: DataFrame, seen: DataFrame, keys: Sequence[str] = ("ads_id", "run_id")) -> DataFrame:
    """QS15: only calls that the ledger does not have yet."""
    return calls.dropDuplicates(list(keys)).join(seen.select(*keys), list(keys), "left_anti")
