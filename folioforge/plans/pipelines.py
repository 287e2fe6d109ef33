"""The library's entries wired together on recorded inputs: listings to priced books, price requests, resolution."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import DEFAULT, Config
from ..functions import isbn as I  # noqa: E741
from ..functions import misc, price, similarity
from ..functions import text as T
from ..operators import classify, ledger, merge, relational
from ..shipping import ship
from ..sources import payloads
from ..streaming import queue


# --- from detected books to numbers (entry C)


def query_table(books: DataFrame, most: int = 6) -> DataFrame:
    """TK13, CLS12: (book_id, query_key, ord): a book's useful search queries, normalised."""
    title = T.first_filled(F.col("possible_corrected_title"), F.col("title"))
    queries = misc.query_strings(most, F.concat_ws(" ", title, F.col("author")), title, F.col("title"), F.col("raw_visible_text"))
    rows = books.select("book_id", F.posexplode(queries).alias("ord", "q")).filter(classify.useful_query(F.col("q")))
    return rows.select("book_id", T.normalize_unicode(F.col("q")).alias("query_key"), "ord")


def scored_candidates(books: DataFrame, found: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """JN5, SIM3, SIM13, AG9, WN4: ranked candidates of each book with their similarities, score and flags.

    ``found`` has query_key, isbn, title, authors, ord: what each query returned.
    """
    hits = query_table(books).drop("ord").join(found.withColumnRenamed("title", "c_title"), "query_key")
    j = hits.join(books.select("book_id", "title", "possible_corrected_title", "raw_visible_text", "author"), "book_id").filter(I.valid13(F.col("isbn")))
    own = [F.col("title"), F.col("possible_corrected_title"), F.col("raw_visible_text")]
    names = ("title_similarity", "corrected_title_similarity", "raw_text_similarity")
    j = j.withColumns({n: similarity.token_similarity(c, F.col("c_title")) for n, c in zip(names, own)}).withColumn("author_similarity", similarity.token_similarity(F.col("author"), F.col("authors")))
    j = j.withColumn("best_title_similarity", F.greatest(*names))
    j = j.withColumn("score", similarity.candidate_score([F.col(n) for n in names], F.col("author_similarity"), classify.filled(F.col("author"))))
    j = j.withColumn("exact_title_match", similarity.exact_title(F.col("c_title"), *own)).withColumn("article_insensitive_title_match", similarity.article_insensitive_title(F.col("c_title"), *own))
    best = relational.first_wins(j, ["book_id", "isbn"], [F.desc("score"), "ord", "query_key"])
    strict = classify.short_or_generic(T.first_filled(F.col("possible_corrected_title"), F.col("title"), F.col("raw_visible_text")))
    exact = F.col("exact_title_match") | F.col("article_insensitive_title_match")
    best = best.filter(~strict | exact).withColumn("score", F.when(strict & ~F.col("exact_title_match"), F.greatest(F.lit(0.0), F.round(F.col("score") - 0.05, 2))).otherwise(F.col("score")))
    ranked = relational.top_per_key(best, ["book_id"], [F.desc("score"), "ord", "isbn"], cfg.candidates_kept, "rank")
    return ranked.withColumn("selected", F.col("rank") == 1)


def scored_pages(rows: DataFrame, asked: DataFrame, key: str, title_weight: float = 0.8, author_weight: float = 0.2) -> DataFrame:
    """SRC5, SIM3: rows read from result pages (0.8 and 0.2) or detail pages (0.85 and 0.15) with their score against
    the title and author that were asked for. ``asked`` has the key, asked_title and asked_author."""
    j = rows.join(asked, key)
    title = similarity.token_similarity(F.col("asked_title"), F.col("title"))
    author = similarity.token_similarity(F.col("asked_author"), F.col("authors"))
    return j.withColumn("score", similarity.candidate_score([title], author, classify.filled(F.col("asked_author")), title_weight, author_weight))


def resolved(books: DataFrame, candidates: DataFrame, suggested: DataFrame, checked: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """RS1: (book_id, isbn, isbn_source, isbn_confidence): the first source that gives a number.

    In order: the visible number, the best search candidate, a model's suggestion that passes its gate (capped
    per listing), the volumes source. ``suggested`` has book_id, ads_id, isbn, source (ai or volumes),
    ai_confidence, title_similarity, author_similarity, has_author, score. A number of which ``checked``
    (isbn, found) says that no page exists is dropped; a check that failed technically (found null) drops nothing.
    """
    seen = I.normalize(F.col("visible_isbn"))
    visible = books.select("book_id", seen.alias("isbn"), F.lit("visible_isbn").alias("isbn_source"), F.lit(1.0).alias("isbn_confidence"), F.lit(0).alias("p")).filter("isbn is not null")
    search = candidates.filter("selected").select("book_id", "isbn", F.lit("isbnsearch").alias("isbn_source"), F.col("score").alias("isbn_confidence"), F.lit(1).alias("p"))
    safe = classify.ai_candidate_safe(F.col("ai_confidence"), F.col("title_similarity"), F.col("author_similarity"), F.col("has_author")) & (F.coalesce("score", F.lit(0.0)) >= 0.5)
    ai = relational.top_per_key(suggested.filter("source = 'ai'").filter(safe), ["ads_id"], [F.desc(F.col("score") + 0.1 * F.col("ai_confidence")), "book_id", "isbn"], cfg.recovery_per_ad)
    of = lambda df, name, p: df.select("book_id", I.resolve(F.col("isbn"))["isbn13"].alias("isbn"), F.lit(name).alias("isbn_source"), F.col("score").alias("isbn_confidence"), F.lit(p).alias("p"))
    every = visible.union(search).union(of(ai, "ai_verified", 2)).union(of(suggested.filter("source = 'volumes'"), "volumes", 3)).filter("isbn is not null")
    gone = checked.filter("found = false").select("isbn").distinct()
    kept = every.join(gone, "isbn", "left_anti")
    return relational.first_wins(kept, ["book_id"], ["p", F.desc("isbn_confidence"), "isbn"]).select("book_id", "isbn", "isbn_source", F.col("isbn_confidence").cast("double"))


def candidate_rows(books: DataFrame, candidates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """TK7, ST2: a book's own row and its best alternatives of other numbers, those that can be priced first."""
    own = books.select("ads_id", "book_id", "isbn", F.col("isbn_confidence").alias("confidence"), F.lit(False).alias("alternative"), F.lit(False).alias("priceable"))
    other = candidates.join(books.select("book_id", "ads_id", F.col("isbn").alias("own")), "book_id").filter((F.col("score") >= 0.5) & ~F.col("isbn").eqNullSafe(F.col("own")))
    other = other.withColumn("priceable", F.col("exact_title_match") | F.col("article_insensitive_title_match"))
    kept = relational.top_per_key(other, ["book_id"], [F.desc(F.col("priceable").cast("int")), F.desc("score"), "isbn"], cfg.alternatives_per_book)
    return own.union(kept.select("ads_id", "book_id", "isbn", F.col("score").alias("confidence"), F.lit(True).alias("alternative"), "priceable"))


def send_list(rows: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """CLS3, ST6, WN9, JN11: (numbers to price per listing, at most ``resale_per_ad``, and rows held with reason)."""
    v = classify.provider_eligibility(F.col("isbn"), F.col("isbn_is_valid"), F.col("isbn_confidence"), F.col("isbn_source"), F.col("visible_isbn"), cfg)
    rows = rows.withColumn("__v", v)
    send = relational.distinct_capped(rows.filter("__v.eligible"), ["ads_id"], "isbn", ["book_id"], cfg.resale_per_ad).select("ads_id", "isbn")
    held = rows.filter("not __v.eligible").select("ads_id", "book_id", classify.not_sent_reason(F.col("__v.reason")).alias("reason"))
    return send, held


# --- listings to priced books (entry A)


def ingest(ads: DataFrame, bodies: DataFrame, force_new: bool = False) -> DataFrame:
    """SRC1, SNK1: listings of all payloads merged into the ads; the last payload of a listing counts."""
    fresh = relational.first_wins(payloads.listings(bodies), ["ads_id"], [F.desc("payload_id"), F.desc("ord")]).drop("payload_id", "ord")
    return merge.upsert_ads(ads, fresh, force_new)


def screened(ads: DataFrame) -> DataFrame:
    """CLS1 and the picture test: ``processing_status`` of listings that need no further work, null for the others."""
    verdict = classify.book_relevance(T.padded_corpus(F.col("title"), F.col("description"), F.col("search_title"), F.array_join("tags", " ")))
    status = F.when(F.size("picture_urls") == 0, "no_image").when(classify.rejected_as_non_book(verdict), "rejected_non_book")
    return ads.withColumn("processing_status", status)


def priced(books: DataFrame, send: DataFrame, offers_a: DataFrame, offers_b: DataFrame) -> DataFrame:
    """JN3, JN4, SNK4, SNK5: both providers' answers on the books; what was asked and not answered has failed (A)
    or is missing (B)."""
    asked = send.select("isbn").distinct()
    null = F.lit(None).cast("decimal(10,2)")
    a = relational.with_default(asked, relational.first_wins(offers_a, ["isbn"], ["ord"]).select("isbn", "price", "status"), "isbn", {"price": null, "status": F.lit("failed")})
    a = a.withColumn("status", F.when(F.col("status") == "failed", "momox_failed").when(F.col("status") == "offer", "momox_price_found").otherwise("momox_no_offer"))
    b = relational.with_default(asked, relational.first_wins(offers_b, ["isbn"], ["ord"]).select("isbn", F.col("price").cast("decimal(10,2)").alias("price"), "status"), "isbn", {"price": F.lit(0).cast("decimal(10,2)"), "status": F.lit("gibert_missing")})
    return merge.apply_provider_rows(merge.apply_provider_rows(books, a, "momox"), b, "gibert")


def completed(books: DataFrame) -> DataFrame:
    """CLS15, AG2, SNK14: (ads_id, counts, processing_status)."""
    rows = books.withColumn("eligible", classify.provider_eligible({c: F.col(c) for c in books.columns}))
    return ledger.completion(ledger.state_counts(rows))


def processed_payload(ads: DataFrame, bodies: DataFrame, detected: DataFrame, offers_a: DataFrame, offers_b: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """QS16: one payload run from bodies to priced rows: (listings with their status, book rows with prices).

    Listings are merged, those that are new are screened, the detected books of the others are graded, the numbers
    that may go out are priced by both providers' recorded answers, and each listing's completion follows. ``detected`` has
    ads_id, book_id, isbn, isbn_is_valid, isbn_confidence, isbn_source, visible_isbn and cost; the offers have isbn, price,
    status and ord.
    """
    new = screened(ingest(ads, bodies).filter("status = 'new'")).select("ads_id", "title", F.col("processing_status").alias("screening"))
    grade = classify.candidate_class(F.col("isbn"), F.col("isbn_is_valid"), F.col("isbn_confidence"), cfg=cfg)
    null = lambda kind: F.lit(None).cast(kind)
    rows = detected.join(new.filter("screening is null").select("ads_id"), "ads_id").withColumn("__g", grade).select("*", "__g.*").drop("__g")
    rows = rows.withColumns({"momox_status": F.lit("not_sent"), "gibert_status": F.lit("not_sent"), "admin_status": F.lit("new"), "gibert_checked_at": null("timestamp"), "best_resale_platform": null("string"), **{c: null("decimal(10,2)") for c in ("momox_price", "gibert_price", "profit_momox", "profit_gibert", "best_resale_price")}})
    send, held = send_list(rows, cfg)
    key = ["ads_id", "isbn"]
    price = F.col("price").cast("decimal(10,2)").alias("price")
    a = send.join(relational.first_wins(offers_a, ["isbn"], ["ord"]).select("isbn", price, "status"), "isbn", "left")
    a = a.select(*key, "price", F.when(F.col("status") == "offer", "momox_price_found").when(F.col("status") == "no_offer", "momox_no_offer").otherwise("momox_failed").alias("status"))
    b = send.join(relational.first_wins(offers_b, ["isbn"], ["ord"]).select("isbn", price, "status"), "isbn", "left")
    b = b.select(*key, F.coalesce("price", F.lit(0).cast("decimal(10,2)")).alias("price"), F.coalesce("status", F.lit("gibert_missing")).alias("status"))
    books = merge.apply_provider_rows(merge.apply_provider_rows(rows, a, "momox", key), b, "gibert", key)
    books = books.join(held.select("ads_id", "book_id", F.col("reason").alias("not_sent_reason")), ["ads_id", "book_id"], "left")
    done = completed(books).select("ads_id", "processing_status")
    status = F.coalesce("screening", "processing_status", F.lit("no_books_detected"))
    return new.join(done, "ads_id", "left").select("ads_id", "title", status.alias("processing_status")), books


def with_seller_prices(books: DataFrame, ads: DataFrame) -> DataFrame:
    """PR8 on the books of a run."""
    found = price.seller_prices(books, ads).select("ads_id", "book_no", F.col("price").alias("book_price"), F.col("source").alias("book_price_source"))
    return books.join(found, ["ads_id", "book_no"], "left")


# --- price requests (entry B) and the service's answers as tables


def request_prices(requests: DataFrame, books: DataFrame, jobs: DataFrame) -> DataFrame:
    """QS3, IS2, CLS33: the answer to each price request: rejected, already priced, pending, or queued.

    ``requests`` has request_id, book_id; of several requests for a book the first is queued, others find it pending.
    """
    r = requests.join(books, "book_id", "left").join(jobs.filter("status in ('queued', 'processing')").select("book_id", F.lit(True).alias("__active")).distinct(), "book_id", "left")
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("request_id"))
    done = classify.has_provider_result(F.col("momox_status"), F.col("gibert_status")) & ~classify.provider_pending(F.col("momox_status"), F.col("gibert_status"))
    answer = F.when(~I.valid13(F.col("isbn")), "rejected").when(done, "already_priced").when(F.coalesce("__active", F.lit(False)) | (n > 1), "pending").otherwise("queued")
    return r.select("request_id", "book_id", answer.alias("answer"))


def jobs_status(jobs: DataFrame, events: DataFrame, limit: int = 50, per_job: int = 5) -> tuple[DataFrame, DataFrame]:
    """QS18, AG1, TK3, JN9: (counts by status, the latest jobs with their last events)."""
    head = relational.queue_head(jobs, [F.desc("updated_at"), F.desc("job_id")], limit, 200)
    return ledger.status_counts(jobs), relational.with_recent_events(head, events, per_job)


def job_timeline(events: DataFrame, job_id: int, limit: int = 1000) -> DataFrame:
    """TK4."""
    return relational.queue_head(events.filter(F.col("job_id") == job_id), ["created_at", "event_id"], limit, 1000)


def price_status(ids: DataFrame, books: DataFrame, jobs: DataFrame, most: int = 500) -> DataFrame:
    """JN10, WN2: rows and latest jobs of at most ``most`` requested ids (book_id, ord)."""
    return relational.status_lookup(relational.queue_head(ids, ["ord"], most, most), books, jobs)


def scrape_requests(requests: DataFrame, host: str, most_pages: int = 10) -> tuple[DataFrame, DataFrame]:
    """CLS30, QS2: (listing jobs, page jobs): a direct listing URL goes to the listing queue whatever it came as."""
    direct = classify.direct_listing_url(F.col("url"), host)
    return queue.start_jobs(requests.filter(direct).withColumns({"page_from": F.lit(1), "page_to": F.lit(1)}), 1), queue.start_jobs(requests.filter(~direct), most_pages)


def job_events(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """SNK12: events to append: with their job's parent, metadata made safe, progress within 0 to 100."""
    ship(events.sparkSession)
    parents = jobs.select("job_id", "parent_job_id")
    rows = events.drop("parent_job_id").join(parents, "job_id", "left").withColumn("metadata", misc.safe_metadata(F.col("metadata")))
    return rows.withColumn("progress", F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress")))).withColumn("severity", F.coalesce("severity", F.lit("info")))


def append(df: DataFrame, path: str, *partition: str) -> None:
    """SNK12, SNK13: appends rows; a job event or cost is never changed."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


# --- images, alternatives, calls


def crop_files(crops: DataFrame, most: int = 5) -> DataFrame:
    """SNK16: content-addressed names of crop images; equal bytes of a book once, ``most`` variants a book.

    ``crops`` has ads_id, book_id, variant, bytes; the files themselves are the binary column.
    """
    rows = crops.withColumn("content", F.substring(F.sha1("bytes"), 1, 16))
    once = relational.first_wins(rows, ["book_id", "content"], ["variant"])
    kept = relational.top_per_key(once, ["book_id"], ["variant"], most)
    return kept.withColumn("file", F.concat(T.safe_path(F.col("ads_id")), F.lit("/"), F.col("content"), F.lit(".jpg")))


def mismatch_alternatives(books: DataFrame, candidates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """JN25: new rows for the other editions of books that a provider priced by a picture of another edition.

    ``books`` has ads_id, book_id, isbn, provider_match_status, both prices and what the new row takes over
    (lookup_title, cost, source_image_url); ``candidates`` has book_id, ord, isbn13, isbn10, isbn, title and both title flags. Only
    books of status mismatch with a price above 0 count, in order of book_id; only candidates of the same title, with or
    without its article, in order of ord. A number that the listing holds, or that a book before has taken, is passed
    over. Two a book and four a listing (configuration).
    """
    priced = (F.coalesce("momox_price", F.lit(0)) > 0) | (F.coalesce("gibert_price", F.lit(0)) > 0)
    wrong = books.filter((F.col("provider_match_status") == "mismatch") & priced).drop("isbn", "provider_match_status", "momox_price", "gibert_price")
    same = F.coalesce("exact_title_match", F.lit(False)) | F.coalesce("article_insensitive_title_match", F.lit(False))
    # the first number that is stated is taken, as it is, and made a 13-digit one
    stated = candidates.filter(same).select("book_id", "ord", T.first_filled(F.col("isbn13"), F.col("isbn"), F.col("isbn10")).alias("stated"), F.col("title").alias("candidate_title"))
    found = I.with_normal(stated, F.col("stated"), "number").filter("number is not null").drop("stated")
    held = I.with_normal(books.select("ads_id", "isbn"), F.col("isbn"), "number").filter("number is not null").select("ads_id", "number").distinct()
    fresh = relational.not_exists(wrong.join(found, "book_id"), held, ["ads_id", "number"])
    taken = relational.choose_in_order(fresh, ["ads_id"], "book_id", ["book_id", "ord"], "number", cfg.mismatch_per_book, cfg.mismatch_per_ad)
    new = {"isbn": F.col("number"), "title": T.first_filled(F.col("candidate_title"), F.col("lookup_title"), F.col("title")), "lookup_title": T.first_filled(F.col("candidate_title"), F.col("lookup_title"))}
    fixed = {"status": "isbn_alternative_candidate", "candidate_status": "alternative_edition", "review_status": "manual_review", "admin_status": "pending_edition_choice", "isbn_source": "image_mismatch_alternative", "momox_status": "momox_pending", "gibert_status": "gibert_pending"}
    prices = {c: F.lit(0) for c in ("momox_price", "gibert_price", "best_resale_price")}
    return taken.withColumns(new | {c: F.lit(v) for c, v in fixed.items()} | prices).drop("number", "candidate_title", "ord")


def verified_images(rows: DataFrame, verdicts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """QS17, TK9, CLS20, SNK10: verdicts on the rows most worth a look, ``verify_per_ad`` a listing."""
    none = F.lit("")
    worth = classify.verify_priority(F.coalesce("momox_image_url", none), F.coalesce("gibert_image_url", none), F.col("momox_price"), F.col("gibert_price"), F.col("candidate_status"))
    top = relational.top_per_key(rows.withColumn("priority", worth).filter("priority >= 0"), ["ads_id"], [F.desc("priority"), "book_id"], cfg.verify_per_ad)
    j = top.join(verdicts, "book_id", "left")
    status = F.when(F.col("confidence").isNull(), "not_checked").otherwise(classify.vision_status(F.col("same_book"), F.col("confidence"), cfg))
    return j.withColumn("provider_match_status", status)


def cover_decisions(candidates: DataFrame, compared: DataFrame, group: str = "book_id", cfg: Config = DEFAULT) -> DataFrame:
    """JN6, JN7, TK6, CLS22: plan the comparisons, spread each compared cover over its numbers, decide."""
    plan = relational.cover_plan(candidates, group, cfg.compare_cap, cfg).filter("compare")
    scored = plan.join(compared, "image_url").select(group, F.explode("isbns").alias("isbn13"), "similarity", "confidence", "match_status")
    return relational.cover_cluster(scored, group, cfg)


def recovered(held: DataFrame, suggestions: DataFrame, looked_up: DataFrame, seen: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """UD1: outcome of each suggested number for held books, in order; at most one is merged per book.

    Bad number, seen already, nothing found, title in conflict, or merged; ``suggestions`` has book_id, ord, isbn,
    ``held`` book_id, ads_id, title, ``looked_up`` isbn, title, gate_ok.
    """
    n = I.resolve(F.col("isbn"))
    s = suggestions.withColumn("n", n["isbn13"]).drop("isbn").join(held.select("book_id", "ads_id", F.col("title").alias("b_title")), "book_id")
    s = s.join(seen.select("ads_id", F.col("isbn").alias("n"), F.lit(True).alias("__seen")).distinct(), ["ads_id", "n"], "left").join(looked_up.withColumnRenamed("isbn", "n").withColumnRenamed("title", "l_title"), "n", "left")
    conflict = ~classify.filled(F.col("l_title")) | ~similarity.titles_compatible(F.col("b_title"), F.col("l_title")) | similarity.semantic_contradiction(F.col("b_title"), F.col("l_title"))
    s = s.withColumn("outcome", F.when(F.col("n").isNull(), "held_checksum").when(F.col("__seen"), "seen").when(F.col("gate_ok").isNull(), "held_no_lookup").when(conflict, "held_title").when(~F.col("gate_ok"), "held_gate").otherwise("ok"))
    first = F.row_number().over(Window.partitionBy("book_id", "outcome").orderBy("ord"))
    return s.select("book_id", "ord", F.col("n").alias("isbn13"), F.when(F.col("outcome") == "ok", F.when(first == 1, "merged").otherwise("not_tried")).otherwise(F.col("outcome")).alias("outcome"))


def guarded_map(df: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str], at_once: int | None = None) -> DataFrame:
    """UD2, QS11: ``call`` on Arrow batches; a batch that fails is halved until its failing rows stand alone, each of which
    becomes one row with its keys and the error. So a failure costs twice the logarithm of a batch in calls, not a
    call for each row; where many rows fail, or a call takes one row anyway, see :func:`guarded_each`. ``at_once``
    bounds how many run at a time, as the number of partitions."""
    ship(df.sparkSession)
    names = [f.strip().split()[0] for f in schema.split(",")]

    def tried(frame: pd.DataFrame, good: list[pd.DataFrame], bad: list[dict]) -> None:
        try:
            good.append(call(frame))
        except Exception as e:
            if len(frame) > 1:
                half = len(frame) // 2
                tried(frame.iloc[:half], good, bad)
                tried(frame.iloc[half:], good, bad)
            else:
                bad.append({**dict.fromkeys(names), **{k: frame[k].iloc[0] for k in keys}, "error": f"{type(e).__name__}: {e}"[:2000]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                good, bad = [], []
                tried(frame, good, bad)
                if good:  # pieces of several types are joined as objects, which keeps whole numbers whole
                    good = [p[names] for p in good]
                    same = all(p.dtypes.equals(good[0].dtypes) for p in good)
                    yield pd.concat(good if same else [p.astype(object) for p in good], ignore_index=True).assign(error=None)
                if bad:
                    yield pd.DataFrame(bad)[[*names, "error"]]

    return (df if at_once is None else df.coalesce(at_once)).mapInPandas(run, f"{schema}, error string")


def guarded_each(df: DataFrame, call: Callable[..., tuple], schema: str, keys: Sequence[str]) -> DataFrame:
    """UD2, QS11: ``call`` on the columns of one row after another, each exactly once, gives the values of ``schema``; a row
    that fails becomes one row with its keys and the error. A failure costs no more than a success."""
    ship(df.sparkSession)
    fields = StructType.fromDDL(f"{schema}, error string")
    out, columns = to_arrow_schema(fields), df.columns
    places = [columns.index(n) if n in keys else None for n in fields.names[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                try:
                    rows.append((*call(*row), None))
                except Exception as e:
                    rows.append((*[None if i is None else row[i] for i in places], f"{type(e).__name__}: {e}"[:2000]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), out)], schema=out)

    return df.mapInArrow(run, fields)


def tracked_calls(calls: DataFrame, input_per_million: float, output_per_million: float) -> DataFrame:
    """UD7, NM4, AG8: recorded model calls with their cost."""
    from ..functions.numbers import token_usd

    return calls.withColumn("usd", token_usd(F.col("input_tokens"), F.col("output_tokens"), input_per_million, output_per_million))


def shown(c: Column, n: int = 500) -> Column:
    return T.clip(T.clean_text(c), n)
