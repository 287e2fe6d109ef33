"""Classifiers, joins, merges, sources and queues on small tables."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import classify, ledger, merge, relational
from folioforge.sources import pages, payloads
from folioforge.streaming import queue


def bag(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


STATE = "isbn string, status string, momox_status string, gibert_status string, gibert_checked_at timestamp, momox_price double, gibert_price double, candidate_status string, admin_status string, provider_match_status string, not_sent_reason string"


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        ({"isbn": None}, "detected_no_isbn"),
        ({"momox_status": "momox_no_offer", "gibert_status": "gibert_non_repris", "momox_price": 0.0, "gibert_price": 0.0}, "provider_no_offer"),
        ({"momox_status": "momox_no_offer", "momox_price": 0.0, "gibert_status": "not_sent"}, "isbn_confirmed"),
        ({"momox_status": "momox_failed"}, "provider_failed"),
        ({"momox_status": "momox_price_found", "momox_price": 5.5, "gibert_status": "gibert_missing", "gibert_price": 0.0}, "provider_price_found"),
        ({"momox_status": "momox_price_found", "momox_price": 5.5, "gibert_status": "gibert_missing", "provider_match_status": "match"}, "ready_for_admin"),
        ({"provider_match_status": "mismatch"}, "needs_admin_review"),
        ({"provider_match_status": "uncertain"}, "needs_admin_review"),
        ({}, "provider_not_sent"),
        ({"admin_status": "rejected"}, "rejected"),
        ({"admin_status": "validated", "momox_status": "momox_failed"}, "ready_for_admin"),
        ({"candidate_status": "duplicate_selected"}, "needs_admin_review"),
        ({"momox_status": "momox_pending"}, "isbn_confirmed"),
        ({"not_sent_reason": "catalog_no_match"}, "needs_admin_review"),
        ({"candidate_status": "strong_candidate"}, "needs_admin_review"),
    ],
)
def test_backend_status(spark, row, expected):
    names = [f.split()[0] for f in STATE.split(", ")]
    full = {"isbn": "9782092553343", **row}
    df = spark.createDataFrame([tuple(full.get(n) for n in names)], STATE)
    cols = {n: F.col(n) for n in names}
    a, b = classify.provider_a_state(cols["momox_status"]), classify.provider_b_state(cols["gibert_status"], cols["gibert_checked_at"])
    assert df.select(classify.backend_status(cols, a, b)).first()[0] == expected


@pytest.mark.parametrize(
    ("isbn", "valid", "conf", "visible", "expected"),
    [("x", True, 0.36, None, "needs_verification_low"), ("x", True, 0.36, "x", "visible_isbn"), ("x", True, 0.6, None, "needs_verification_medium"), ("x", True, 0.79, None, "needs_verification_medium"),
     ("x", True, 0.8, None, "strong_isbn"), (None, True, 0.9, None, "no_isbn"), ("x", False, 0.9, None, "isbn_invalid")],
)
def test_eligibility(spark, isbn, valid, conf, visible, expected):
    df = spark.createDataFrame([(isbn, valid, conf, visible)], "isbn string, valid boolean, conf double, visible string")
    v = df.select(classify.provider_eligibility(F.col("isbn"), F.col("valid"), F.col("conf"), F.lit(None), F.col("visible"))).first()[0]
    assert (v.reason, v.eligible) == (expected, expected in ("strong_isbn", "visible_isbn"))


def test_relevance(spark):
    rows = [("Lot de livres et DVD", "high", True), ("Jeu vidéo PS4", "high", False), ("Manga rare", "medium", True), ("Objet", "low", True), (None, "low", True)]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "t string")
    got = [r[0] for r in df.select(classify.book_relevance(T.padded_corpus(F.col("t")))).collect()]
    assert [(g.confidence, g.relevant) for g in got] == [r[1:] for r in rows]


M = "match"


@pytest.mark.parametrize(
    ("covers", "decision", "size"),
    [
        ([(0.97, 0.92, M), (0.96, 0.97, M), (0.72, 0.98, "mismatch")], "selected_cover_ambiguous_isbn", 2),
        ([(0.95, 0.95, M), (0.6, 0.9, "mismatch")], "selected_exact_isbn", 1),
        ([(0.95, 0.9, M), (0.78, 0.9, M)], "selected_exact_isbn", 1),
        ([(0.95, 0.9, M), (0.93, 0.9, M), (0.9, 0.9, M)], "selected_cover_ambiguous_isbn", 3),
        ([(0.95, 0.9, M), (0.93, 0.9, M), (0.91, 0.9, M), (0.89, 0.9, M)], "needs_verification", 0),
        ([(0.95, 0.9, M), (0.82, 0.9, M)], "needs_verification", 0),
        ([(0.86, 0.96, "mismatch")], "needs_verification", 0),
        ([(0.22, 0.9, "mismatch"), (0.18, 0.9, "mismatch")], "no_match", 0),
        ([(None, None, None)], "no_match", 0),
    ],
)
def test_cover_cluster(spark, covers, decision, size):
    df = spark.createDataFrame([("g", f"i{i}", *c) for i, c in enumerate(covers)], "g string, isbn13 string, similarity double, confidence double, match_status string")
    r = relational.cover_cluster(df, "g").first()
    assert (r.decision, r.cluster_size) == (decision, size)


def test_merge_keeps_humans_and_finished_states(spark):
    t = spark.createDataFrame([(1, "validated", "momox_price_found", 5), (2, "new", "momox_pending", None), (3, "new", "not_sent", 1), (None, "new", "x", 9)], "k int, admin_status string, momox_status string, v int")
    s = spark.createDataFrame([(1, "pending", "momox_pending", None), (2, "pending", "momox_no_offer", 7), (4, "pending", "not_sent", 8)], "k int, admin_status string, momox_status string, v int")
    got = merge.merge(t, s, ["k"], merge.BOOK_POLICY)
    assert bag(got) == Counter([(1, "validated", "momox_price_found", 5), (2, "pending", "momox_no_offer", 7), (3, "new", "not_sent", 1), (4, "pending", "not_sent", 8), (None, "new", "x", 9)])
    assert bag(merge.merge(got, s, ["k"], merge.BOOK_POLICY)) == bag(got)  # idempotent


def test_failed_calls_erase_nothing(spark):
    b = spark.createDataFrame([("i", "4.00", "3.00", "momox_price_found", "gibert_missing", "1.00", "3.00", "4.00", "momox"), ("j", None, None, "not_sent", "not_sent", "1.00", None, None, None)],
        "isbn string, momox_price string, gibert_price string, momox_status string, gibert_status string, cost string, profit_momox string, best_resale_price string, best_resale_platform string")
    b = b.withColumns({c: F.col(c).cast("decimal(10,2)") for c in ("momox_price", "gibert_price", "cost", "profit_momox", "best_resale_price")})
    rows = spark.createDataFrame([("i", None, "momox_failed"), ("j", 2.5, "momox_price_found")], "isbn string, price double, status string")
    got = {r.isbn: r for r in merge.apply_provider_rows(b, rows, "momox").collect()}
    assert (float(got["i"].momox_price), got["i"].momox_status, float(got["i"].profit_momox), got["i"].best_resale_platform) == (4.0, "momox_failed", 3.0, "momox")
    assert (float(got["j"].momox_price), float(got["j"].profit_momox), got["j"].best_resale_platform) == (2.5, 1.5, "momox")


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 7), ("b", 1, 1)], "k string, o int, s int")
    assert bag(relational.first_wins(df, ["k"], [F.desc("s"), "o"])) == Counter([("a", 2, 7), ("b", 1, 1)])
    assert bag(relational.batches(df, ["k"], ["o"], 2).select("k", "o", "batch_no")) == Counter([("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 1, 0)])
    assert relational.exactly_one(df.filter("k = 'b'")).count() == 1 and relational.exactly_one(df).count() == 0
    assert relational.unless_any(df, df.limit(0)).count() == 4 and relational.unless_any(df, df).count() == 0
    hooks = spark.createDataFrame([(1, "r1", None), (2, None, "u2"), (3, None, None)], "hook_id int, run_id string, url string")
    jobs = spark.createDataFrame([(10, "r1", "u1", False), (11, "r9", "u2", True)], "job_id int, run_id string, url string, active boolean")
    assert bag(relational.correlate(hooks, jobs).select("hook_id", "job_id", "matched_by")) == Counter([(1, 10, "run_id"), (2, 11, "url"), (3, 11, "single_active")])
    items = spark.createDataFrame([("x", 0, "u1"), ("x", 1, "u0"), ("y", 0, None), ("z", 0, None), ("z", 1, None)], "batch_id string, pos int, url string")
    inputs = spark.createDataFrame([("x", 0, "u0"), ("x", 1, "u1"), ("y", 0, "q"), ("z", 0, "q")], "batch_id string, pos int, url string")
    assert bag(relational.pair_items(items, inputs)) == Counter([("x", 0, 1, "url"), ("x", 1, 0, "url"), ("y", 0, 0, "position")])


def test_cover_plan(spark):
    rows = [("c1", "1"), ("c1", "2"), ("c2", "3"), ("c2", "4"), ("c3", "5"), (None, "6")]
    df = spark.createDataFrame([("g", i, u, False, 0.0, n) for n, (u, i) in enumerate(rows)], "g string, isbn13 string, image_url string, is_pipeline boolean, title_similarity double, ord int")
    got = relational.cover_plan(df, "g", 3).orderBy("place").collect()
    assert [(r.image_url, r.isbns, r.compare) for r in got] == [("c1", ["1", "2"], True), ("c2", ["3", "4"], True), ("c3", ["5"], True)]
    assert relational.cover_plan(df, "g", 2).filter("compare").count() == 2


SEARCH = """<html><ul id="searchresults"><li><div class="image"><a href="/isbn/9782092553343"><img src="/i.jpg" alt="alt"></a></div>
<div class="bookinfo"><h2><a href="/isbn/9782092553343">La grande encyclop&eacute;die</a></h2><p>Author: Collectif</p><p>ISBN-13: 9782092553343</p><p>ISBN-10: 2092553348</p></div></li>
<li>ISBN-13: 9782092553343 again</li><li>No number here</li><li>Plain title Authors: A. B.
ISBN-10: 2070368226</ul>"""
TABLE = """<table id="product_list"><tr><td>9782092553343</td><td><span class="product-item-name"> A  b </span></td><td class="repris"><span class="price">4,50 €</span></td></tr>
<tr><td>9782070368228 <td class="non-repris">Non repris</td></tr></table><div id="total_amount"><span class="price">4,50 €</span></div>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, SEARCH), (2, None), (3, "<p>broken <b")], "page_id long, html string")
    got = pages.search_pages(df, "page_id", "html").orderBy("ord").collect()
    assert [(r.isbn, r.isbn10, r.title, r.authors) for r in got] == [("9782092553343", "2092553348", "La grande encyclopédie", "Collectif"), ("2070368226", "2070368226", "Plain title", "A. B.")]
    assert got[0].result_url == "https://isbnsearch.org/isbn/9782092553343"
    page = spark.createDataFrame([(1, TABLE), (2, '<table id="product_list"></table>')], "page_id long, html string")
    assert [(r.isbn, r.title, r.price, r.status) for r in pages.offer_pages(page, "page_id", "html").orderBy("ord").collect()] == [("9782092553343", "A b", 4.5, "gibert_price_found"), ("9782070368228", None, 0.0, "gibert_non_repris")]
    assert [(r.total, r.total_text) for r in pages.offer_totals(page, "page_id", "html").orderBy("page_id").collect()] == [(4.5, "4,50 €"), (None, None)]
    detail = '<div id="book"><div class="bookinfo"><h1>T</h1><p>ISBN-13: 9782092553343</p><p>Author: Benton</p>\n<p>Publisher: Nathan</p>\n<p>Published: 2011</p></div></div>'
    (r,) = pages.detail_pages(spark.createDataFrame([(1, detail)], "page_id long, html string"), "page_id", "html").collect()
    assert (r.isbn13, r.title, r.publisher, r.published) == ("9782092553343", "T", "Nathan", "2011")
    shop = '<li><img src="https://pictures.abebooks.com/isbn/9782092553343-fr.jpg" alt="x"><span class="author">Z</span><a class="title" href="/servlet/1">Titre</a> 1999</li> pictures.abebooks.com/isbn/2070368226-us.jpg'
    rows = pages.catalog_pages(spark.createDataFrame([(1, shop)], "page_id long, html string"), "page_id", "html").orderBy("ord").collect()
    assert [(r.isbn13, r.title, r.author, r.year) for r in rows] == [("9782092553343", "Titre", "Z", 1999), ("9782070368228", None, None, None)]


def test_payloads(spark):
    bodies = ['[{"id":"1","price":"5 €","pictureUrls":["","u"],"tags":["À Lyon"]}]', '{"items":[{"id":"2","firstPictureUrl":"f"},{"title":"no id"}]}', '{"data":[{"id":"3"}]}', '"x"', None]
    df = spark.createDataFrame(list(enumerate(bodies)), "payload_id int, body string")
    got = {r.ads_id: r for r in payloads.listings(df).collect()}
    assert sorted(got) == ["1", "2", "3"] and got["1"].picture_urls == ["u"] and got["2"].picture_urls == ["f"] and got["1"].location_text == "Lyon" and float(got["1"].price_amount) == 5.0
    entry = '{{"code":"{}","ok":{},"status":200,"data":{{"status":"{}","price":"{}","product":{{"title":"t"}}}}}}'
    rows = ",".join([entry.format("9782824625256", "true", "offer", "4.50"), entry.format("9782070368228", "true", "no_offer", ""), entry.format("9782092553343", "false", "offer", "1")])
    body = f'{{"result":{{"browser_data":{{"js_scenario":{{"steps":[{{"action":"wait"}},{{"action":"execute","result":{{"results":[{rows}]}}}}]}}}}}}}}'
    got = payloads.offers_a(spark.createDataFrame([(1, body)], "batch_id int, body string")).orderBy("ord").collect()
    assert [(r.isbn, r.status, None if r.price is None else float(r.price)) for r in got] == [("9782824625256", "offer", 4.5), ("9782070368228", "no_offer", 0.0), ("9782092553343", "failed", None)]
    match = '{"visualMatches":[{"link":"https://www.amazon.fr/dp/2092553348","title":"x"},{"link":"https://www.google.com/","title":"9782092553343"}],"aiSummary":"ISBN 9782758301721"}'
    m = payloads.matched_numbers(payloads.visual_matches(spark.createDataFrame([(1, match)], "crop_id int, body string")))
    assert bag(m.select("isbn13", "via", "match_type")) == Counter([("9782092553343", "amazon_dp", "visual"), ("9782758301721", "lens_ai_summary", "ai_summary")])
    assert [float(r[0]) for r in spark.createDataFrame([('{"usageTotalUsd":-1,"stats":{"usageUsd":0.25}}',)], "b string").select(payloads.run_cost(F.col("b"))).collect()] == [0.25]


def test_queue(spark):
    now = datetime(2024, 1, 1)
    jobs = spark.createDataFrame(
        [(1, "processing", 1, now - timedelta(minutes=100), 0, now, None, 3), (2, "processing", 3, now - timedelta(minutes=100), 0, now, None, 3), (3, "queued", 0, None, 5, now, None, 3), (4, "queued", 0, None, 9, now, now + timedelta(hours=1), 3)],
        "job_id int, status string, attempts int, locked_at timestamp, priority int, created_at timestamp, next_run_at timestamp, progress int",
    )
    assert [r.job_id for r in queue.claim(jobs, F.lit(now)).collect()] == [3]
    assert [r[0] for r in spark.range(1).select(queue.retry_delay_seconds(F.lit(50))).collect()] == [600]
    ev = spark.createDataFrame([(1, 1, "enqueue"), (1, 2, "enqueue"), (1, 3, "end"), (1, 4, "enqueue"), (2, 1, "end"), (2, 2, "enqueue")], "k int, o int, kind string")
    assert bag(queue.accepted_jobs(ev, "k", ["o"]).select("k", "o")) == Counter([(1, 1), (1, 4), (2, 2)])
    pages_ = spark.createDataFrame([(1, "u", 1, 3, now), (2, "u", 1, 1, now)], "request_id int, url string, page_from int, page_to int, ts timestamp")
    assert queue.start_jobs(pages_).count() == 3


def test_ledger(spark):
    runs = spark.createDataFrame([("r", 1.0)], "run_id string, cost_usd double")
    ads = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "b"), ("r", "c")], "run_id string, ads_id string")
    assert {float(r.share_usd) for r in ledger.equal_shares(runs, ads).collect()} == {0.333333}
    offers = spark.createDataFrame([("p", 1.25), ("p", 2.5), ("q", 1.0)], "page string, price double")
    totals = spark.createDataFrame([("p", 3.75)], "page string, total double")
    assert {r.page: r.matches_total for r in ledger.reconcile(offers, totals, "page").collect()} == {"p": True, "q": None}


def test_catalog_gate(spark):
    names = "visible_sendable boolean, strong_sendable boolean, medium_sendable boolean, crop_mismatch boolean, budget_left boolean, level string, decision string, selected_sendable boolean, selected_valid boolean, selected_confidence double, selected_title_ok boolean, selected_contradiction boolean, own_valid boolean, own_confidence double, own_cover_status string, own_cover_similarity double, own_cover_confidence double, own_title_ok boolean"
    cols = [c.split()[0] for c in names.split(", ")]
    cases = [
        ({"visible_sendable": True}, "visible_isbn", True), ({"level": "poor"}, "crop_too_small", False), ({}, "needs_verification", False),
        ({"strong_sendable": True, "budget_left": False}, "strong_isbn_budget", True), ({"medium_sendable": True}, "medium_fallback", True),
        ({"strong_sendable": True, "level": "risky", "budget_left": False}, "catalog_budget_no_cover_proof", False),
        ({"strong_sendable": True, "level": "risky", "decision": "selected_exact_isbn", "selected_sendable": True, "selected_valid": True, "selected_confidence": 0.6, "selected_title_ok": True}, "poor_crop_cover_verified", True),
        ({"strong_sendable": True, "level": "risky", "decision": "selected_exact_isbn", "selected_sendable": True, "selected_valid": True, "selected_confidence": 0.4, "selected_title_ok": True}, "poor_crop_selected_exact_low_confidence", False),
        ({"strong_sendable": True, "level": "risky", "own_cover_status": "mismatch", "own_cover_confidence": 0.9}, "cover_mismatch_needs_review", False),
        ({"strong_sendable": True, "level": "poor"}, "tiny_crop_cover_unconfirmed", False), ({"strong_sendable": True, "level": "risky"}, "poor_crop_needs_cover_match", False),
    ]
    for row, reason, eligible in cases:
        full = {"level": "good", "budget_left": True, "decision": "needs_verification", **row}
        df = spark.createDataFrame([tuple(full.get(c) for c in cols)], names)
        v = df.select(classify.catalog_gate({c: F.col(c) for c in cols})).first()[0]
        assert (v.reason, v.eligible) == (reason, eligible), row
