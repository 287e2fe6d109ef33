"""The wired entries on small recorded inputs."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioforge.plans import pipelines as P

BOOK = "book_id int, ads_id string, title string, possible_corrected_title string, raw_visible_text string, author string, visible_isbn string"
X, Y = "9782092553343", "9782758301721"


def test_resolution(spark):
    books = spark.createDataFrame(
        [(1, "a", "La grande encyclopédie des enfants", None, None, "Collectif", None), (2, "a", "Chevaux", None, None, None, None), (3, "a", "Vu", None, None, None, "978-2-09-255334-3"), (4, "a", "Rien du tout ici", None, None, None, None)], BOOK
    )
    keys = {r.book_id: r.query_key for r in P.query_table(books).collect()}
    assert set(keys) >= {1, 4} and 2 not in keys
    found = spark.createDataFrame([(keys[1], X, "La grande encyclopedie des enfants", "Collectif", 0), (keys[1], Y, "Autre chose", None, 1)], "query_key string, isbn string, title string, authors string, ord int")
    ranked = P.scored_candidates(books, found)
    top = ranked.filter("selected").collect()
    assert [(r.book_id, r.isbn, r.score) for r in top] == [(1, X, 1.0)] and top[0].exact_title_match
    suggested = spark.createDataFrame([(4, "a", "9782758301720", "ai", 0.9, 0.8, None, False, 0.7), (2, "a", Y, "ai", 0.1, 0.8, None, False, 0.7)], "book_id int, ads_id string, isbn string, source string, ai_confidence double, title_similarity double, author_similarity double, has_author boolean, score double")
    checked = spark.createDataFrame([(Y, None)], "isbn string, found boolean")
    got = {r.book_id: (r.isbn, r.isbn_source) for r in P.resolved(books, ranked, suggested, checked).collect()}
    assert got == {1: (X, "isbnsearch"), 3: (X, "visible_isbn"), 4: (Y, "ai_verified")}
    gone = P.resolved(books, ranked, suggested, spark.createDataFrame([(X, False)], "isbn string, found boolean"))
    assert {r.book_id for r in gone.collect()} == {4}


def test_listings_to_prices(spark):
    ads = spark.createDataFrame([], "ads_id string, title string, description string, search_title string, tags array<string>, picture_urls array<string>, status string, process_attempts int")
    bodies = spark.createDataFrame([(1, '[{"id":"a","title":"Roman","pictureUrls":["u"]},{"id":"b","title":"Jeu video PS4","pictureUrls":["u"]},{"id":"c","title":"Livre"}]')], "payload_id int, body string")
    got = {r.ads_id: r.processing_status for r in P.screened(P.ingest(ads, bodies)).collect()}
    assert got == {"a": None, "b": "rejected_non_book", "c": "no_image"}
    cols = "ads_id string, book_id int, isbn string, isbn_is_valid boolean, isbn_confidence double, isbn_source string, visible_isbn string"
    rows = spark.createDataFrame([("a", 1, X, True, 0.9, "isbnsearch", None), ("a", 2, Y, True, 0.6, "isbnsearch", None), ("a", 3, X, True, 0.95, "isbnsearch", None)], cols)
    send, held = P.send_list(rows)
    assert [tuple(r) for r in send.collect()] == [("a", X)] and [tuple(r) for r in held.collect()] == [("a", 2, "isbn_confidence_below_threshold")]
    money = ("momox_price", "gibert_price", "cost", "profit_momox", "profit_gibert", "best_resale_price")
    books = rows.withColumns({c: F.lit(None).cast("decimal(10,2)") for c in money}).withColumns({c: F.lit(None).cast("string") for c in ("momox_status", "gibert_status", "best_resale_platform")})
    a = spark.createDataFrame([(0, X, 4.5, "offer")], "ord int, isbn string, price double, status string")
    out = {r.book_id: r for r in P.priced(books, send, a, a.limit(0)).collect()}
    assert (float(out[1].momox_price), out[1].momox_status, out[1].gibert_status, out[1].best_resale_platform) == (4.5, "momox_price_found", "gibert_missing", "momox")
    assert out[2].momox_price is None and out[2].momox_status is None


def test_price_requests(spark):
    books = spark.createDataFrame([(1, X, "not_sent", "not_sent"), (2, "123", None, None), (3, X, "momox_price_found", "gibert_missing"), (4, X, None, None)], "book_id int, isbn string, momox_status string, gibert_status string")
    jobs = spark.createDataFrame([(9, 4, "queued")], "job_id int, book_id int, status string")
    req = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 4)], "request_id int, book_id int")
    got = {r.request_id: r.answer for r in P.request_prices(req, books, jobs).collect()}
    assert got == {1: "queued", 2: "pending", 3: "rejected", 4: "already_priced", 5: "pending"}


def test_recovery_merges_once(spark):
    held = spark.createDataFrame([(1, "a", "grand livre rouge")], "book_id int, ads_id string, title string")
    sug = spark.createDataFrame([(1, 0, "123"), (1, 1, Y), (1, 2, X), (1, 3, "9782070368228")], "book_id int, ord int, isbn string")
    look = spark.createDataFrame([(Y, "autre titre", True), (X, "le grand livre rouge", True), ("9782070368228", "grand livre rouge", True)], "isbn string, title string, gate_ok boolean")
    got = P.recovered(held, sug, look, spark.createDataFrame([], "ads_id string, isbn string")).orderBy("ord")
    assert [r.outcome for r in got.collect()] == ["held_checksum", "held_title", "merged", "not_tried"]


def test_crops_and_guarded_map(spark):
    crops = spark.createDataFrame([("a", 1, 0, b"x"), ("a", 1, 1, b"x"), ("a", 1, 2, b"y")], "ads_id string, book_id int, variant int, bytes binary")
    assert sorted(r.variant for r in P.crop_files(crops).collect()) == [0, 2]

    def call(f):
        if (f["k"] == 2).any():
            raise ValueError("bad")
        return f.assign(v=f["k"] * 10)

    out = P.guarded_map(spark.createDataFrame([(1,), (2,), (3,)], "k long").coalesce(1), call, "k long, v long", ["k"])
    assert Counter((r.k, r.v, r.error) for r in out.collect()) == Counter([(1, 10, None), (2, None, "ValueError: bad"), (3, 30, None)])


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from folioforge import shipping

    gone = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: gone)), master="spark://host:7077")
    with pytest.raises(ValueError, match="shared|share"):
        shipping.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: None)))
