"""Scalar functions on literal cases, and properties."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import isbn, misc, numbers, price, similarity
from folioforge.functions import text as T


def values(spark, rows, *exprs, schema="a string, b string, c string"):
    width = len(schema.split(","))
    data = [tuple(r) + (None,) * (width - len(r)) for r in rows]
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, " + schema).select("i", *[e.alias(f"v{j}") for j, e in enumerate(exprs)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in out]


@pytest.fixture(autouse=True)
def columns(spark):
    """A and B name the first two columns; columns need a session."""
    globals().update(A=F.col("a"), B=F.col("b"))


def test_normalisers(spark):
    rows = [("L'Été, à   Nîmes!",), (None,), ("Œuvre & cœur + æon",), ("Straße 日本",)]
    got = values(spark, rows, T.normalize_unicode(A), T.normalize_ascii(A), T.normalize_match(A), T.normalize_title(A), T.padded_corpus(A))
    assert got[0] == ("l ete a nimes", "l ete a nimes", "l ete a nimes", "l ete a nimes", " l ete a nimes ")
    assert got[1] == ("", "", "", "", "  ")
    assert got[2][2] == "oeuvre and coeur plus aeon" and got[2][3] == "oeuvre coeur aeon"
    assert got[3][0] == "straße 日本" and got[3][1] == "stra e"


def test_titles_and_tokens(spark):
    got = values(spark, [("Le grand livre: des chevaux (tome 2)",)], T.main_title(A), F.array_join(T.similarity_tokens(A), ","), T.token_key(A))
    assert got == [("Le grand livre", "grand,livre,chevaux,tome", "chevaux grand livre tome")]
    assert values(spark, [("Les Misérables Author(s): Hugo ISBN-13: 97",)], T.raw_text_title(A)) == ["Les Misérables"]


@pytest.mark.parametrize(
    ("a", "b", "least"),
    [("Châteaux et chevaliers", "chateaux et chevaliers", 1.0), ("Châteaux et chevaliers", "Le grand livre des châteaux et chevaliers", 0.5), ("x", "y", 0.0), ("", "y", 0.0)],
)
def test_token_similarity(spark, a, b, least):
    (s,) = values(spark, [(a, b)], similarity.token_similarity(A, B))
    assert least <= s <= 1
    assert values(spark, [(b, a)], similarity.token_similarity(A, B)) == [s]


def test_similarity_rules(spark):
    assert values(spark, [("Harry Potter 1", "harry potter 1 poche"), ("abc", "xyz"), ("le chat noir", "le chien noir")], similarity.provider_title_similarity(A, B)) == [1.0, 0.0, pytest.approx(1 / 3)]
    assert values(spark, [("les couleurs", "les formes"), ("les couleurs", "couleurs et formes"), ("a", "")], similarity.semantic_contradiction(A, B)) == [True, False, False]
    assert values(spark, [("Victor Hugo", "Hugo Victor"), ("Hugo", "Victor Hugo"), ("A B", "C D"), (None, "x")], similarity.same_author(A, B)) == [True, True, False, False]
    assert values(spark, [("abc", "abcdef"), ("abc", "abcd"), ("", "x"), ("x", "")], similarity.better_text(A, B)) == ["abcdef", "abc", "x", "x"]
    assert values(spark, [("grand livre rouge", "livre rouge grand bleu"), ("un", "deux")], similarity.detected_containment(A, B)) == [1.0, 0.0]


def test_isbn_cases(spark):
    rows = [("978-2-7583-0172-1",), ("9782758301720",), ("1234567890123",), ("978123",), ("1234567890",), ("2-092-55334-8",), (None,)]
    got = values(spark, rows, isbn.resolve(A))
    assert [(r.isbn13, r.repaired) for r in got] == [("9782758301721", False), ("9782758301721", True), (None, False), (None, False), (None, False), ("9782092553343", False), (None, False)]
    assert values(spark, [("9782092553343",), ("9791234567896",), ("x",)], isbn.thirteen_to_ten(A)) == ["2092553348", None, None]
    found = values(spark, [("see 978-2-7583-0172-1 or amazon.fr/dp/2092553348 and x2092553348x",)], isbn.find_in_text(A))
    assert [tuple(f) for f in found[0]] == [("9782758301721", "isbn13"), ("9782092553343", "amazon_dp"), ("9782092553343", "isbn10")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 999_999_999), min_size=1, max_size=40))
def test_isbn_round_trip(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long").withColumn("n", isbn.synthetic(F.col("k")))
    ten = isbn.thirteen_to_ten(F.col("n"))
    bad = df.filter(~isbn.valid13(F.col("n")) | ~isbn.valid10(ten) | (isbn.ten_to_thirteen(ten) != F.col("n")) | (isbn.repair(F.col("n")) != F.col("n")))
    assert bad.count() == 0


def test_prices(spark):
    got = values(spark, [("2,5 €",), ("0,5€",), ("abc",), ("-1",), ("",), (None,)], price.french_price(A))
    assert [None if v is None else float(v) for v in got] == [2.5, 0.5, None, None, None, None]
    assert values(spark, [("1.2.3",), ("12 €",), ("x",)], price.listing_price(A)) == [1.2, 12.0, None]
    assert values(spark, [("",), (None,), ("4,50 €",)], price.lax_price(A)) == [0.0, None, 4.5]
    assert values(spark, [("tome 1",), ("tome 1 et 2",), ("tomes 1 à 3",), ("t4",), ("tomes 1 à 40",), ("x",)], price.volumes(A)) == [[1], [1, 2], [1, 2, 3], [4], [1], []]


def test_description_lines(spark):
    text = '- "Con Brio" Brina Svit ed Métailié/ 2€\nBleach tome 1 et 2 : 3€\nBleach tome 1 et 2 : 3€ chacun\nNaruto tomes 1 à 3 : 9€\nNaruto 2€\nEnvoi rapide possible 3€'
    df = spark.createDataFrame([("x", text), ("y", None)], "ads_id string, description string")
    got = [(r.title, r.author, r.volume, float(r.price), r.distributed) for r in price.description_entries(df).orderBy("ord").collect()]
    assert got[0] == ("Con Brio", "Brina Svit", None, 2.0, False)
    assert got[1:5] == [("Bleach", None, 1, 1.5, True), ("Bleach", None, 2, 1.5, True), ("Bleach", None, 1, 3.0, False), ("Bleach", None, 2, 3.0, False)]
    assert [g[2:4] for g in got[5:]] == [(1, 3.0), (2, 3.0), (3, 3.0)]


def test_seller_prices(spark):
    books = [("a", 1, "Con Brio", "x"), ("a", 2, "Bleach tome 2", None), ("b", 1, "Solo", None), ("c", 1, "P", "author a"), ("c", 2, "Same title", "author b"), ("d", 1, "u", None), ("d", 2, "v", None)]
    b = spark.createDataFrame([(*r, None, None, None, None) for r in books], "ads_id string, book_no int, title string, author string, possible_corrected_title string, lookup_title string, raw_visible_text string, lookup_authors string")
    listings = [("a", "t", None, '"Con Brio" Svit / 2€\nBleach tome 1 et 2 : 3€'), ("b", "t", 7.0, ""), ("c", "t", None, '"Same title" author a / 5€\n"Same title" author b / 9€'), ("d", "Lot de 2 livres 20€", None, None)]
    ads = spark.createDataFrame(listings, "ads_id string, title string, price_amount double, description string")
    got = {(r.ads_id, r.book_no): (None if r.price is None else float(r.price), r.source) for r in price.seller_prices(b, ads).collect()}
    assert got == {
        ("a", 1): (2.0, "description"), ("a", 2): (1.5, "description"), ("b", 1): (7.0, "single_ad_price"), ("c", 1): (None, "none"), ("c", 2): (9.0, "description"),
        ("d", 1): (10.0, "title_lot_distributed"), ("d", 2): (10.0, "title_lot_distributed"),
    }


def test_numbers(spark):
    assert values(spark, [("85",), ("0.5",), ("101",), ("-1",), ("x",), (None,)], numbers.confidence(A)) == [0.85, 0.5, None, None, None, None]
    got = values(spark, [("10", "USD"), ("1000", "SCRAPFLY_CREDIT"), ("5", "EUR")], numbers.amount_usd(A, B))
    assert [None if v is None else float(v) for v in got] == [10.0, 0.15, None]
    box = F.from_json(A, "array<double>")
    assert values(spark, [("[0.1,0.1,0.6,0.5]",), ("[0.6,0.5,0.1,0.1]",), ("[1]",)], F.round(numbers.bbox_area(box), 6), F.round(numbers.bbox_signed_area(box), 6)) == [(0.2, 0.2), (0.2, 0.0), (None, None)]


def test_misc(spark):
    assert values(spark, [("/x",), ("//h/x",), ("http://a",), ("y",), ("",)], misc.absolute_url(A, "https://b")) == ["https://b/x", "https://h/x", "http://a", "https://b/y", None]
    assert values(spark, [("a?b>",)], misc.url_safe_base64(A)) == ["YT9iPg"]
    assert values(spark, [("Paris, 1998.",), ("x1998",), (None,)], misc.year_in(A)) == [1998, None, None]
    safe = values(spark, [('{"apiKey":"x","a":{"token":1,"b":[1,2]}}',), ("broken",), (None,), ("[1,{\"auth\":2}]",), ("null",)], misc.safe_metadata(A))
    assert safe == ['{"a":{"b":[1,2],"token":"[redacted]"},"apiKey":"[redacted]"}', "{}", "{}", '[1,{"auth":"[redacted]"}]', "{}"]
    assert values(spark, [("r", "b"), (None, "b")], misc.idempotency_key(A, B))[0] == "apify-webhook-run:r"
