"""Counters observed on the way, provider B's updates, table functions and the paged source, by literal cases and plans."""

from __future__ import annotations

import json
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioforge.functions import sql
from folioforge.operators import classify, ledger, merge
from folioforge.sources import paged


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_counters_come_with_the_write(spark, tmp_path):
    columns = ["ads_id int", "outcome string", "read boolean", "errors array<struct<step:string,error:string>>", *[f"{c} int" for c in ledger.SUMMED]]
    zero = [0] * len(ledger.SUMMED)
    rows = [(1, "processed", True, [("momox_batch", "e" * 3000), ("gibert_batch", "f")], *range(1, 12)), (2, "no_image", False, [], *zero), (3, "retry", False, None, *zero), (4, "already_processed", None, [], *zero), (5, "error", True, [("x", None)], *[None] * 11)]
    df = spark.createDataFrame(rows, ", ".join(columns))
    counters, errors = ledger.counted_write(df, str(tmp_path / "run"))
    assert len(counters) == 18 and {k: counters[k] for k in ("ads_to_process", "skipped_already_processed_ads", "skipped_no_image", "early_rejected_non_book", "openai_processed", "ads_processed", "ads_kept_new_for_retry", "books_detected", "gibert_errors")} == {
        "ads_to_process": 4, "skipped_already_processed_ads": 1, "skipped_no_image": 1, "early_rejected_non_book": 0, "openai_processed": 2, "ads_processed": 3, "ads_kept_new_for_retry": 1, "books_detected": 1, "gibert_errors": 11,
    }
    assert bag(errors) == Counter([(1, "momox_batch", "e" * 2000), (1, "gibert_batch", "f"), (5, "x", None)])
    assert spark.read.parquet(str(tmp_path / "run")).count() == 5


def test_counters_take_one_scan(spark, tmp_path):
    df = spark.range(10).selectExpr("id AS ads_id", "'processed' AS outcome", "true AS read", "array() AS errors", *[f"1 AS {c}" for c in ledger.SUMMED])
    df.write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    watched = source.observe("x", *[c.alias(n) for n, c in ledger.run_counters(source).items()])
    assert watched._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_skip_reasons(spark):
    df = spark.createDataFrame([(None, True, 0.9, False), ("i", False, 0.9, False), ("i", True, 0.4, True), ("i", True, 0.6, True), ("i", True, 0.6, False), ("i", None, 0.85, True)], "i string, v boolean, c double, p boolean")
    got = [tuple(r.x) for r in df.select(classify.candidate_class(F.col("i"), F.col("v"), F.col("c"), F.col("p")).alias("x")).collect()]
    assert got == [
        ("isbn_not_found", "no_isbn", "manual_review", "No valid ISBN found"), ("isbn_invalid", "no_isbn", "manual_review", "Invalid ISBN"), ("isbn_weak", "weak_candidate", "manual_review", "ISBN confidence below Momox threshold"),
        ("isbn_medium_promoted", "medium_candidate", "manual_review", "Medium ISBN promoted: main title prefix + author match"), ("isbn_medium", "medium_candidate", "manual_review", None), ("isbn_strong", "strong_candidate", "pending", None),
    ]


def test_provider_b(spark):
    now = datetime(2024, 1, 1)
    schema = "book_id int, status string, momox_price decimal(10,2), gibert_price decimal(10,2), gibert_title string, gibert_image_url string, gibert_status string, gibert_checked_at timestamp, cost decimal(10,2), profit_gibert decimal(10,2), best_resale_price decimal(10,2), best_resale_platform string, candidate_status string, admin_status string, updated_at timestamp"
    from decimal import Decimal as D

    book = lambda i, status, a, candidate="strong_candidate", admin="pending": (i, status, a, None, "old", "img", None, None, D("2.00"), None, D("1.00"), "momox", candidate, admin, None)
    books = spark.createDataFrame([book(1, "s", D("3.00")), book(2, "momox_no_price", D("0.00")), book(3, "momox_failed", None), book(4, "s", None, "duplicate_selected", "pending_edition_choice"), book(5, "s", D("9.00"), admin="validated")], schema)
    rows = spark.createDataFrame([(1, "4.5", "t", None, "gibert_price_found"), (2, "0", "", "", "gibert_non_repris"), (3, None, None, None, "gibert_missing"), (4, "2", None, None, "gibert_price_found")], "book_id int, price string, title string, image_url string, status string")
    got = {r.book_id: r for r in merge.apply_provider_b_batch(books, rows, F.lit(now)).collect()}
    a, b, c, d, e = (got[i] for i in range(1, 6))
    assert (a.gibert_price, a.gibert_title, a.gibert_image_url, a.profit_gibert, a.best_resale_price, a.best_resale_platform, a.candidate_status, a.admin_status, a.gibert_checked_at) == (D("4.50"), "t", "img", D("2.50"), D("4.50"), "gibert", "resale_price_found", "new", now)
    assert (b.gibert_title, b.best_resale_price, b.best_resale_platform, b.candidate_status, b.admin_status, b.profit_gibert) == ("old", D("0.00"), None, "no_resale_offer", "pending", D("-2.00"))
    assert (c.candidate_status, c.gibert_price) == ("strong_candidate", D("0.00")) and (d.candidate_status, d.admin_status) == ("duplicate_selected", "pending_edition_choice") and e.updated_at is None
    said = spark.createDataFrame([(1, True, "2"), (2, False, "7"), (5, True, "10")], "book_id int, ok boolean, price string")
    got = {r.book_id: r for r in merge.apply_provider_b_lookup(books, said, F.lit(now)).collect()}
    assert (got[1].status, got[1].best_resale_platform, got[1].best_resale_price, got[1].admin_status) == ("gibert_price_found", "momox", D("3.00"), "new")
    assert (got[2].gibert_status, got[2].gibert_price, got[2].best_resale_platform, got[2].gibert_checked_at, got[2].updated_at) == ("gibert_failed", None, "momox", None, now)
    assert (got[5].admin_status, got[5].best_resale_platform) == ("validated", "gibert")


def test_table_functions_in_sql(spark):
    from folioforge.functions import isbn

    sql.register(spark)
    texts = ["978-2-09-255334-3 and /dp/2092553348.", "9782092553344 x2092553348 2092553348X", None, "isbn 080442957x, 0-00"]
    spark.createDataFrame(list(enumerate(texts)), "id int, said string").createOrReplaceTempView("said_things")
    frame = spark.sql("SELECT id, n.isbn13, n.via FROM said_things, LATERAL numbers_in(said) AS n")
    plain = spark.table("said_things").select("id", F.explode(isbn.find_in_text(F.col("said"))).alias("x")).select("id", "x.isbn13", "x.via")
    assert bag(frame) == bag(plain) and frame.count() == 4
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def recorded(spark, tmp_path):
    path = tmp_path / "sets"
    for b in range(3):
        for p in range(3):
            f = path / f"batch={b}" / f"{p}.jsonl"
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text("".join(json.dumps({"n": i, "blocked": (b, p, i) == (1, 1, 2)}) + "\n" for i in range(4)) + ("not json\n" if b == 2 else "\n"))
    paged.register(spark)
    return str(path)


def test_paged_source(spark, recorded):
    rows = spark.read.format("paged_dataset").option("path", recorded).load()
    assert {r.batch: r.n for r in rows.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {"0": 12, "1": 7, "2": 15}
    assert rows.filter("batch = '1' and blocked").select("page", "at").first() == (1, 6)
    assert rows.filter("batch = '0'").orderBy("at").select("at").collect() == [(i,) for i in range(12)]
    few = spark.read.format("paged_dataset").option("path", recorded).option("most", 5).option("size", 2).load()
    assert {r.batch: r.n for r in few.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {"0": 5, "1": 5, "2": 5}


def test_filters_reach_the_paged_source(spark, recorded):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = paged.PagedReader({"path": recorded})
    kept = list(reader.pushFilters([EqualTo(("batch",), "1"), GreaterThan(("at",), 2), In(("batch",), ("1", "2"))]))
    assert [type(f) for f in kept] == [GreaterThan] and [p.batch for p in reader.partitions()] == ["1"]
    rows = spark.read.format("paged_dataset").option("path", recorded).load().filter("batch = '2' and at > 2")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    line = plan.split("Filter", 1)[1].split("\n", 1)[0]
    assert rows.count() == 12 and " > 2" in line and " = 2" not in line
    assert spark.read.format("paged_dataset").option("path", recorded).load().filter("batch = 'none'").count() == 0
