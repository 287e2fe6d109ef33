"""Transitions of jobs, crops and choices in order, by literal cases."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioforge.functions import isbn, numbers
from folioforge.operators import relational
from folioforge.plans import pipelines
from folioforge.streaming import queue

NOW = datetime(2024, 1, 1, 12)
JOB = "job_id int, type string, status string, stage string, attempts int, progress int, error_code string, error_message string, locked_by string, locked_at timestamp, started_at timestamp, next_run_at timestamp, finished_at timestamp, updated_at timestamp"


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def job(i, kind="apify_payload_processing", status="processing", stage="s", attempts=1, progress=None, error=None, age=100):
    at = NOW - timedelta(minutes=age)
    return (i, kind, status, stage, attempts, progress, error, None, "w", at, at, None, None, None)


def test_failure_frees_the_lock_and_sets_all(spark):
    rows = [job(1), job(2, attempts=3, progress=70), job(3, status="processed"), job(4), job(5, status="queued", attempts=50)]
    said = spark.createDataFrame([(i, "e", "m" * 3000) for i in (1, 2, 3, 5)], "job_id int, error_code string, message string")
    got = {r.job_id: r for r in queue.after_failure(spark.createDataFrame(rows, JOB), said, F.lit(NOW)).collect()}
    a, b, c, d, e = (got[i] for i in range(1, 6))
    assert (a.status, a.stage, a.progress, a.error_code, len(a.error_message), a.locked_by, a.locked_at, a.next_run_at, a.finished_at, a.updated_at) == ("queued", "queued", 30, "e", 2000, None, None, NOW + timedelta(seconds=30), None, NOW)
    assert (b.status, b.stage, b.progress, b.next_run_at, b.finished_at) == ("failed", "failed", 70, None, NOW)
    assert (c.status, c.locked_by, c.error_code) == ("processed", "w", None) and (d.status, d.locked_by) == ("processing", "w")
    assert (e.status, e.finished_at) == ("failed", NOW)


def test_stale_locks(spark):
    rows = [job(1, attempts=2), job(2, attempts=3, error="x"), job(3, attempts=3), job(4, age=89), job(5, kind="apify_start_manual_ad"), job(6, status="queued")]
    got = {r.job_id: (r.status, r.stage, r.progress, r.error_code, r.locked_by, r.next_run_at, r.finished_at) for r in queue.after_stale_lock(spark.createDataFrame(rows, JOB), F.lit(NOW)).collect()}
    assert got[1] == ("queued", "s", None, "stale_lock_requeued", None, NOW, None)
    assert got[2] == ("failed", "failed", 30, "x", None, None, NOW) and got[3][3] == "attempts_exhausted_stale_lock"
    assert all(got[i][4] == "w" for i in (4, 5, 6))


def test_missing_callback_is_terminal_with_attempts_left(spark):
    rows = [job(1, kind="apify_start_manual_ad", stage="apify_running", attempts=0, age=121), job(2, kind="apify_start_search_page", stage="starting_apify", age=119), job(3, stage="apify_running", age=500), job(4, kind="apify_start_manual_ad", stage="other", age=500)]
    got = {r.job_id: (r.status, r.error_code) for r in queue.after_missing_callback(spark.createDataFrame(rows, JOB), F.lit(NOW)).collect()}
    assert got == {1: ("failed", "apify_run_stale_no_webhook"), 2: ("processing", None), 3: ("processing", None), 4: ("processing", None)}


def test_crop_rectangle_and_turn(spark):
    nan, inf = float("nan"), float("inf")
    boxes = [
        ([0.2, 0.2, 0.4, 0.6], 1000, 500), ([0.4, 0.6, 0.2, 0.2], 1000, 500), ([0.5, 0.5, 0.5, 0.5], 100, 100), (None, 640, 480), ([0.1, 0.2], 640, 480), ([nan, 0.0, 1.0, 1.0], 640, 480), ([0.0, inf, 1.0, 1.0], 640, 480),
        ([1.0, 1.0, 1.0, 1.0], 100, 100), ([None, 0.0, 0.5, 0.5], 100, 100), ([-2.0, -2.0, 3.0, 3.0], 10, 10), ([0.0, 0.0, 1.0, 1.0], 0, 10), ([0.0, 0.0, 1.0, 1.0], None, 10),
    ]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "i int, box array<double>, w int, h int")
    got = [r.c if r.c is None else tuple(r.c) for r in df.select("i", numbers.crop_rectangle(F.col("box"), F.col("w"), F.col("h")).alias("c")).orderBy("i").collect()]
    whole = (0, 0, 640, 480)
    # 0.2 - 0.15 * 0.2 = 0.17 and 0.26 wide; 0.2 - 0.15 * 0.4 = 0.14 and 0.52 high
    assert got[:7] == [(170, 70, 260, 260), (170, 70, 260, 260), (50, 50, 1, 1), whole, whole, whole, whole]
    assert got[7:] == [(99, 99, 1, 1), (0, 0, 57, 57), (0, 0, 10, 10), None, None]
    turns = spark.createDataFrame([("vertical_up",), ("vertical_down",), ("horizontal",), ("rotated 90",), (None,)], "o string").select(numbers.rotation(F.col("o"))).collect()
    assert [r[0] for r in turns] == [-90, 90, 0, 0, 0]


def chosen(spark, rows, per_owner=2, per_group=4):
    df = spark.createDataFrame(rows, "g int, owner int, pos int, item string")
    return [tuple(r) for r in relational.choose_in_order(df, ["g"], "owner", ["owner", "pos"], "item", per_owner, per_group).select("g", "owner", "item").orderBy("g", "place").collect()]


def test_choices_rule_out_later_ones(spark):
    assert chosen(spark, [(0, 1, 0, "x"), (0, 2, 0, "x"), (0, 2, 1, "y"), (0, 2, 2, "z")]) == [(0, 1, "x"), (0, 2, "y"), (0, 2, "z")]
    assert chosen(spark, [(0, o, i, f"{o}{i}") for o in range(3) for i in range(3)]) == [(0, 0, "00"), (0, 0, "01"), (0, 1, "10"), (0, 1, "11")]


def test_choices_against_a_plain_loop(spark):
    import random

    rng = random.Random(8)
    rows = [(g, o, i, rng.choice("abcdefgh")) for g in range(40) for o in range(rng.randint(1, 6)) for i in range(rng.randint(1, 12))]
    exp = []
    for g in range(40):
        taken, total = set(), 0
        for o in sorted({r[1] for r in rows if r[0] == g}):
            n = 0
            for _, _, _, item in sorted(r for r in rows if r[:2] == (g, o)):
                if n < 2 and total < 5 and item not in taken:
                    taken.add(item)
                    n, total = n + 1, total + 1
                    exp.append((g, o, item))
    assert chosen(spark, rows, 2, 5) == exp


def test_alternatives_are_rows_to_be_priced(spark):
    n = [r[0] for r in spark.range(1, 6).select(isbn.synthetic(F.col("id"))).collect()]
    books = spark.createDataFrame(
        [(1, 10, n[0], "mismatch", 3.0, None, "lt", "t"), (1, 11, n[1], "mismatch", 0.0, 2.0, None, "t2"), (1, 12, n[2], "mismatch", 0.0, 0.0, None, None), (1, 13, n[3], "match", 5.0, 5.0, None, None)],
        "ads_id int, book_id int, isbn string, provider_match_status string, momox_price double, gibert_price double, lookup_title string, title string",
    )
    found = spark.createDataFrame(
        [(10, 0, n[1], None, None, "c", True, None), (10, 1, None, n[4], None, None, None, True), (11, 0, n[4], None, None, None, True, True), (12, 0, "9782070368228", None, None, None, True, True), (11, 1, "9782092553343", None, None, None, False, None), (11, 2, "junk", None, None, None, True, None)],
        "book_id int, ord int, isbn13 string, isbn string, isbn10 string, title string, exact_title_match boolean, article_insensitive_title_match boolean",
    )
    out = pipelines.mismatch_alternatives(books, found).collect()
    assert [(r.book_id, r.isbn, r.title, r.lookup_title, r.momox_price, r.candidate_status, r.gibert_status) for r in out] == [(10, n[4], "lt", "lt", 0, "alternative_edition", "gibert_pending")]
