"""Sinks: repeated and broken batches, commits of several tables; bucketed targets; streams in several batches."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioforge.operators import merge
from folioforge.plans.queue_queries import ROCKS
from folioforge.streaming import lifecycle, queue, sinks

COST = "ads_id long, event_id long, amount_usd double"


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture()
def store(spark, tmp_path):
    s = sinks.Store(spark, str(tmp_path / "store"), 4)
    empty = lambda schema: spark.createDataFrame([], schema)
    tables = sinks.costs()
    s.create({"cost_events": (empty(COST), tables["cost_events"]), "cost_totals": (empty("ads_id long, usd decimal(28,6), events long"), tables["cost_totals"])})
    return s, tables


def test_a_repeated_batch_changes_nothing(spark, store):
    s, tables = store
    one = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.25), (2, 3, 1.0)], COST)
    two = spark.createDataFrame([(1, 4, 0.125), (3, 5, 2.0)], COST)
    assert s.apply(one, 0, tables) and s.apply(two, 1, tables)
    before = bag(s.read("cost_events")), bag(s.read("cost_totals"))
    assert not s.apply(two, 1, tables) and not s.apply(one, 0, tables)
    assert (bag(s.read("cost_events")), bag(s.read("cost_totals"))) == before
    assert {r.ads_id: (float(r.usd), r.events) for r in s.read("cost_totals").collect()} == {1: (0.875, 3), 2: (1.0, 1), 3: (2.0, 1)}
    assert s.apply(spark.createDataFrame([], COST), 2, tables) and bag(s.read("cost_totals")) == before[1]


def test_a_batch_that_broke_before_its_commit_is_written_over(spark, store, monkeypatch):
    s, tables = store
    one = spark.createDataFrame([(1, 1, 0.5)], COST)
    with monkeypatch.context() as m:
        m.setattr(s, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.apply(one, 0, tables)
    assert s.read("cost_events").count() == 0 and s.read("cost_totals").count() == 0
    assert s.apply(one, 0, tables)
    assert bag(s.read("cost_events")) == Counter([(1, 1, 0.5)]) and s.read("cost_totals").first().events == 1


def test_only_touched_buckets_are_written(spark, store, tmp_path):
    s, tables = store
    s.apply(spark.createDataFrame([(i, i, 1.0) for i in range(200)], COST), 0, tables)
    s.apply(spark.createDataFrame([(7, 300, 1.0)], COST), 1, tables)
    assert len(list((tmp_path / "store/data/cost_totals/1").glob("__bucket=*"))) == 1 and len(list((tmp_path / "store/data/cost_totals/0").glob("__bucket=*"))) == 4
    assert s.read("cost_totals").count() == 200 and s.read("cost_totals").filter("ads_id = 7").first().events == 2


def test_listings_and_books(spark, tmp_path):
    s = sinks.Store(spark, str(tmp_path / "store"), 4)
    ads = spark.createDataFrame([(1, "old", "processed", 2)], "ads_id long, title string, status string, process_attempts int")
    books = spark.createDataFrame([(1, "i", None, 0, "validated", "momox_no_offer", None)], "ads_id long, isbn string, title string, image_index int, admin_status string, momox_status string, gibert_status string")
    tables = {"ads": sinks.listings()}
    s.create({"ads": (ads, tables["ads"]), "books": (books, sinks.books())})
    payload = spark.createDataFrame([(1, "new"), (2, "two")], "ads_id long, title string")
    for _ in range(2):
        s.apply(payload, 0, tables)
    assert bag(s.read("ads").select("ads_id", "title", "status", "process_attempts")) == Counter([(1, "new", "processed", 2), (2, "two", "new", 0)])
    rows = spark.createDataFrame([(1, "i", None, 0, "new", "momox_pending", "gibert_pending"), (1, None, "t", 3, "new", None, None)], books.schema)
    s.apply(rows, 1, {"books": sinks.books()})
    assert bag(s.read("books")) == Counter([(1, "i", None, 0, "validated", "momox_no_offer", "gibert_pending"), (1, None, "t", 3, "new", None, None)])


def test_a_bucketed_target_is_not_moved(spark, tmp_path):
    target = merge.bucketed(spark.range(5000).select("id", (F.col("id") % 7).alias("x")), "kept_in_buckets", ["id"], 8, str(tmp_path / "t"))
    source = spark.range(4000, 6000).select("id", F.lit(100).cast("long").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = merge.merge(target, source, ["id"], {}, null_keys=False)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 6000 and out.filter("x = 100").count() == 2000
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
        assert merge.merge(target, source, ["id"], {})._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _run(spark, tmp_path, name, rows, schema, make, files):
    import pandas as pd

    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    src = tmp_path / name
    for i, part in enumerate(files(frame)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(src / f"part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        make(stream).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k in ROCKS:
            spark.conf.unset(k)
    return bag(spark.read.parquet(str(tmp_path / f"{name}-out")))


def test_lifecycle_does_not_hang_on_batches(spark, tmp_path):
    import random

    import pandas as pd

    rng = random.Random(6)
    at = pd.Timestamp("2024-01-01")
    rows = []
    for i in range(400):
        at += pd.Timedelta(minutes=rng.choice([1, 5, 30, 120]))
        rows.append((rng.randrange(6), i, rng.choice(["claim", "start", "fail", "done", "other"]), at))
    schema = "job long, event_id long, kind string, ts timestamp"
    rules = lifecycle.Rules(kept_minutes=600)
    make = lambda s: lifecycle.transitions(s, rules)
    whole = _run(spark, tmp_path, "one", rows, schema, make, lambda f: [f])
    parts = _run(spark, tmp_path, "four", rows, schema, make, lambda f: [f[i : i + 100] for i in range(0, 400, 100)])
    assert whole == parts and {r[2] for r in whole} >= {"claimed", "retried", "stale_requeued", "no_callback", "dropped", "processed", "started"}


def test_lifecycle_by_hand(spark, tmp_path):
    import pandas as pd

    t = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    rows = [(1, 0, "claim", t(0)), (1, 1, "fail", t(10)), (1, 2, "claim", t(20)), (1, 3, "claim", t(200)), (2, 4, "start", t(0)), (3, 5, "claim", t(1)), (3, 6, "done", t(2)), (3, 7, "fail", t(3)), (9, 8, "other", t(500))]
    got = _run(spark, tmp_path, "hand", rows, "job long, event_id long, kind string, ts timestamp", lifecycle.transitions, lambda f: [f])
    us = lambda m: t(m).value // 1000
    assert got == Counter([
        (1, us(0), "claimed", 1, None), (1, us(10), "retried", 1, us(10) + 30_000_000), (1, us(20), "claimed", 2, None), (1, us(110), "stale_requeued", 2, us(110)), (1, us(200), "claimed", 3, None), (1, us(290), "stale_failed", 3, None),
        (2, us(0), "started", 1, None), (2, us(120), "no_callback", 1, None), (3, us(1), "claimed", 1, None), (3, us(2), "processed", 1, None),
    ])


def test_runs_without_an_end_come_out(spark, tmp_path):
    import pandas as pd

    t = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    rows = [(1, "s", t(0)), (1, "e", t(5)), (2, "s", t(1)), (3, "s", t(2)), (3, "e", t(200)), (8, "s", t(600)), (9, "e", t(600))]

    def make(s):
        return queue.stream_runs(s.filter("kind = 's'").select("run_id", "ts"), s.filter("kind = 'e'").select("run_id", "ts"), "1 hour").select("run_id", F.unix_timestamp("ended_at").alias("e"))

    got = _run(spark, tmp_path, "runs", rows, "run_id long, kind string, ts timestamp", make, lambda f: [f])
    assert got == Counter([(1, t(5).value // 10**9), (2, None), (3, None)])
