"""Calls on one row after another, and on pieces of a batch."""

from __future__ import annotations

from folioforge.plans import pipelines as P


def test_each_row_is_called_once(spark):
    big = (1 << 60) + 1
    calls = spark.sparkContext.accumulator(0)

    def call(k, v):
        calls.add(1)
        return k, v // (k % 2)

    rows = spark.createDataFrame([(i, big if i % 5 else None) for i in range(100)], "k long, v long").coalesce(1)
    got = P.guarded_each(rows, call, "k long, v long", ["k"]).collect()
    assert calls.value == 100
    good = {r.k: r.v for r in got if r.error is None}
    assert good == {i: big for i in range(100) if i % 2 and i % 5} and len(got) == 100
    assert all(r.v is None and r.error for r in got if r.k not in good)


def test_pieces_of_a_batch_keep_whole_numbers(spark):
    import pandas as pd

    big = (1 << 60) + 1

    def call(f):
        if (f["k"] == 2).any():
            raise ValueError("bad")
        return pd.DataFrame({"k": f["k"], "v": [None if (f["k"] < 2).all() else big] * len(f)})

    out = P.guarded_map(spark.range(6).withColumnRenamed("id", "k").coalesce(1), call, "k long, v long", ["k"]).collect()
    assert {r.k: r.v for r in out if r.error is None and r.v is not None}[3] == big and len(out) == 6
