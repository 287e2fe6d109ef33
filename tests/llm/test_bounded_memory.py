"""What a worker holds while it meets a cell's texts with pivots does not grow with the cell times its pivots."""

from __future__ import annotations

import tracemalloc

import numpy as np

from folioforge.llm import jaccard


def dense(n, rng):
    """Sets that share half of their shingles, none linked."""
    some = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    common = some(120)
    return [np.unique(np.concatenate([common, some(130)])) for _ in range(n)]


def test_pivots_meet_a_dense_cell_in_bounded_memory():
    sets, rule = dense(1500, np.random.default_rng(1)), jaccard.Rule(size=5, num=80)
    pivots, size = jaccard.Pivots(sets[:64], rule), np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    assert len(pivots.size) == 64
    tracemalloc.start()
    found = pivots.shared(flat, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in (0, 1, 700, 1499):
        assert found[i].tolist() == [len(np.intersect1d(sets[i], p)) for p in sets[:64]]
    assert peak < 150e6


def test_copies_after_a_task_has_forgotten_them(spark, monkeypatch):
    """Equal and linked texts are found whether or not a task passes copies over."""
    words = [[f"{a}{i}" for i in range(40)] for a in "abcde"]
    texts = [" ".join(w[: 40 - i % 2]) for i in range(6) for w in words]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        monkeypatch.setattr(jaccard, "SEEN", 2)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: (38 - i // 5 % 2, i % 5) for i in range(30)}
