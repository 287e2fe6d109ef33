"""Nearest neighbours against all pairs: copies, odd vectors, many small blocks."""

from __future__ import annotations

import numpy as np
import pytest

from folioforge.operators import vectors


def made(n=400, dims=6, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (8, dims))
    rows = [(int(i), (centres[rng.integers(8)] + rng.normal(0, 0.3, dims)).astype(np.float32).tolist()) for i in rng.permutation(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, [2 * x for x in rows[1][1]]), (2001, [-x for x in rows[1][1]])]
    odd = [(3000, None), (3001, []), (3002, [0.0] * dims), (3003, [float("nan")] * dims), (3004, [1.0] * (dims + 1)), (3005, [None] + [1.0] * (dims - 1)), (None, rows[2][1]), (3006, [float("inf")] + [1.0] * (dims - 1))]
    return rows, odd


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    sims = np.round(x @ x.T, 9)
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-sims[a, b], ids[b]))[:k]
        out |= {(int(ids[a]), r + 1, int(ids[b]), round(float(sims[a, b]), 6)) for r, b in enumerate(order)}
    return out


@pytest.mark.parametrize(("pivots", "block"), [(256, 2048), (7, 20), (1, 30)])
def test_nearest(spark, pivots, block):
    rows, odd = made()
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.rank, r.neighbour, round(r.similarity, 6)) for r in vectors.nearest(df, 5, pivots=pivots, block=block).collect()}
    exp = brute(rows, 5)
    loose = lambda rows_: {(a, b, c) for a, b, c, _ in rows_}
    assert loose(got) == loose(exp) and max(abs(dict(((a, b), s) for a, b, _, s in got)[a, b] - s) for a, b, _, s in exp) < 1e-5


def test_few_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert vectors.nearest(frame([])).count() == 0 and vectors.nearest(frame([(1, [0.0, 0.0])])).count() == 0
    assert vectors.nearest(frame([(1, [1.0, 0.0])])).count() == 0
    two = vectors.nearest(frame([(2, [1.0, 0.0]), (1, [1.0, 1.0])])).collect()
    assert {(r.vec_id, r.rank, r.neighbour, round(r.similarity, 6)) for r in two} == {(1, 1, 2, 0.707107), (2, 1, 1, 0.707107)}


def test_bounds_leave_blocks_out(spark, monkeypatch):
    """On clustered vectors a row is sent to few of the cells."""
    rows, _ = made(900, 4)
    kept = {}
    store = vectors._stored

    def watched(df, name):
        out = store(df, name)
        kept[name] = out
        return out

    monkeypatch.setattr(vectors, "_stored", watched)
    vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5, pivots=64, block=64).count()
    cells = kept["cells"].select("cell").distinct().count()
    asked = kept["seeds"].selectExpr("avg(size(visit)) AS n").first().n
    assert cells > 30 and asked < 0.5 * cells
