"""A winner and its lead need two rows of a group: the others do not travel."""

from __future__ import annotations

import random

from folioforge.operators import relational


def test_two_rows_of_a_group_travel(spark):
    rng = random.Random(3)
    rows = [(g, f"n{i}", rng.choice([0.3, 0.5, 0.7, 0.85, 0.9, 1.0, None]), rng.choice([0.5, 0.8, None]), rng.choice(["match", "mismatch"])) for g in range(60) for i in range(g % 9)]
    covers = spark.createDataFrame(rows, "g long, isbn13 string, similarity double, confidence double, match_status string")
    won = relational.single_winner(covers, "g")
    plan = won._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    exp = {}
    for g in range(60):
        ranked = sorted((-s, -(c or 0.0), n) for k, n, s, c, _ in rows if k == g and s is not None)
        if ranked:
            exp[g] = (-ranked[0][0], round(ranked[1][0] - ranked[0][0], 2) if len(ranked) > 1 else 1.0)
    assert {r.g: (r.best, r.gap) for r in won.collect()} == exp
