"""Similarity joins of token sets against all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioforge.functions import similarity
from folioforge.operators import set_join

RNG = random.Random(9)
WORDS = [f"w{i}" for i in range(60)]
WEIGHTS = [1 / (i + 1) for i in range(60)]
LEFT = {i: set(RNG.choices(WORDS + ["only-left"], [*WEIGHTS, 0.5], k=RNG.randint(0, 25))) for i in range(300)} | {900: set(), 901: {"only-left"}}
RIGHT = {i: set(RNG.choices(WORDS, WEIGHTS, k=RNG.randint(0, 12))) for i in range(40)} | {99: set(), 98: {"only-right"}}


@pytest.fixture(scope="module", params=[1000, 5])
def sides(spark, request):
    frame = lambda sets, key: spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], f"{key} long, tokens array<string>")
    old, set_join.FREQUENT = set_join.FREQUENT, request.param
    yield frame(LEFT, "l"), frame(RIGHT, "r")
    set_join.FREQUENT = old


def test_best_of_left(sides):
    got = {r.l: r.score for r in set_join.best_of_left(*sides).collect()}
    exp = {i: max(len(x & y) / len(x | y) for y in RIGHT.values() if x & y) for i, x in LEFT.items() if any(x & y for y in RIGHT.values())}
    assert got == pytest.approx(exp)


def test_overlapping(sides):
    got = {(r.l, r.r, r.n, r.m, r.shared) for r in set_join.overlapping(*sides).collect()}
    assert got == {(i, j, len(x), len(y), len(x & y)) for i, x in LEFT.items() for j, y in RIGHT.items() if x & y and 2 * len(x & y) >= min(len(x), len(y))}


def plain(o, n, m):
    low, high = min(n, m), max(n, m)
    inside = o / low if low >= 2 else 0
    return max(o / high, inside) if inside >= 0.85 else o / high


def measure(shared, n, m):
    return similarity.counted_similarity(shared, n, m, F.lit(False))


def test_groups(spark, sides):
    rows = [(i % 37, i) for i in LEFT] + [(5, 100), (6, 100)]
    members = spark.createDataFrame(rows, "g long, l long")
    extra = [(3, 1, 0.9), (4, 2, 0.05), (900, 3, 0.95)]
    more = spark.createDataFrame(extra, "l long, r long, score double")
    fixed = {(a, b): s for a, b, s in extra}
    pair = {(i, j): fixed.get((i, j), plain(len(x & y), len(x), len(y)) if x & y else 0.0) for i, x in LEFT.items() for j, y in RIGHT.items()}
    best, each = defaultdict(float), defaultdict(float)
    for g, i in rows:
        for j in RIGHT:
            best[g] = max(best[g], pair[i, j])
            each[j, g] = max(each[j, g], pair[i, j])
    got = {r.g: r.score for r in set_join.best_by_group(*sides, members, measure, more).collect()}
    assert got == pytest.approx({g: s for g, s in best.items() if s > 0})
    rounded = lambda s: round(s, 1)
    found = {(r.r, r.g): r.score for r in set_join.top_by_right(*sides, members, measure, 4, more, lambda c: F.round(c, 1)).collect()}
    assert all(found[k] <= each[k] + 1e-9 for k in found)
    for j in RIGHT:
        top = sorted(((-rounded(s), g) for (r, g), s in each.items() if r == j and s > 0))[:4]
        assert top == sorted((-rounded(s), g) for (r, g), s in found.items() if r == j)[:4]


def test_most_pairs_are_never_made(spark):
    """On skewed tokens the bound leaves few of the pairs that share one, and no pair at all is made twice."""
    rng = random.Random(1)
    words, weights = [f"t{i}" for i in range(3000)], [1 / (i + 1) for i in range(3000)]
    rows = [(i, list(set(rng.choices(words, weights, k=25)))) for i in range(600)]
    left, right = spark.createDataFrame(rows, "l long, tokens array<string>"), spark.createDataFrame([(i, t) for i, t in rows], "r long, tokens array<string>")
    sets = set_join.TokenSets.of(left, right)
    sharing = sum(1 for _, a in rows for _, b in rows if set(a) & set(b))
    least = spark.createDataFrame([(i,) for i, _ in rows], "l long").withColumn("least", F.lit(0.5))
    made = sets.met(set_join.jaccard, sets.asked(0, None).join(least, "l"), F.col("least")).count()
    exact = sum(1 for _, a in rows for _, b in rows if 2 * len(set(a) & set(b)) >= len(set(a) | set(b)))
    assert exact <= made < 0.2 * sharing
