"""Ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from test_llm_operators import ROWS, WORDS, docs, none, odd  # noqa: F401

from folioforge.llm import search

RNG = random.Random(21)


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k=20):
    held = [(i, Counter(w), len(w)) for i, t in rows if (w := terms(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c, length in held:
            m = 75 + 25 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        found.sort()
        out.update((item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(found[:k]))
    return out


ITEMS = [(0, None), (1, ""), (2, " .,! "), (3, "x X x"), (4, "é ünïcode 日本"), (5, "nosuchterm"), (None, prose(5)), (7, prose(7)), (7, prose(60)), (8, " ".join(t or "" for _, t in ROWS[10:13])), (9, ROWS[-1][1])]


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bound", [1 << 22, 600])
def test_search(spark, docs, odd, none, bound):  # noqa: F811
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    exp = brute(ROWS, ITEMS)
    assert bag(search.search(docs, items, max_index_bytes=bound)) == exp and len(exp) > 60
    if bound > 600:
        assert bag(search.search(odd, items)) == exp
        assert bag(search.search(docs, items, k=3)) == brute(ROWS, ITEMS, 3)
        assert search.search(none, items).count() == 0
        assert search.search(docs, none.toDF("item_id", "text")).count() == 0
        assert search.search(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), items).count() == 0


def test_ties_and_copies(spark):
    rows = [(i, "alpha beta gamma") for i in range(50, 0, -1)] + [(100 + i, "alpha " * (i % 3 + 1) + prose(i % 7)) for i in range(200)]
    items = [(1, "alpha"), (2, "alpha beta"), (3, "gamma gamma gamma delta")]
    got = bag(search.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(rows, items)


def test_seeds_prune_and_lose_nothing(spark):
    """On skewed terms most of an item's terms generate no candidates, and the lists stay whole."""
    import numpy as np

    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 1) for i in range(2000)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(5, 200)))) for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, weights, k=30))) for i in range(20)]
    d, q = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    made = []
    keep = search.Seeds.__init__

    def spy(self, *a, **b):
        keep(self, *a, **b)
        made.append((len(self.item), len(a[0].term), int(np.min(self.least))))

    search.Seeds.__init__ = spy
    try:
        assert bag(search.search(d, q)) == brute(rows, items)
    finally:
        search.Seeds.__init__ = keep
    (generating, all_terms, least), *_ = made
    assert least > 1 and generating < 0.8 * all_terms
