"""A cell that pivots do not cut is not copied into all their regions, round after round."""

from __future__ import annotations

import random

import numpy as np

from folioforge.llm import jaccard


def near_copies(n, rng):
    """Texts of 300 words with words changed here and there: most pairs are about 0.25 apart, some are linked."""
    base, out = [f"w{i}" for i in range(300)], []
    for i in range(n):
        words = list(out[-1].split()) if i % 5 == 4 else list(base)
        for _ in range(2 if i % 5 == 4 else rng.randrange(5, 10)):
            words[rng.randrange(300)] = f"v{rng.random()}"
        out.append(" ".join(words))
    return out


def brute(texts, rule):
    sets, least = [rule.sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if rule.linked(both, len(sets[i]), len(sets[j])):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    return least


def test_near_copies_in_one_large_cell(spark, monkeypatch):
    texts, moved, keep = near_copies(240, random.Random(3)), {}, jaccard.stored

    def watched(df, name):
        out = keep(df, name)
        if "text" in out.columns and "cell" in out.columns:
            moved[name] = moved.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", watched)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = jaccard.Rule(cell_shingles=20_000)
    got = [r.component_id for r in jaccard.join_components(rows, rule=rule).orderBy("doc_id").collect()]
    assert got == brute(texts, rule)
    assert 0 < sum(a != b for a, b in enumerate(got)) < 240
    assert moved["members"] >= 200  # one cell
    assert sum(moved.values()) < 12 * 240
