"""Second versions: ordinal regression by plain gradient descent and plain scores; shards from the published loop."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from test_llm_operators import ROWS, docs, jump, none, odd  # noqa: F401

from folioforge.llm import sharding, toxicity


def chance(z):
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def plain_loss(rows, grades, weights, cuts, l1):
    """Summed log-likelihood of the grades and the penalty, row by row."""
    total = 0.0
    for ids, g in zip(rows, grades):
        s = sum(weights.get(int(i), 0.0) for i in ids)
        up = 1.0 if g == len(cuts) else chance(cuts[g] - s)
        low = 0.0 if g == 0 else chance(cuts[g - 1] - s)
        total -= math.log(max(up - low, 1e-12))
    return total + l1 * sum(map(abs, weights.values()))


def plain_fit(rows, grades, least, l1, steps=4000, rate=0.02):
    """Proximal gradient descent on a dense matrix."""
    names = sorted({int(i) for r in rows for i in r if sum(int(i) in set(map(int, x)) for x in rows) >= least})
    x = np.array([[float(n in set(map(int, r))) for n in names] for r in rows])
    top = int(max(grades))
    w, cuts = np.zeros(len(names)), np.linspace(0.5, 1.5, top)
    g = np.array(grades)
    for _ in range(steps):
        s = x @ w
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, low = 1 / (1 + np.exp(-np.clip(edge[g + 1] - s, -500, 500))), 1 / (1 + np.exp(-np.clip(edge[g] - s, -500, 500)))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        w = w - rate * (x.T @ (du - dl)) / len(rows)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / len(rows), 0)
        for k in range(top):
            cuts[k] -= rate * ((dl[g == k + 1]).sum() - du[g == k].sum()) / len(rows)
        cuts = np.sort(cuts)
    return dict(zip(names, w)), cuts


def made(n, seed):
    rng = random.Random(seed)
    rows, grades = [], []
    for _ in range(n):
        g = rng.choices([0, 1, 2], [6, 3, 2])[0]
        words = rng.sample(range(30), 6) + rng.sample([100, 101, 102], min(g, rng.randint(0, 2))) + (rng.sample([200, 201], 1) if g == 2 and rng.random() < 0.8 else [])
        rows.append(np.array(sorted(words), np.int64))
        grades.append(g)
    return rows, grades


@pytest.mark.parametrize("seed", [1, 2])
def test_fit_is_as_likely_as_a_plain_one(seed):
    rows, grades = made(300, seed)
    model = toxicity.fit(rows, np.array(grades), least=3, l1=1.0, steps=600)
    weights, cuts = plain_fit(rows, grades, 3, 1.0)
    held = {i: float(model.weights[i]) for i in set(np.concatenate(rows).tolist())}
    ours, theirs = plain_loss(rows, grades, held, model.thresholds, 1.0), plain_loss(rows, grades, weights, cuts, 1.0)
    assert ours <= 1.01 * theirs and list(model.thresholds) == sorted(model.thresholds)
    assert all(model.weights[i] > 0.3 for i in (100, 101, 102)) and model.weights[200] > 0
    # no small move of a weight or a threshold makes it better by more than a hair
    rng = random.Random(seed)
    for _ in range(40):
        moved, shifted = dict(held), np.array(model.thresholds)
        if rng.random() < 0.7:
            k = rng.choice(list(moved))
            moved[k] += rng.choice([-0.05, 0.05])
        else:
            shifted[rng.randrange(len(shifted))] += rng.choice([-0.05, 0.05])
        assert plain_loss(rows, grades, moved, shifted, 1.0) > ours - 0.1


def test_scores_are_the_plain_sums(spark, docs):  # noqa: F811
    rng = np.random.default_rng(5)
    model = toxicity.OrdinalModel(rng.normal(0, 1, toxicity.FEATURES), np.array([0.5, 1.25]))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.severity, r.grade, r.p_toxic, r.rejected) for r in toxicity.score_documents(docs, model).collect())
    exp = []
    import re
    import zlib

    for i, t in ROWS:
        flat = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", flat))
        s = sum(float(np.float32(model.weights[n])) for n in {zlib.crc32(w.encode()) % toxicity.FEATURES for w in words})
        above = [chance(s - c) for c in (0.5, 1.25)]
        each = [1 - above[0], above[0] - above[1], above[1]]
        exp.append((i is None, i or 0, sum(above), each.index(max(each)), above[0], above[0] >= 0.25))
    for a, b in zip(got, sorted(exp)):
        assert a[:2] == b[:2] and a[3] == b[3] and a[5] == b[5] and a[2] == pytest.approx(b[2], abs=1e-4) and a[4] == pytest.approx(b[4], abs=1e-4)
    assert len(got) == len(exp)


def test_shards_are_those_of_the_loop(spark, docs):  # noqa: F811
    from pyspark.sql import functions as F

    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0000null"))).alias("h")).collect()}
    for r in sharding.shard_digest(docs).collect():
        key = hashed[r.doc_id] % 2**64
        assert (r.shard, r.grown_shard) == (jump(key, 8), jump(key, 9))


def test_lines_of_unicode_blanks_stay(spark):
    from folioforge.llm import lines

    blanks = [" ", "　  ", "\x1c", "\x85", " \t", " "]
    rows = [(i, "\n".join([("alpha beta gamma", "one two three four", "red green blue")[i], *blanks, *blanks])) for i in range(3)] + [(9, "​\n​")]
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0, t) for i, t in rows[:3]) and got[9] == (1, "​")


def test_labels_of_more_than_two_values_are_yes_or_no():
    rows = [np.array([1, 2, 3], np.int64), np.array([1, 9], np.int64)] * 20
    assert set(toxicity.graded(rows, np.array([5, 0] * 20)).tolist()) <= {0, 1, 2} and toxicity.graded(rows, np.array([-1, 0] * 20)).max() == 0
