"""Personal data: patterns and dynamic program against brute force, held-out accuracy of the model."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from test_llm_operators import ROWS, docs, none, odd  # noqa: F401

from folioforge.llm import pii

EMAIL, IP, CARD, PHONE = (
    re.compile(p)
    for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
)


def sums_to_ten(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        total += sum(map(int, str(int(c) * (1 + k % 2))))
    return total % 10 == 0


def plain_base(t):
    num = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(num(m)) <= 19 and sums_to_ten(num(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(num(m)) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(2)
    for _ in range(30000):
        t = "".join(rng.choices(rng.choice(["ab@.-_ 1", "0123 -.", "+12 ().-3a", "a@b.c+1 -é٣"]), k=rng.randint(0, 30)))
        assert pii.base_spans(t) == plain_base(t), t
    card = "4111111111111111"
    for t in (card, f"x{card}y", f"{card} {card}", "4111-1111-1111-1111", "4111 1111 1111 1112", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004", "a@b@c.de", "x@y.z@w.q", "+1 (826) 555-4081 1.2.3.4"):
        assert pii.base_spans(t) == plain_base(t), t


def segmentations(n, spans, at=0):
    if at == n:
        yield []
        return
    for rest in segmentations(n, spans, at + 1):
        yield [(at, -1), *rest]
    for k, (a, b, _) in enumerate(spans):
        if a == at:
            for rest in segmentations(n, spans, b):
                yield [(at, k), *rest]


def test_dynamic_program_is_the_sum_and_the_best_over_all_segmentations():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        spans = sorted({(a, min(n, a + rng.randint(1, 4)), rng.randrange(4)) for a in [rng.randrange(n) for _ in range(rng.randint(1, 5))]})
        out, scores = [rng.uniform(-2, 2) for _ in range(n)], [rng.uniform(-3, 3) for _ in spans]
        steps = [[rng.uniform(-1, 1) for _ in range(pii.OUT + 1)] for _ in range(pii.OUT + 2)]
        held = []
        for seg in segmentations(n, spans):
            last, total = pii.OUT + 1, 0.0
            for at, k in seg:
                label = pii.OUT if k < 0 else spans[k][2]
                total += steps[last][label] + (out[at] if k < 0 else scores[k])
                last = label
            held.append((total, [k for _, k in seg if k >= 0]))
        alpha, total = pii.forward(n, spans, out, scores, steps)
        beta = pii.backward(n, spans, out, scores, steps)
        everything = math.log(sum(math.exp(v) for v, _ in held))
        assert abs(total - everything) < 1e-9 and abs(beta[0][pii.OUT + 1] - everything) < 1e-9
        top = max(v for v, _ in held)
        assert any(abs(v - top) < 1e-9 and ks == pii.viterbi(n, spans, out, scores, steps) for v, ks in held)
        for k, (a, b, kind) in enumerate(spans):
            p = math.exp(pii.lse([alpha[a][y] + steps[y][kind] for y in range(pii.OUT + 2)]) + scores[k] + beta[b][kind] - total)
            assert abs(p - sum(math.exp(v - everything) for v, ks in held if k in ks)) < 1e-9


def test_fit_climbs_to_a_point_where_the_gradient_is_small():
    cases = pii.cases_of([], more=150)
    few, many = pii.fit(cases, rounds=2), pii.fit(cases, rounds=30)

    def likelihood(model):
        total = 0.0
        for text, gold in cases:
            tokens = pii.tokens_of(text, 0, len(text))
            spans = pii.candidates(text, tokens)
            place = {(tokens[a][0], kind, tokens[b - 1][1]): k for k, (a, b, kind) in enumerate(spans)}
            if not spans or any(g not in place for g in gold):
                continue
            out, scores = model.lattice(text, tokens, spans)
            last, at, gain = pii.OUT + 1, 0, 0.0
            for k in [place[g] for g in sorted(gold)] + [None]:
                a = len(tokens) if k is None else spans[k][0]
                for j in range(at, a):
                    gain += model.steps[last][pii.OUT] + out[j]
                    last = pii.OUT
                if k is not None:
                    gain += model.steps[last][spans[k][2]] + scores[k]
                    last, at = spans[k][2], spans[k][1]
            total += gain - pii.forward(len(tokens), spans, out, scores, model.steps)[1]
        return total

    assert likelihood(few) < likelihood(many) < 0
    assert pii.fit([]).find("call (509) 555-6973", 0, 19) is not None


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_spans(model):
    """Values of another seed: most of the items that the patterns miss are found whole, and few spans are false."""
    hit = false = total = 0
    for text, gold in pii.cases_of([], seed=99, more=1500):
        base, added = pii.spans_of(text, model)
        missed = {g for g in gold} - {*base}
        missed = {g for g in missed if not any(g[0] < e and s < g[2] for s, _, e in base)}
        hit, total, false = hit + len(missed & {*added}), total + len(missed), false + len({*added} - {*gold})
    assert total > 300 and hit >= 0.9 * total and false <= 0.05 * total


def test_numbers_that_are_none(model):
    for t in ("on 2024-01-15 10:30:00", "isbn 978-3-16-148410-0", "order 12345-67890", "id 1234567890123456", 'token = "9a8b99b6f89edc9746a2ef7e89e21f68"', "pi 3.14159265", "look at dot matrix", "1,234,567,890", "v1.2.3"):
        assert pii.spans_of(t, model) == ([], []), t


def test_run_together(model):
    def found(t):
        base, added = pii.spans_of(t, model)
        return sorted((pii.KINDS[k], t[s:e]) for s, k, e in base + added)

    assert found("see +1 (826) 555-4081 190.137.223.204 now") == [("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")]
    assert found("x 4111111111111111 5500000000000004 y") == [("card", "4111111111111111"), ("card", "5500000000000004")]
    assert found("mail jo.do at example dot com please") == [("email", "jo.do at example dot com")]


def test_digest(spark, docs, odd, none, model):  # noqa: F811
    more = [(500, "a@b.cd 1.2.3.4 +1 (826) 555-4081, 4111 1111 1111 1111"), (501, "é" * 9 + " x@y.zz"), (502, "9" * 200_000), (503, "1." * 50_000), (504, "+1" + " " * 50_000), (505, "a" * 100_000 + "@"), (506, "@" * 50_000)]
    rows = ROWS + more
    got = pii.personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    exp = Counter()
    for i, t in rows:
        base = plain_base(t or "") if len(t or "") < 150_000 else []
        n = Counter(k for _, k, _ in base)
        exp[i, n[0], n[1], n[2], n[3], hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == exp
    for r in got:
        held = [x.split(":") for x in r.spans.split(",") if x]
        assert held == sorted(held, key=lambda x: (int(x[1]), pii.KINDS.index(x[0]))) and len(held) >= r.n_email + r.n_ip + r.n_card + r.n_phone
    assert pii.personal_data_digest(none, model).count() == 0 and pii.personal_data_digest(odd, model).count() == len(ROWS)
    assert pii.train(none).find("1.2.3.4", 0, 7) is not None
