"""Personal data by a semi-Markov conditional random field over candidate spans.

Fixed patterns give the base spans of a text. Around digits, signs of mail
addresses and spelled-out addresses a text is cut into tokens; spans of tokens
with the rough build of a kind are candidates. Whole-span features (groups of
digits, check sums, separators, neighbours, the word before) and the kinds of
neighbouring segments are weighed together, and a dynamic program over all
segmentations chooses boundaries and kinds jointly; entities have at most
:data:`MAX_TOKENS` tokens. It finds what the patterns' greedy matches spoil or
miss: runs of two numbers, numbers without a plus sign, spelled-out addresses.

The model is fitted by maximum conditional likelihood on a bounded sample:
base spans of sampled documents, and the same spans rewritten and run together.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, text_slices, worker_cache

KINDS = ("email", "ip", "card", "phone")
#: Longest entity, in tokens.
MAX_TOKENS = 40
#: Bounds of the sample that the model is fitted on: documents (those of least hash of their id among documents with
#: a digit or an at sign), places of a document, characters of a place.
SAMPLE_ROWS, SAMPLE_PLACES, PLACE_CHARS = 800, 2, 300
#: Least posterior probability of a span that is added.
CONFIDENCE = 0.5

# --- base spans: fixed patterns

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
SPACED = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order; each kind is matched from the left on its own.

    A match is found once in linear time: a dotted run gives its parts by fours,
    a spaced run is one match, an at sign takes the name before and the domain behind it.
    """
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in LOCAL:
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at + 1)):
            out.append((lo, 0, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        lo = m.start()
        for k in range(0, len(parts) - 3, 4):
            hi = lo + sum(map(len, parts[k : k + 4])) + 3
            if all(map(octet, parts[k : k + 4])):
                out.append((lo, 1, hi))
            lo = hi + 1
    for m in SPACED.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in DIALLED.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- places, tokens and candidate spans

TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[\s\S]")
#: Chunks with a digit or an at sign with the chunks between them, and the word before.
PLACE = re.compile(r"(?:[^\W\d_]{1,24}[\x20:=]{1,3})?[^\s0-9@]{0,80}[0-9@][^\s]{0,160}(?:[\x20][^\s0-9@]{0,40}[0-9@][^\s]{0,160}){0,12}")
AT_WORD, DOT_WORD = r"(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)", r"(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\.)"
SPELLED = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{AT_WORD}[A-Za-z0-9-]{{1,63}}(?:{DOT_WORD}[A-Za-z0-9-]{{1,63}}){{1,5}}")
#: Words before a value that speak for its kind, or against any.
CUES = frozenset("tel telephone phone call mobile fax ring mail email contact write card visa mastercard credit pay ip host address server addr token version id no order ref invoice isbn date".split())


def places(text: str) -> list[tuple[int, int]]:
    """Non-overlapping (start, end) to be searched."""
    found = [m.span() for m in PLACE.finditer(text)] if re.search("[0-9@]", text) else []
    if "at" in text and ("dot" in text or "[at]" in text or "(at)" in text or "{at}" in text):
        found += [m.span() for m in SPELLED.finditer(text) if "@" not in m.group() and re.search(r"[\[({]at[\])}]|\x20dot\x20|[\[({]dot[\])}]", m.group())]
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def around(text: str, lo: int, hi: int) -> tuple[str, str]:
    """Classes of the characters beside a span: kinds of number joints look one further."""

    def kind(near: str, far: str) -> str:
        if not near:
            return "edge"
        if near.isdigit():
            return "digit"
        if near.isalpha():
            return "letter"
        if near in ".-,:/" and far.isdigit():
            return "joint" + near
        if near == " ":
            return "blank-digit" if far.isdigit() or far == "+" or far == "(" else "blank"
        return near if near in ".+@-_(=\"'" else "mark"

    at = lambda i: text[i] if 0 <= i < len(text) else ""
    return kind(at(lo - 1), at(lo - 2)), kind(at(hi), at(hi + 1))


def cue(text: str, lo: int) -> str:
    word = re.search(r"([A-Za-z]{1,20})[^A-Za-z0-9]{0,4}\Z", text[max(0, lo - 26) : lo])
    return word[1].lower() if word and word[1].lower() in CUES else "none"


def features(text: str, lo: int, hi: int, kind: int) -> list[str]:
    span, name = text[lo:hi], KINDS[kind]
    left, right = around(text, lo, hi)
    out = [name, f"{name} left {left}", f"{name} right {right}", f"{name} after {cue(text, lo)}"]
    if kind == 0:
        domain = re.split(r"@|" + AT_WORD, span)[-1]
        last = re.split(DOT_WORD, domain)[-1]
        return [*out, f"{name} {'sign' if '@' in span else 'spelled'}", f"{name} ends {'alpha' if last.isalpha() and len(last) > 1 else 'else'}", f"{name} dotted {'.' in span or 'dot' in span}"]
    digits = digits_of(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    marks = "".join(sorted({c for c in span if not "0" <= c <= "9"}))
    out += [f"{name} digits {len(digits)}", f"{name} groups {'-'.join(map(str, groups))}", f"{name} marks {marks}"]
    if kind == 2:
        good = luhn(digits)
        return [*out, f"{name} sum {good}", f"{name} sum {good} groups {len(set(groups[:-1])) < 2}"]
    if kind == 3:
        even = span.count("(") == span.count(")") and re.search(r"\([^)]*\(|\)[^(]*\)|[ .-]{3}", span) is None
        return [*out, f"{name} starts {span[0] if span[0] in '+(' else 'digit'}", f"{name} starts {span[0] if span[0] in '+(' else 'digit'} {'-'.join(map(str, groups[-3:]))}", f"{name} even {even}"]
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first token, end token, kind) of the spans that have the rough build of a kind."""
    starts = {lo: k for k, (lo, _) in enumerate(tokens)}
    ends = {hi: k + 1 for k, (_, hi) in enumerate(tokens)}
    out = []
    first, stop = tokens[0][0], tokens[-1][1]
    for k, (lo, hi) in enumerate(tokens):
        c = text[lo]
        if "0" <= c <= "9" or c in "+(":
            digits, dots, octets = 0, 0, True
            for j in range(k, min(len(tokens), k + MAX_TOKENS)):
                a, b = tokens[j]
                if "0" <= text[a] <= "9":
                    digits += b - a
                    octets = octets and b - a <= 3 and octet(text[a:b])
                    if digits > 19:
                        break
                    span = text[lo:b]
                    if octets and dots == 3 and (j - k) == 6 and c not in "+(":
                        out.append((k, j + 1, 1))
                    if digits >= 12 and c not in "+(" and not set(span) - set("0123456789 -."):
                        out.append((k, j + 1, 2))
                    if 9 <= digits <= 15 and (c in "+(" or j > k):
                        out.append((k, j + 1, 3))
                elif text[a] in "().- " or text[a] == "+" and j == k:
                    dots += text[a] == "."
                    if text[a] == " " and j > k and text[a - 1] == " ":
                        break
                else:
                    break
    at = text.find("@", first, stop)
    while at >= 0:
        lo = at
        while lo > first and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1, stop)
        if lo < at and m:
            for a in range(lo, at):
                if a in starts and (a == lo or text[a - 1] in "._%+-"):
                    for b in ends:
                        if b > at + 1 and b <= m.end() and "." in text[at + 1 : b] and text[b - 1] not in ".-" and ends[b] - starts[a] <= MAX_TOKENS and (b == m.end() or text[b] in ".-"):
                            out.append((starts[a], ends[b], 0))
        at = text.find("@", at + 1, stop)
    for m in SPELLED.finditer(text, first, stop):
        if "@" not in m.group() and m.start() in starts and m.end() in ends and ends[m.end()] - starts[m.start()] <= MAX_TOKENS:
            if re.search(r"[\[({]at[\])}]|\x20dot\x20|[\[({]dot[\])}]", m.group()):
                out.append((starts[m.start()], ends[m.end()], 0))
    return sorted(set(out))


def tokens_of(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, lo, hi)]


def outside(text: str, lo: int) -> str:
    c = text[lo]
    return "out digit" if "0" <= c <= "9" else "out letter" if c.isalpha() else f"out {c}" if c in "+@().-" else "out else"


# --- the model

OUT = len(KINDS)  # label of a token outside; beside it the labels are the kinds


@dataclass
class SpanModel:
    """Weights of features, and of the label of a segment by the label before it (row ``OUT + 1``: the start)."""

    weights: dict[str, float]
    steps: list[list[float]]

    def lattice(self, text: str, tokens: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> tuple[list[float], list[float]]:
        w = self.weights
        cached: dict[str, float] = {}
        out = [w.get(outside(text, lo), 0.0) for lo, _ in tokens]
        for k, (a, b, kind) in enumerate(spans):
            cached[k] = sum(w.get(f, 0.0) for f in features(text, tokens[a][0], tokens[b - 1][1], kind))
        return out, [cached[k] for k in range(len(spans))]

    def find(self, text: str, lo: int, hi: int) -> list[tuple[int, int, int, float]]:
        """(start, kind, end, posterior) of the best segmentation's entities between ``lo`` and ``hi``."""
        tokens = tokens_of(text, lo, hi)
        spans = candidates(text, tokens) if tokens else []
        if not spans:
            return []
        out, scores = self.lattice(text, tokens, spans)
        alpha, total = forward(len(tokens), spans, out, scores, self.steps)
        beta = backward(len(tokens), spans, out, scores, self.steps)
        best = viterbi(len(tokens), spans, out, scores, self.steps)
        found = []
        for k in best:
            a, b, kind = spans[k]
            into = lse([alpha[a][y] + self.steps[y][kind] for y in range(OUT + 2)])
            found.append((tokens[a][0], kind, tokens[b - 1][1], math.exp(min(0.0, into + scores[k] + beta[b][kind] - total))))
        return found


NEVER = -1e30


def lse(values: list[float]) -> float:
    top = max(values)
    return top if top <= NEVER else top + math.log(sum(math.exp(v - top) for v in values))


def by_end(n: int, spans: list[tuple[int, int, int]]) -> list[list[int]]:
    held: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, b, _) in enumerate(spans):
        held[b].append(k)
    return held


def forward(n, spans, out, scores, steps):
    """Log sums of all segmentations of the first j tokens by last label, and of all."""
    ending = by_end(n, spans)
    alpha = [[NEVER] * (OUT + 2) for _ in range(n + 1)]
    alpha[0][OUT + 1] = 0.0
    into = [[None] * (OUT + 1) for _ in range(n + 1)]

    def enter(j: int, y: int) -> float:
        if into[j][y] is None:
            into[j][y] = lse([alpha[j][x] + steps[x][y] for x in range(OUT + 2)])
        return into[j][y]

    for j in range(1, n + 1):
        alpha[j][OUT] = enter(j - 1, OUT) + out[j - 1]
        by_kind: dict[int, list[float]] = {}
        for k in ending[j]:
            a, _, kind = spans[k]
            by_kind.setdefault(kind, []).append(enter(a, kind) + scores[k])
        for kind, values in by_kind.items():
            alpha[j][kind] = lse(values)
    return alpha, lse(alpha[n])


def backward(n, spans, out, scores, steps):
    """Log sums of all segmentations of the tokens from j on by the label before them."""
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (a, _, _) in enumerate(spans):
        starting[a].append(k)
    beta = [[NEVER] * (OUT + 2) for _ in range(n + 1)]
    beta[n] = [0.0] * (OUT + 2)
    for j in range(n - 1, -1, -1):
        ahead = [(OUT, out[j] + beta[j + 1][OUT])] + [(spans[k][2], scores[k] + beta[spans[k][1]][spans[k][2]]) for k in starting[j]]
        for y in range(OUT + 2):
            beta[j][y] = lse([steps[y][label] + v for label, v in ahead])
    return beta


def viterbi(n, spans, out, scores, steps):
    """Numbers of the spans of the best segmentation, in order."""
    ending = by_end(n, spans)
    best = [[NEVER] * (OUT + 2) for _ in range(n + 1)]
    back: list[list] = [[None] * (OUT + 2) for _ in range(n + 1)]
    best[0][OUT + 1] = 0.0
    for j in range(1, n + 1):
        for label, a, gain, k in [(OUT, j - 1, out[j - 1], -1)] + [(spans[k][2], spans[k][0], scores[k], k) for k in ending[j]]:
            x = max(range(OUT + 2), key=lambda y, a=a, label=label: best[a][y] + steps[y][label])
            value = best[a][x] + steps[x][label] + gain
            if value > best[j][label]:
                best[j][label], back[j][label] = value, (a, x, k)
    j, y, found = n, max(range(OUT + 2), key=lambda y: best[n][y]), []
    while j:
        a, x, k = back[j][y]
        if k >= 0:
            found.append(k)
        j, y = a, x
    return found[::-1]


def fit(cases: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 40, rate: float = 0.3, l2: float = 1e-3) -> SpanModel:
    """Maximum conditional likelihood with an L2 penalty, by Adagrad over (text, its (start, kind, end) spans).

    Cases whose spans are no candidates do not count. Deterministic.
    """
    number: dict[str, int] = {}
    name = lambda f: number.setdefault(f, len(number))
    held = []
    for text, gold in cases:
        tokens = tokens_of(text, 0, len(text))
        spans = candidates(text, tokens) if tokens else []
        place = {(tokens[a][0], kind, tokens[b - 1][1]): k for k, (a, b, kind) in enumerate(spans)}
        if not spans or any(g not in place for g in gold):
            continue
        own = [name(outside(text, lo)) for lo, _ in tokens]
        each = [[name(f) for f in features(text, tokens[a][0], tokens[b - 1][1], kind)] for a, b, kind in spans]
        held.append((len(tokens), spans, own, each, sorted(place[g] for g in gold)))
    size = len(number)
    w, steps = np.zeros(size), np.zeros((OUT + 2, OUT + 1))
    seen = np.full(size + steps.size, 1e-6)
    for _ in range(rounds if held else 0):
        grad, moved = np.zeros(size), np.zeros_like(steps)
        table = steps.tolist()
        for n, spans, own, each, gold in held:
            out, scores = w[own].tolist(), [float(w[f].sum()) for f in each]
            alpha, total = forward(n, spans, out, scores, table)
            beta = backward(n, spans, out, scores, table)
            covered = set()
            last, at = OUT + 1, 0
            for k in gold:
                a, b, kind = spans[k]
                if a > at:
                    moved[last, OUT] += 1
                    moved[OUT, OUT] += a - at - 1
                    last = OUT
                moved[last, kind] += 1
                last, at = kind, b
                covered.update(range(a, b))
                np.add.at(grad, each[k], 1.0)
            if n > at:
                moved[last, OUT] += 1
                moved[OUT, OUT] += n - at - 1
            np.add.at(grad, [own[j] for j in range(n) if j not in covered], 1.0)
            arcs = [(j, j + 1, OUT, out[j], (own[j],)) for j in range(n)] + [(a, b, kind, scores[k], each[k]) for k, (a, b, kind) in enumerate(spans)]
            for a, b, label, gain, fs in arcs:
                rest = gain + beta[b][label] - total
                p_all = 0.0
                for y in range(OUT + 2):
                    if alpha[a][y] > NEVER and (z := alpha[a][y] + table[y][label] + rest) > -30:
                        p = math.exp(min(0.0, z))
                        moved[y, label] -= p
                        p_all += p
                if p_all:
                    for f in fs:
                        grad[f] -= p_all
        g = np.concatenate([grad - l2 * len(held) * w, moved.ravel() - l2 * len(held) * steps.ravel()]) / max(1, len(held))
        seen += g * g
        move = rate * g / np.sqrt(seen)
        w += move[:size]
        steps += move[size:].reshape(steps.shape)
    return SpanModel({f: float(w[i]) for f, i in number.items()}, steps.tolist())


# --- training cases from base spans

def written_anew(kind: int, value: str, rng: random.Random) -> str:
    """The same item in a form that the fixed patterns miss."""
    if kind == 0:
        name, domain = value.split("@", 1)
        at = rng.choice([" at ", "[at]", " [at] ", "(at)", " (at) "])
        dot = rng.choice([" dot ", "[dot]", " [dot] ", "(dot)"]) if at == " at " or rng.random() < 0.5 else "."
        return name.rstrip(".%+-") + at + domain.replace(".", dot)
    digits = digits_of(value)
    if kind == 2:
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3 and len(digits) == 11:
        a, b, c = digits[1:4], digits[4:7], digits[7:]
        return rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"+{digits[0]}.{a}.{b}.{c}", f"+{digits}"])
    return value


def noise(rng: random.Random) -> str:
    """Numbers that are no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    bad = d(15)
    return rng.choice([
        f"2{d(3)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{d(2)}:{d(2)}:{d(2)}", f"v{rng.randint(1, 9)}.{d(2)}.{d(1)}", d(rng.randint(1, 11)), f"{d(3)}.{d(2)}", f"{d(4)}-{d(4)}", f"{d(3)},{d(3)},{d(3)}",
        f'"{"".join(rng.choice("0123456789abcdef") for _ in range(32))}"', f"300.{d(3)}.999.{d(2)}", f"{d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}", f"{d(5)}-{d(6)}-{d(3)}", f"{d(2)} x {d(2)} x {d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"2{d(3)}-{d(4)} {d(4)}",
        next(bad + str(x) for x in range(10) if not luhn(bad + str(x))), f"{d(3)}-{d(2)}-{d(4)}", f"{d(8)}-{d(4)}-{d(4)}-{d(12)}",
    ])


def cases_of(found: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 12, more: int = 1200) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sampled places with their base spans, and ``more`` made of the same values, written anew or run together, and of
    numbers that are none. Values of every kind are made up beside, so that a sample may lack any."""
    rng = random.Random(seed)
    values: list[list[str]] = [[t[lo:hi] for t, spans in found for lo, kind, hi in spans if kind == k] for k in range(len(KINDS))]
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for _ in range(60):
        body = rng.choice("3456") + d(14)
        values[0].append(f"{''.join(rng.choices('abcdefghijklmno', k=rng.randint(2, 9)))}{rng.choice(['', '.' + d(2), '_x'])}@{''.join(rng.choices('abcdefghijklmno', k=6))}.{rng.choice(['com', 'org', 'co.uk', 'de'])}")
        values[1].append(".".join(str(rng.randint(1, 254)) for _ in range(4)))
        values[2].append(next(body + str(x) for x in range(10) if luhn(body + str(x))))
        values[3].append(rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{rng.choice(['44', '49', '33'])} {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}"]))
    words = ["the", "and", "see", "for", "le", "und", "no", "tel", "mail", "ip", "card"]
    out = [c for c in found if len(c[1]) == len({*c[1]}) and not any(a[2] > b[0] for a, b in zip(c[1], c[1][1:]))]
    for _ in range(more):
        text, gold = (rng.choice(words) + rng.choice([" ", ": ", " "])) if rng.random() < 0.7 else "", []
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            kind = rng.randrange(len(KINDS) + 2)
            if kind >= len(KINDS):
                part = noise(rng)
            else:
                part = rng.choice(values[kind])
                if kind == 2 and rng.random() < 0.3:
                    g = rng.choice(" -")
                    part = g.join(digits_of(part)[i : i + 4] for i in range(0, len(digits_of(part)), 4))
                elif rng.random() < 0.4:
                    part = written_anew(kind, part, rng)
                gold.append((len(text), kind, len(text) + len(part)))
            text += part + rng.choice([" ", " ", " ", ", ", " / "] if kind != 0 else [" ", ", "])
        out.append((text + rng.choice(words + ["", ""]), gold))
    return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> SpanModel:
    """The model from the places of at most ``sample_rows`` documents. Ids are broadcast (8 bytes a sampled row);
    what comes to the driver is bounded by :data:`SAMPLE_PLACES` and :data:`PLACE_CHARS` a row."""
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    marked = docs.filter("doc_id is not null").filter(F.col("text").rlike("[0-9@]"))
    sample = marked.groupBy("doc_id").agg(F.lit(1).alias("one")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spots = [(hashlib.md5(text[lo:hi].encode("utf-8", "surrogatepass")).hexdigest(), text[lo:hi]) for lo, hi in places(text) if hi - lo <= PLACE_CHARS]
                rows += [(i, h, t) for h, t in sorted(set(spots))[:SAMPLE_PLACES]]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "hash", "place"])

    picked = docs.join(F.broadcast(sample), "doc_id").mapInArrow(run, "doc_id long, hash string, place string").distinct()
    got = sorted((r[0], r[1]) for r in picked.groupBy("hash").agg(F.min("place")).orderBy("hash").limit(sample_rows * SAMPLE_PLACES).collect())
    return fit(cases_of([(t, base_spans(t)) for _, t in got]))


def spans_of(text: str, model: SpanModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the model's that meet none of them."""
    base = base_spans(text)
    added = []
    for lo, hi in places(text):
        for s, kind, e, p in model.find(text, lo, hi):
            if p >= CONFIDENCE and not any(s < b and a < e for a, _, b in base):
                added.append((s, kind, e))
    return base, added


def find_personal_data(df: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, added>>), one row per document.

    Offsets are code points, ends exclusive. ``added`` spans are the model's,
    they overlap no base span. Null and empty texts have none; repeated rows
    are searched each; an empty table gives no rows.
    """
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.steps))
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("pii")
        held = SpanModel(*shared.value)
        for batch in batches:
            for piece in text_slices(batch, 1):
                rows = []
                for t in piece.column(1).to_pylist():
                    base, added = spans_of(t or "", held)
                    every = sorted([(s, k, e, False) for s, k, e in base] + [(s, k, e, True) for s, k, e in added])
                    rows.append([{"kind": KINDS[k], "start": s, "end": e, "added": x} for s, k, e, x in every])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "spans"])

    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,added:boolean>>")


def personal_data_digest(df: DataFrame, model: SpanModel, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), of :func:`find_personal_data`."""
    found = find_personal_data(df, model, **how)
    base = F.filter("spans", lambda x: ~x["added"])
    count = lambda k: F.size(F.filter("spans", lambda x: ~x["added"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
