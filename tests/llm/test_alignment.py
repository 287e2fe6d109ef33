"""Alignment of two tokenizers against whole texts, occurrence by occurrence."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from test_llm_operators import ROWS, docs, none, odd  # noqa: F401

from folioforge.llm import alignment
from folioforge.llm.queries import tokenizer_file

FILES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = [
    "a  b", " a", "a ", "\n", "a\nb", " \n b\n\n c \n", "ﬁ é é", "a▁b", "\x00a", "<s> </s> <|endoftext|> <0x41>", "  ", " ", "  x y", "日本語 テキスト", "x\x1c y\x85 z　 w", "don't 'll I'm",
    "\t a\tb \t", "🙂 🙂🙂", "​z ﻿ q", "a\r\nb\r\n", "...!! ??", "123 4567,89", "ÅÄÖ ß", " l m n",
]


def brute(rows):
    e = alignment.Encoders(*FILES)
    held, counts = [], Counter()
    for i, t in rows:
        raw = (" " + (t or "")).encode()
        a, b = e.first.encode(" " + t, add_special_tokens=False).ids if t else [], e.second.encode(t) if t else []
        if not t or b"".join(e.first_bytes[x] for x in a) != raw or b"".join(e.second_bytes[x] for x in b) != raw:
            held.append((i, [], [], [], []))
            continue
        span = lambda ids, of: [(x, sum(len(of[y]) for y in ids[:k]), sum(len(of[y]) for y in ids[: k + 1])) for k, x in enumerate(ids)] if len(ids) < 60 else spans(ids, of)
        sa, sb = span(a, e.first_bytes), span(b, e.second_bytes)
        links, lo = [], 0
        for x, s, u in sa:
            while lo < len(sb) and sb[lo][2] <= s:
                lo += 1
            k = lo
            while k < len(sb) and sb[k][1] < u:
                links.append((x, sb[k][0]))
                k += 1
        both = sorted({u for *_, u in sa} & {u for *_, u in sb})
        groups, ka, kb = [], 0, 0
        for u in both:
            na, nb = next(k for k in range(ka, len(sa)) if sa[k][2] == u) + 1, next(k for k in range(kb, len(sb)) if sb[k][2] == u) + 1
            groups.append(",".join(map(str, a[ka:na])) + "|" + ",".join(map(str, b[kb:nb])))
            ka, kb = na, nb
        counts.update(links)
        held.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return Counter(
        (i, len(a), len(b), len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for i, a, b, g, ls in held
    ), {(x, y): (n, n == most[y]) for (x, y), n in counts.items()}


def spans(ids, of):
    out, at = [], 0
    for x in ids:
        out.append((x, at, at + len(of[x])))
        at += len(of[x])
    return out


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    strange = " \n\t\r\x0b\x1c\x85   　​'.,-ab12é日🙂▁<>|s"
    mixed = ["".join(rng.choices(strange, k=rng.randint(1, 40))) for _ in range(600)]
    return ROWS + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000 + i, t) for i, t in enumerate(mixed)]


def test_alignment(spark, rows, odd, none):  # noqa: F811
    exp, pairs = brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert bag(alignment.alignment_digest(frame, *FILES)) == exp
    assert bag(alignment.alignment_digest(frame, *FILES, chunk_chars=300)) == exp
    got = {(r.a, r.b): (r.links, r.best) for r in alignment.token_pairs(frame, *FILES).collect()}
    assert got == pairs
    assert bag(alignment.alignment_digest(odd, *FILES)) == brute(ROWS)[0]
    assert alignment.alignment_digest(none, *FILES).count() == 0


def test_whole_texts_where_no_cut_is_proven(spark, rows, monkeypatch):
    few = rows[:60] + rows[-50:]
    e = alignment.Encoders(*FILES)
    assert e.cuts == " \n" and all("".join(e.segments(t)) == " " + t for _, t in rows if t and "▁" not in t)
    e.cuts, e.find = "", None
    for _, t in few:
        if t:
            one, two = e.encode(e.segments(t))
            found = alignment.Aligned([" " + t], e)
            assert found.stats[0][0] == len(one[0]) and (bool(one[0]) == ("▁" not in t))


def test_cuts_ask_for_proof():
    import json

    from sentencepiece import sentencepiece_model_pb2 as pb

    e = alignment.Encoders(*FILES)
    first, proto = json.loads(e.first.to_str()), e.second.serialized_model_proto()
    assert alignment.cuts_of(first | {"normalizer": {"type": "NFC"}}, proto) == ""
    assert alignment.cuts_of(first | {"pre_tokenizer": {"type": "Whitespace"}}, proto) == ""
    model = pb.ModelProto.FromString(proto)
    model.pieces[500].piece = "a▁b"
    assert alignment.cuts_of(first, model.SerializeToString()) == ""
    model.pieces[500].piece = "a\nb"
    assert alignment.cuts_of(first, model.SerializeToString()) == " "
    model.normalizer_spec.remove_extra_whitespaces = True
    assert alignment.cuts_of(first, model.SerializeToString()) == ""
