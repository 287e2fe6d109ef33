"""The training-data operators against brute force, on edge cases and on small made-up texts."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioforge.llm import chat, components, decontamination, fingerprints, jaccard, lines, lm_scoring, packing, sharding, substrings, toxicity
from folioforge.llm.queries import tokenizer_file

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def made_up() -> list[tuple]:
    """Nulls, empty, blank and very long texts, ties, repeated rows, copies, near copies and shared passages."""
    passage, base = prose(60), prose(120)
    rows = [(None, None), (None, "a null id"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (4, "x"), (5, "X"), (6, "é Ünïcode 日本 'll .."), (7, prose(20_000))]
    rows += [(10 + i, prose(30) + "\n" + passage + "\n" + prose(30)) for i in range(6)]
    rows += [(20 + i, base) for i in range(4)]
    for i in range(12):
        w = base.split()
        w[RNG.randrange(len(w))] = f"changed{i}"
        rows.append((30 + i, " ".join(w)))
    rows += [(50 + i, prose(RNG.randint(1, 80)) + "\n" + prose(40)) for i in range(20)]
    rows += [(80, base + " " + prose(10) + " " + base), rows[-1]]
    return rows


ROWS = made_up()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns that clash with the operators' own names, or with each other but for case."""
    rows = [(i, t, 1, "a", None, "b", 2) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int, Text string, u long, ids string, slot int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def bag(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def words(text) -> list[bytes]:
    return (text or "").encode().split()


class Union:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, a):
        while self.p[a] != a:
            self.p[a] = self.p[self.p[a]]
            a = self.p[a]
        return a

    def join(self, a, b):
        self.p[self.find(a)] = self.find(b)


# --- sharding


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_loop():
    keys = np.array([0, 1, 2**63, 2**64 - 1, *(RNG.getrandbits(64) for _ in range(500))], np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_sharding(docs, odd, none):
    got = sharding.shard_digest(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert bag(sharding.shard_digest(odd).drop("slot")) == bag(sharding.shard_digest(docs).drop("slot"))
    assert sharding.shard_digest(none).count() == 0


# --- packing


def test_packing(docs, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    got = packing.packing_digest(docs, tokenizer_file(), length=128).collect()
    exp = Counter(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in ROWS)
    pieces = sorted((r.sequence_id, r.offset, r) for r in packing.pack(docs, tokenizer_file(), length=128).collect())
    seen, held, at = Counter(), [], 0
    for s, o, r in pieces:
        assert s * 128 + o == at
        at += r.length
        ids = np.frombuffer(bytes(r.piece), "<u4").tolist()
        assert r.start == len(held) and len(ids) == r.length
        held += ids
        if len(held) == r.doc_tokens:
            seen[tuple(held)] += 1
            held = []
    assert seen == exp and not held
    assert Counter((r.sequence_id, r.offset, r.ids_crc32) for r in got) == Counter((s, o, zlib.crc32(bytes(r.piece))) for s, o, r in pieces)
    assert packing.packing_digest(none, tokenizer_file()).count() == 0
    assert packing.packing_digest(odd, tokenizer_file()).count() > 0


def test_chunks_equal_whole_texts():
    enc = packing.ChunkEncoder(tokenizer_file())
    odd = ["it's", "I'm.", "..", "µm", "ªº", "Ærø", "ß", "İx", "ﬁn", "éa", "a b.", "a\x1cb", "<|endoftext|>", "don't,", "3.14", "ÀÉ!?", "日本.", "\x85z", "Å", "re'", "x'll."]
    for t in [*odd, " ".join(odd), "\n".join(odd), prose(300).title()]:
        assert enc.encode([t])[0] == np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# --- decontamination


def test_decontamination(spark, docs, odd, none):
    items = [(1, ROWS[10][1][40:400]), (2, "x"), (3, None), (4, ""), (11, "Null, ID"), (None, prose(12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = bag(decontamination.decontamination_digest(docs, bench))
    norm = decontamination.words_of
    wins = defaultdict(set)
    for i, t in items:
        for w in decontamination.windows_of(norm(t), 10):
            wins[tuple(w.split())].add("" if i is None else str(i))
    exp = Counter()
    for d, t in ROWS:
        w, hit, ids = norm(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    ids |= wins[tuple(w[i : i + k])]
        exp[(d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    assert got == exp and any(k[5] for k in got)
    assert bag(decontamination.decontamination_digest(odd, bench)) == exp
    assert decontamination.decontamination_digest(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.decontamination_digest(docs, bench.limit(0)).collect())


def test_hits_map_back_to_the_original():
    text = "Né À-la “Carte”: one, TWO; three"
    assert [text[a:b] for a, b in decontamination.char_spans(text, [(2, 3), (4, 5), (6, 7)])] == ["la", "one", "three"]
    w = decontamination.words_of(text)
    spans = decontamination.char_spans(text, [(i, i + 1) for i in range(len(w))])
    assert [decontamination.words_of(text[a:b]) for a, b in spans] == [[x] for x in w]


# --- substrings


def test_substring_dedup(docs, odd, none):
    got, size = bag(substrings.substring_digest(docs)), 35
    seen = Counter(tuple(w[i : i + size]) for w in (words(t) for _, t in ROWS) for i in range(len(w) - size + 1))
    exp = Counter()
    for d, t in ROWS:
        w = words(t)
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        exp[(d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())] += 1
    assert got == exp and sum(k[2] for k in got) > 200
    assert bag(substrings.substring_digest(odd)) == exp
    assert substrings.substring_digest(none).count() == 0
    assert bag(substrings.remove_repeats(docs, window=5, k=3, filter_bytes=64).select("doc_id", "n_words")) == Counter((d, len(words(t))) for d, t in ROWS)


def test_factors_are_greedy():
    """Matches that go on at one reference are one factor; then the furthest is taken, others within it are not."""
    rows = [(9, 1, 5, 0, 4), (9, 1, 6, 1, 4), (9, 1, 7, 2, 4), (9, 2, 8, 2, 4), (9, 3, 6, 6, 4), (9, 1, 20, 9, 4), (8, 2, 8, 0, 4)]
    matches = np.array(rows, substrings.FACTOR)
    got = {u: f.tolist() for u, f in substrings.parse(matches)}
    assert got == {9: [[5, 6, 1, 0], [8, 4, 2, 2], [20, 4, 1, 9]], 8: [[8, 4, 2, 0]]}


def test_block_factors_against_all_pairs_of_places():
    """Places of one anchor: each window over it that stands at another place lies in a factor, no other does."""
    window, k, rng = 7, 3, np.random.default_rng(5)
    texts = [rng.integers(1, 3, 40).astype(np.uint64) for _ in range(12)]
    r = []
    for u, h in enumerate(texts):
        at = np.array([i for i in range(38) if (h[i : i + 3] == [1, 2, 1]).all()], np.int64)
        r.append(substrings.places(u, h, at, np.full(len(at), 77, np.uint64), window - k, window, k))
    r = np.concatenate(r)
    seen = Counter(tuple(h[i : i + window].tolist()) for h in texts for i in range(40 - window + 1))
    for found in (substrings.factors_in_block(r, window, k), np.concatenate([substrings.settle(r, window, k)[0], substrings.factors_in_block(substrings.settle(r, window, k)[1], window, k)])):
        got = {(int(f["u"]), int(p)) for f in found for p in range(f["p"], f["p"] + f["n"] - window + 1)}
        exp = {(int(x["u"]), int(p)) for x in r for p in range(max(0, int(x["p"]) - window + k), int(x["p"]) + 1) if p + window <= 40 and seen[tuple(texts[int(x["u"])][p : p + window].tolist())] > 1}
        assert exp <= got and got
        for f in found:
            a, b = texts[int(f["u"])], texts[int(f["ru"])]
            assert f["n"] >= window and (f["u"], f["p"]) != (f["ru"], f["rp"]) and (a[f["p"] : f["p"] + f["n"]] == b[f["rp"] : f["rp"] + f["n"]]).all()


def test_frequent_anchors_are_dealt_out(docs):
    assert bag(substrings.substring_digest(docs, hot=2)) == bag(substrings.substring_digest(docs))


# --- language model


def test_lm_scoring(docs, odd, none):
    low = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    seen = Counter(w for d, t in ROWS if not held(d) for w in low(t))
    n, v = sum(seen.values()), len(seen)
    got = sorted(lm_scoring.score_documents(docs).collect(), key=str)
    exp = sorted(((d, held(d), len(low(t)), sum(seen[w] > 0 for w in low(t)), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in low(t))) for d, t in ROWS), key=str)
    assert Counter(tuple(r)[:5] for r in got) == Counter(e[:5] for e in exp)
    assert sum(r.base_score for r in got) == pytest.approx(sum(e[5] for e in exp))
    assert all(r.score <= 0 for r in got)
    parts = lm_scoring.score_documents(docs, max_filter_bytes=2000)
    assert sorted(round(r.score, 6) for r in parts.collect()) == sorted(round(r.score, 6) for r in got)
    assert lm_scoring.score_documents(odd).count() == len(ROWS)
    assert lm_scoring.score_documents(none).count() == 0


def test_filter_never_counts_too_low():
    h = np.array([RNG.getrandbits(64) for _ in range(3000)], np.uint64)
    c = np.array([RNG.choice([1, 2, 3, 9, 500]) for _ in h])
    f = lm_scoring.Filter.of(4, [(i, lm_scoring.Filter.segment(h[(h >> np.uint64(60)) == i], c[(h >> np.uint64(60)) == i], 10)) for i in range(16)])
    q = lm_scoring.LEVEL_COUNT[lm_scoring.levels(c)]
    assert (f.counts(h) >= q).all() and (f.counts(h) == q).mean() > 0.95


# --- Jaccard join


def brute_components(rows, size, num):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    u = Union(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= num * (len(a) + len(sets[j]) - both):
                u.join(i, j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[u.find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return Counter((d, len(sets[i]), least[u.find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "num", "cell", "many"), [(3, 90, 4_000_000, 64), (5, 80, 4_000_000, 64), (3, 90, 900, 64), (3, 90, 1500, 64), (3, 90, 4_000_000, 2), (5, 80, 4_000_000, 3)])
def test_jaccard_components(docs, size, num, cell, many):
    rule = jaccard.Rule(size=size, num=num, cell_shingles=cell, rounds=int(cell < 1000), many=many)
    assert bag(jaccard.join_components(docs, rule=rule)) == brute_components(ROWS, size, num)


def test_jaccard_edges(odd, none, docs):
    assert bag(jaccard.join_components(odd)) == brute_components(ROWS, 3, 90)
    assert jaccard.join_components(none).count() == 0
    kept = jaccard.keep_one(docs, rule=jaccard.Rule(size=5, num=80)).collect()
    groups = brute_components(ROWS, 5, 80)
    assert len([r for r in kept if r.text and r.text.split()]) == len({(k[2] if k[2] is not None else "none") for k in groups if k[1]})


def test_signatures_meet_for_every_linked_pair():
    rule, starts = jaccard.Rule(num=80), jaccard.classes(jaccard.Rule(num=80))
    for n in [*range(1, 60), 150, 900]:
        a = np.array(sorted(RNG.getrandbits(64) for _ in range(n)), np.uint64)
        for cut in range(0, n // 5 + 1):
            b = a[cut:]
            c = np.sort(np.concatenate([a[cut:], np.array([RNG.getrandbits(64) for _ in range(cut // 2)], np.uint64)]))
            for x in (b, c):
                both = len(set(a.tolist()) & set(x.tolist()))
                if rule.linked(both, len(a), len(x)):
                    keys = lambda s: np.concatenate([k for k, _ in jaccard.signatures(s, starts, rule)])
                    assert np.intersect1d(keys(a), keys(x)).size


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (9, 9), (None, 7), (12, 11), (11, 10), (10, 3), (20, 21), (20, 21), *((100 + i, 101 + i) for i in range(40))]
    got = bag(components.connected(spark.createDataFrame(pairs, "a long, b long")))
    exp = [(1, 1), (2, 1), (3, 1), (10, 1), (11, 1), (12, 1), (4, 4), (5, 4), (20, 20), (21, 20), *((100 + i, 100) for i in range(41))]
    assert got == Counter(exp)
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- line dedup


def test_line_dedup(spark):
    line, other = prose(25), prose(25)
    near = line.replace(line.split()[3], "zzz", 1)
    rows = [(3, f"{other}\n{line}\n\n"), (1, f"{near}\nshort"), (2, f"{line}\n{prose(9)}\nshort\n"), (4, None), (5, ""), (6, "\n\n"), (7, prose(20_000)), (None, other), (8, "short"), (8, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert got[1].text == rows[1][1] and got[1].n_removed == 0  # the component's first line
    assert got[2].text == rows[2][1].split("\n")[1] + "\n" and got[2].n_removed == 2
    assert got[3].text == f"{other}\n\n" and got[3].n_lines == 4
    assert got[4].text == got[5].text == "" and got[6].text == "\n\n" and got[None].text == "" and got[8].text == ""
    assert got[7].n_removed == 0
    assert lines.dedup_lines(df.limit(0)).count() == 0
    more = df.selectExpr("doc_id", "text", "1 AS pos", "'q' AS Line", "2 AS code")
    assert bag(lines.dedup_lines(more)) == bag(lines.dedup_lines(df))
    assert "code" in lines.dedup_lines(more, carry=("code",)).columns


def test_line_dedup_recall(spark):
    """Nearly equal lines against brute force over all pairs."""
    text = []
    for _ in range(60):
        line = prose(30)
        text.append(line)
        for _ in range(3):
            w = line.split()
            for _ in range(RNG.randint(1, 3)):
                w[RNG.randrange(len(w))] = prose(1)
            text.append(" ".join(w))
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in text]
    u = Union(len(text))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                u.join(i, j)
    exact = len(text) - len({u.find(i) for i in range(len(text))})
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    assert 0.97 * exact <= sum(r.n_removed for r in lines.dedup_lines(df).collect()) <= exact


# --- fingerprints


def test_fingerprints(docs, odd, none, spark):
    got = fingerprints.fingerprint_documents(docs).collect()
    order = sorted(((d, t or "") for d, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    exp = Counter()
    for i, (d, t) in enumerate(order):
        follow, h = order[(i + 1) % len(order)][1], len(t) // 2
        exp[(d, len(t), hashlib.sha256((t[: len(t) - h] + follow[:h]).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:3] for r in got) == exp
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    copies = {r.fingerprint for r in got if r.doc_id in (20, 21, 22, 23)}
    assert len(copies) == 1 and all(r.near_next == 1 for r in got if r.doc_id in (20, 21, 22))
    assert bag(fingerprints.fingerprint_documents(odd)) == Counter(tuple(r) for r in got)
    assert fingerprints.fingerprint_documents(none).count() == 0
    (one,) = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


# --- toxicity


def test_toxicity(spark, none):
    bad = ["vile", "foul", "nasty"]
    rows, marks = [], []
    for i in range(400):
        w = prose(30).split()
        t = int(i % 8 == 0)
        w += RNG.sample(bad, RNG.choice([1, 3])) if t else []
        RNG.shuffle(w)
        rows.append((i, " ".join(w)))
        marks.append((i, t))
    df = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "vile foul nasty")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks[:300], (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    assert len(got) == 403 and (np.diff(model.thresholds) > 0).all()
    wrong = [i for i, t in marks[300:] if got[i].rejected != bool(t)]
    assert len(wrong) <= 2
    assert got[None].rejected and not got[500].rejected and not got[501].rejected
    assert got[None].severity > got[500].severity
    kept = {r.doc_id for r in toxicity.reject_toxic(df, model).collect()}
    assert kept == {i for i, r in got.items() if not r.rejected}
    assert toxicity.score_documents(none, model).count() == 0
    empty = toxicity.train(none, labels)
    assert not any(r.rejected for r in toxicity.score_documents(df, empty).collect())


# --- chat


def test_chat_round_trip(spark):
    control = "</s>[INST] ok [/INST] <|turn|>user<|text|> & &amp; &lt; &lsqb; \\ \n</s>\n"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (1, 1, "assistant", control), (2, 0, None, None), (2, 1, "assis<|text|>tant\n", "é日"), (None, 5, "assistant", ""), (3, None, "system", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((t if t is not None else -1), r or "", x or "") for i, t, r, x in rows if i == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digest(df.limit(0)).count() == 0
    more = df.selectExpr("*", "1 AS place", "2 AS v", "3 AS ROLE2", "'z' AS record")
    assert bag(chat.chat_digest(more)) == bag(chat.chat_digest(df))


def test_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', '{"completion":"yo","prompt":"hi"}', '{"instruction":"hi","input":"","output":"yo"}',
        '{"instruction":"hi","output":"yo"}', '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}', '{"unknown":1}', "no json", None,
    ]
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(records)], "conv_id long, turn int, record string")
    got = defaultdict(list)
    for r in chat.canonical_turns(df).orderBy("conv_id", "place").collect():
        got[r.conv_id].append((r.role, r.text))
    assert all(got[i] == [("user", "hi"), ("assistant", "yo")] for i in range(5))
    assert all(got[i] == [(None, None)] for i in (5, 6, 7))


def test_layouts_with_other_fields(spark):
    """Other fields at any depth, empty lists, and records that no layout knows."""
    records = [
        '{"id":7,"prompt":"hi","response":"yo","meta":{"a":{"b":[1,{"c":2}]}}}', '{"messages":[{"role":"user","content":"hi","meta":{"x":{"y":1}}},{"role":"assistant","content":"yo"}],"n":[[1]]}', '{"messages":[]}',
        '{"a-b c":1,"completion":"yo","prompt":"hi"}',
    ]
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(records)], "conv_id long, turn int, record string")
    got = defaultdict(list)
    for r in chat.canonical_turns(df).orderBy("conv_id", "place").collect():
        got[r.conv_id].append((r.role, r.text))
    assert {i: got[i] for i in got} == {i: [("user", "hi"), ("assistant", "yo")] for i in (0, 1, 3)}
    assert chat.format_turns(chat.canonical_turns(df)).count() == 3
    bad = spark.createDataFrame([(1, 0, '{"unknown":1}')], "conv_id long, turn int, record string")
    with pytest.raises(Exception, match="no known layout"):
        chat.format_turns(chat.canonical_turns(bad)).collect()
    with pytest.raises(ValueError, match="no layout"):
        chat.turns_of_columns(bad, "conv_id", "turn", {"record": "record"})
    pairs = spark.createDataFrame([(1, 0, "hi", "yo")], "conv_id long, turn int, prompt string, completion string")
    rows = chat.turns_of_columns(pairs, "conv_id", "turn", {"prompt": "prompt", "completion": "completion"}).orderBy("place").collect()
    assert [(r.role, r.text) for r in rows] == [("user", "hi"), ("assistant", "yo")]


def test_lm_score_against_counts(docs):
    """The model's log10 probability from exact bigram counts at the filter's levels; a roomy filter has no false alarms."""
    low = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    train = [low(t) for d, t in ROWS if not held(d)]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip([b"<s>", *t[:-1]], t))
    n, v, texts, prior = sum(one.values()), len(one), one[None], 200.0

    def score(t):
        out = 0.0
        for a, b in zip([b"<s>", *t[:-1]], t):
            context = texts if a == b"<s>" else one[a]
            c = two[(a, b)]
            level = 0.0 if not c else float(lm_scoring.LEVEL_COUNT[c.bit_length()])
            out += math.log10((min(level, context) + prior * (one[b] + 1) / (n + v + 1)) / (context + prior))
        return out

    got = Counter((r.doc_id, r.n_tokens, round(r.score, 5)) for r in lm_scoring.score_documents(docs, bits_per_entry=128).collect())
    assert got == Counter((d, len(low(t)), round(score(low(t)), 5)) for d, t in ROWS)


def test_fingerprints_against_terms(spark):
    """Parts, likeness and lexicon against plain sets."""
    rows = [(i, prose(RNG.randint(5, 60))) for i in range(80)] + [(80, None), (81, ""), (82, ". , !")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    split = lambda t: set("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    seen = Counter(w for _, t in rows for w in split(t))
    lex = {r.term: r.parts for r in fingerprints.lexicon(df.fillna("", ["text"]), 0.01, 0.5).collect() if r.term}
    assert set(lex) == {w for w, c in seen.items() if max(2, 0.01 * len(rows)) <= c <= 0.5 * len(rows)}
    parts = lambda t: {(j, tuple(sorted(w for w in split(t) if j in lex.get(w, [])))) for j in {j for w in split(t) for j in lex.get(w, [])}} or {(-1, t or "")}

    def near(a, b):
        return len(a & b) / len({j for j, _ in a | b})

    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df, low=0.01, high=0.5).collect()}
    prints, full = {}, [t or "" for _, t in rows]
    for i, t in enumerate(full):
        follow, h = full[(i + 1) % len(full)], len(t) // 2
        own, changed = parts(t), parts(t[: len(t) - h] + follow[:h])
        assert got[i].near_edited == pytest.approx(near(own, changed)) and got[i].near_next == pytest.approx(near(own, parts(follow)))
        prints.setdefault(frozenset(own), set()).add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints)


def test_edits_stay_nearer_than_other_texts(spark):
    out = fingerprints.fingerprint_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).agg({"near_edited": "avg", "near_next": "avg"}).first()
    assert out["avg(near_edited)"] > 0.15 and out["avg(near_next)"] < 0.05


def test_voronoi_regions_hold_every_link():
    """Regions of pivots share each linked pair, and cutting by them gives the components of brute force."""
    rng = np.random.default_rng(3)
    for rule in (jaccard.Rule(), jaccard.Rule(num=80)):
        sets = []
        for _ in range(30):
            base = rng.integers(0, 2**63, rng.integers(20, 60)).astype(np.uint64)
            for _ in range(rng.integers(1, 12)):
                s = base.copy()
                s[rng.integers(0, len(s), rng.integers(0, len(s) // 6 + 1))] = rng.integers(0, 2**63)
                sets.append(np.unique(s))
        cell = jaccard.Cell(sets, rule)
        linked = [(i, j) for i in range(len(sets)) for j in range(i) if rule.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
        parts = [set(p.tolist()) for p in cell.voronoi(np.arange(len(sets)))]
        assert len(parts) > 2 and all(any(i in p and j in p for p in parts) for i, j in linked)
        exact, found = Union(len(sets)), Union(len(sets))
        for a, b in linked:
            exact.join(a, b)
        cell = jaccard.Cell(sets, rule)
        for a, b in cell.links():
            found.join(a, b)
        same = lambda u: sorted(sorted(i for i in range(len(sets)) if u.find(i) == r) for r in {u.find(i) for i in range(len(sets))})
        assert same(exact) == same(found) and cell.cuts > 0


def test_other_tokenizers_are_taken_whole(spark):
    """A byte-level file keeps white space and case: chunk by chunk would give other ids."""
    path = tokenizer_file("byte_bpe_50k.json")
    enc = packing.ChunkEncoder(path)
    assert not enc.chunked and packing.ChunkEncoder(tokenizer_file()).chunked
    texts = ["Two  Words\n here", "", prose(30)]
    assert enc.encode(texts) == [np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_toxicity_on_held_out_documents(spark):
    """Fitted on half of the labelled documents, judged on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = "pmod(xxhash64(doc_id), 2)"
    model = toxicity.train(docs, labels.filter(f"{half} = 0"))
    got = toxicity.score_documents(docs, model).join(labels.filter(f"{half} = 1").dropDuplicates(["doc_id"]), "doc_id").groupBy("toxic").agg({"rejected": "count_if", "*": "count"}).collect()
    rate = {r["toxic"]: r["count_if(rejected)"] / r["count(1)"] for r in got}
    assert rate[1] >= 0.85 and rate[0] <= 0.01


def test_toxicity_edges(spark):
    rows = [(1, "vile foul"), (1, "vile foul"), (2, "vile " * 200_000), (None, None), (3, "")]
    df = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], "doc_id long, text string, severity int, Text string, p_toxic double")
    model = toxicity.OrdinalModel(np.zeros(toxicity.FEATURES), np.array([1.0, 2.0]))
    got = toxicity.score_documents(df, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and len({r.severity for r in got}) == 1
    assert toxicity.reject_toxic(df, model, cut=0.9).columns == df.columns and toxicity.reject_toxic(df, model, cut=0.9).count() == len(rows)


def test_rarest_regions_keep_every_link():
    """Linked texts keep a region in common whatever else is frequent; with a task's large regions settled or not."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words, 60))
    texts = []
    for _ in range(60):
        own = list(rng.choice(words, rng.integers(5, 120)))
        for _ in range(rng.integers(1, 4)):
            w = own.copy()
            for i in rng.integers(0, len(w), rng.integers(0, max(1, len(w) // 25) + 1)):
                w[i] = str(rng.choice(words))
            texts.append(" ".join(w) + (" " + passage if rng.random() < 0.6 else ""))
    us = np.arange(1, len(texts) + 1, dtype=np.uint64)
    for rule in (jaccard.Rule(size=5, num=80), jaccard.Rule(), jaccard.Rule(size=5, num=80, many=5)):
        sets = [rule.sets(t) for t in texts]
        edges, sent = [], []
        for half in (slice(0, None, 2), slice(1, None, 2)):
            pairs, rest = rule.settle([rule.records(texts[half], us[half])[1]])
            edges.append(pairs)
            sent.append(rest)
        pairs, shared = rule.shared(sent)
        edges += [pairs, rule.edges([shared])]
        of = defaultdict(set)
        for u, region in np.concatenate(edges).tolist():
            of[u].add(region)
        linked = [(i, j) for i in range(len(texts)) for j in range(i) if rule.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
        assert len(linked) > 20 and all(of[i + 1] & of[j + 1] for i, j in linked)


def test_rows_with_clashing_names_stay_whole(odd, spark):
    """Operators that return their input's rows, on columns that differ by case alone."""
    bench = spark.createDataFrame([(1, ROWS[10][1][40:400])], "item_id long, text string")
    clean = decontamination.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and 0 < len(clean.collect()) < len(ROWS)
    model = toxicity.OrdinalModel(np.zeros(toxicity.FEATURES), np.array([1.0, 2.0]))
    assert len(toxicity.reject_toxic(odd, model, cut=0.9).collect()) == len(ROWS)
    sharded = sharding.with_shard(odd, shards=5)
    assert sorted(sharded.columns) == sorted(odd.columns) and {r["shard"] for r in sharded.collect()} <= set(range(5))
