"""Registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from folioforge.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    exp = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(exp.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(str).values.tolist()))
    assert rows(got) == rows(exp)


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        n = docs.count()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= n
    assert docs.agg({"sequence_id": "max"}).first()[0] >= 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's rows on a small corpus against a plain version of its rule; run() gives the last stage's rows."""
    import random

    import numpy as np
    from test_llm_operators import Union, prose
    from tokenizers import Tokenizer

    from folioforge.llm import decontamination, toxicity
    from folioforge.llm.queries import tokenizer_file

    rng = random.Random(3)
    bad = ["vile", "foul", "nasty"]
    bench = [(i, prose(25)) for i in range(5)]
    shared = [prose(12) for _ in range(6)]
    rows, marks = [], []
    for i in range(240):
        lines = [prose(rng.randint(6, 30)) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            lines.append(rng.choice(shared))
        if i % 6 == 1:
            w = rng.choice(shared).split()
            w[rng.randrange(len(w))] += "x"
            lines.append(" ".join(w))
        if i % 10 == 3:
            lines[0] += " " + " ".join(rng.sample(bad, rng.choice([1, 3])))
        if i % 30 == 7:
            lines.append("see " + bench[i % 5][1] + f" {i}")
        if i % 12 == 5 and i > 20:
            lines = [rows[i - 9][1].replace("\n", " ")]  # the same words on one line
        rows.append((i, "\n".join(lines)))
        marks.append((i, 1, int(i % 10 == 3)))
    rows += [(300, ""), (301, None), (302, " \n ")]
    made = {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame(bench, "item_id long, text string"),
    }
    for n, df in made.items():
        df.write.parquet(f"{tmp_path}/{n}.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/out-{k}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append(docs.collect())
    texts = dict(rows)

    model = toxicity.train(made["documents"], made["labels"])
    texts = {i: t for i, t in texts.items() if 1 / (1 + np.exp(model.thresholds[0] - model.weights.astype(np.float32)[toxicity.features(t)].sum())) < 0.25}
    assert sorted(r.doc_id for r in seen[0]) == sorted(texts) and len(texts) < len(rows)

    each = [(i, p, x) for i in sorted(texts) for p, x in enumerate((texts[i] or "").split("\n")) if x.strip()]
    sets = [{x[a : a + 5] for a in range(len(x) - 4)} if len(x) > 5 else {x} for _, _, x in each]
    u, first, gone = Union(len(each)), {}, set()
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                u.join(i, j)
    for i, (d, p, _) in enumerate(each):
        if first.setdefault(u.find(i), i) != i:
            gone.add((d, p))
    texts = {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if (i, p) not in gone) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in seen[1]} == texts and gone and all(r.n_chars == len(r.text) for r in seen[1])

    ids = sorted(texts)
    words = {i: texts[i].lower().split() for i in ids}
    sets = [{tuple(words[i][a : a + 5]) for a in range(max(1, len(words[i]) - 4))} if words[i] else set() for i in ids]
    u = Union(len(ids))
    for i, a in enumerate(sets):
        for j in range(i):
            if a & sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                u.join(i, j)
    kept, heads = [], set()
    for i, d in enumerate(ids):
        if not sets[i] or u.find(i) not in heads:
            kept.append(d)
            heads.add(u.find(i) if sets[i] else None)
    assert sorted(r.doc_id for r in seen[2]) == kept and len(kept) < len(ids)

    wins = {w for _, t in bench for w in decontamination.windows_of(decontamination.words_of(t), 10)}
    clean = [d for d in kept if not any(b' ' + w + b' ' in b' ' + b' '.join(decontamination.words_of(texts[d])) + b' ' for w in wins)]
    assert sorted(r.doc_id for r in seen[3]) == clean and len(clean) < len(kept)

    tok, held = Tokenizer.from_file(tokenizer_file()), {}
    for r in sorted(seen[4], key=lambda r: (r.sequence_id, r.offset)):
        held.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert held == {d: [*tok.encode(texts[d], add_special_tokens=False).ids, 2] for d in clean}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in seen[4])
