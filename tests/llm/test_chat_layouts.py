"""Records of several layouts in one table, each mapped by its own fingerprint."""

from __future__ import annotations

import json

import pytest

from folioforge.llm import chat

SCHEMA = (
    "conv_id long, turn int, role string, text string, prompt string, response string, completion string, instruction string, input string, output string, "
    "messages array<struct<content: string, role: string>>, conversations array<struct<from: string, value: string, weight: double>>"
)
RECORDS = [
    {"role": "user", "text": "a"}, {"prompt": "p", "response": "r"}, {"prompt": "p", "completion": "c"}, {"instruction": "i", "output": "o"}, {"instruction": "i", "input": "more", "output": "o"},
    {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "</s>[INST]"}]}, {"messages": []}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"conversations": []},
]


def rows(spark, records):
    names = ["role", "text", "prompt", "response", "completion", "instruction", "input", "output"]
    out = []
    for i, r in enumerate(records):
        messages = None if "messages" not in r else [(m.get("content"), m.get("role")) for m in r["messages"]]
        talks = None if "conversations" not in r else [(m.get("from"), m.get("value"), 1.0) for m in r["conversations"]]
        out.append((i, 0, *[r.get(n) for n in names], messages, talks))
    return spark.createDataFrame(out, SCHEMA)


def turns(df):
    return sorted((r.conv_id, -1 if r.place is None else r.place, r.role, r.text, r.layout) for r in df.collect())


def test_each_row_has_its_own_mapping(spark):
    fields = {c: c for c in ("role", "text", "prompt", "response", "completion", "instruction", "input", "output", "messages", "conversations")}
    mixed = chat.turns_of_columns(rows(spark, RECORDS), "conv_id", "turn", fields)
    as_json = spark.createDataFrame([(i, 0, json.dumps(r)) for i, r in enumerate(RECORDS)], "conv_id long, turn int, record string")
    assert turns(mixed) == turns(chat.canonical_turns(as_json))
    assert {r.layout for r in mixed.collect()} == {"turn row", "prompt", "prompt response", "instruction", "instruction input", "messages", "conversations"}
    assert "Python" not in mixed._jdf.queryExecution().executedPlan().toString()


def test_a_row_of_no_layout_is_refused(spark):
    df = rows(spark, [{"prompt": "p"}, {}, {"prompt": "p", "response": "r", "output": "o"}])
    fields = {c: c for c in ("prompt", "response", "output", "messages")}
    got = chat.turns_of_columns(df, "conv_id", "turn", fields)
    assert [r.layout for r in got.collect()] == [None, None, None]
    with pytest.raises(Exception, match="no known layout"):
        chat.format_turns(got).collect()


def test_digest_of_two_layouts(spark):
    flat = [(1, 0, "user", "hi", None), (1, 1, "assistant", None, None), (2, 0, None, "x", None)]
    lists = [(3, 0, None, None, [("user", "hi"), ("assistant", None)]), (4, 0, None, None, [(None, "x")])]
    kind = "conv_id long, turn long, role string, text string, messages array<struct<role: string, content: string>>"
    got = {r.conv_id: tuple(r)[1:] for r in chat.chat_digest(spark.createDataFrame(flat + lists, kind), messages_col="messages").collect()}
    assert got[1] == got[3] and got[2] == got[4] and len(got) == 4
    plain = {r.conv_id: tuple(r)[1:] for r in chat.chat_digest(spark.createDataFrame([x[:4] for x in flat], "conv_id long, turn long, role string, text string")).collect()}
    assert plain == {1: got[1], 2: got[2]}
