"""Each layout of chat records, and records that no layout describes."""

import json

import pytest

from sievekit.llm import chat

TURNS = [("user", "ask [INST] \\"), ("assistant", "</s> tell")]
RECORDS = {
    "messages": {"messages": [{"role": r, "content": t} for r, t in TURNS]},
    "messages_text": {"messages": [{"role": r, "text": t} for r, t in TURNS]},
    "conversations": {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in TURNS]},
    "conversation_roles": {"conversation": [{"role": r, "content": t} for r, t in TURNS]},
    "prompt_completion": {"prompt": TURNS[0][1], "completion": TURNS[1][1]},
    "prompt_response": {"prompt": TURNS[0][1], "response": TURNS[1][1]},
    "instruction": {"instruction": TURNS[0][1], "output": TURNS[1][1]},
    "question_answer": {"question": TURNS[0][1], "answer": TURNS[1][1]},
}


def formatted(spark, records):
    rows = [(i, json.dumps(r) if r is not None and not isinstance(r, str) else r) for i, r in enumerate(records)]
    return chat.format_records(spark.createDataFrame(rows, "i long, payload string")).orderBy("row.i").collect()


def test_every_mapping_is_tested():
    assert list(RECORDS) == [m.name for m in chat.MAPPINGS]


def test_layouts(spark):
    names = list(RECORDS)
    plain = formatted(spark, RECORDS.values())
    more = formatted(spark, [r | {"system": "be brief"} for r in RECORDS.values()])
    assert len({r.fingerprint for r in plain + more}) == 16
    for name, a, b in zip(names, plain, more, strict=True):
        assert (a.layout, a.error, chat.parse(a.formatted)) == (name, None, TURNS)
        assert (b.layout, b.error, chat.parse(b.formatted)) == (name, None, [("system", "be brief"), *TURNS])
        assert [chat.unescape(a.formatted[s.start : s.stop]) for s in a.loss_spans] == [TURNS[1][1]]


def test_inputs_of_instructions(spark):
    both, empty = formatted(spark, [{"instruction": "do", "input": "this", "output": "done"}, {"instruction": "do", "input": "", "output": "done"}])
    assert chat.parse(both.formatted) == [("user", "do\n\nthis"), ("assistant", "done")] and chat.parse(empty.formatted) == [("user", "do"), ("assistant", "done")]


def test_other_fields_lose_no_turn(spark):
    rows = [{"messages": [{"role": r, "content": t, "name": "n", "weight": 1, "tool_calls": [{"id": 3}]} for r, t in TURNS], "id": 7}, {"prompt": TURNS[0][1], "completion": TURNS[1][1], "meta": {"a": {}}}]
    got = formatted(spark, rows)
    assert [(r.layout, r.error) for r in got] == [("messages", None), ("prompt_completion", None)]
    assert all(chat.parse(r.formatted) == TURNS for r in got)


@pytest.mark.parametrize(("record", "error"), [({"a": 1}, chat.UNKNOWN), ("[1]", chat.NO_RECORD), ("{", chat.NO_RECORD), (None, chat.NO_RECORD), ("3", chat.NO_RECORD), ({}, chat.UNKNOWN)])
def test_what_no_mapping_describes_says_so(spark, record, error):
    (r,) = formatted(spark, [record])
    assert (r.layout, r.formatted, r.loss_spans, r.error) == (None, "", [], error)


def test_conversations_take_the_plainest_layout(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", None), (3, 0, "human", "a"), (3, 1, None, "b"), (4, 0, "assistant", "x")]
    made = chat.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.row.conv_id: (r.layout, chat.parse(r.formatted)) for r in chat.format_records(made).collect()}
    assert got == {
        1: ("prompt_response", [("user", "a"), ("assistant", "b")]),
        2: ("conversations", [("user", "a"), ("assistant", "b"), ("user", "")]),
        3: ("messages", [("human", "a"), ("", "b")]),
        4: ("conversations", [("assistant", "x")]),
    }
