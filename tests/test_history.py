import json

import pytest

from cohortlens.operators import history

MESSAGES = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(
    "text, chart_type",
    [
        ('{"chart_type": "bar", "data": []}', "bar"),
        (' {"chart_type": "bar"} ', "bar"),
        ('{"chart_type": ""}', None),
        ('{"chart_type": null}', None),
        ('{"chart_type": false}', None),
        ('{"chart_type": true}', "true"),
        ('{"chart_type": 0}', None),
        ('{"chart_type": 0.0}', None),
        ('{"chart_type": 2}', "2"),
        ('{"chart_type": []}', None),
        ('{"chart_type": {}}', None),
        ('{"chart_type": "false"}', "false"),
        ('{"data": 1}', None),
        ('[{"chart_type": "bar"}]', None),
        ('"chart_type"', None),
        ("plain words", None),
        ('{"chart_type": "bar"', None),
        ("", None),
        (None, None),
    ],
)
def test_chart_payload(spark, text, chart_type):
    rows = spark.createDataFrame([(1, 0, "assistant", text)], MESSAGES)
    got = history.chart_payloads(rows).collect()
    assert [r["chart_type"] for r in got] == ([] if chart_type is None else [chart_type])
    if chart_type:
        assert json.loads(got[0]["payload"]) == json.loads(text)


def test_titles(spark):
    rows = spark.createDataFrame(
        [
            (1, 0, "system", "be kind"), (1, 2, "user", "later"), (1, 1, "user", "é" * 61),
            (2, 0, "user", "x" * 60), (3, 0, "assistant", "hello"), (4, 0, "user", ""),
        ],
        MESSAGES,
    )
    got = {r["conv_id"]: (r["title"], r["message_count"]) for r in history.conversation_summaries(rows).collect()}
    assert got == {1: ("é" * 60 + "...", 3), 2: ("x" * 60, 1), 3: ("Untitled", 1), 4: ("Untitled", 1)}


def test_list_pages_through(spark):
    rows = spark.createDataFrame([(i, 0, "user", f"t{i}") for i in range(9)], MESSAGES)
    pages = [[r["conv_id"] for r in history.list_conversations(rows, 4, o).collect()] for o in (0, 4, 8)]
    assert pages == [[8, 7, 6, 5], [4, 3, 2, 1], [0]]


def test_replace_keeps_others_and_is_repeatable(spark):
    stored = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b")], MESSAGES)
    incoming = spark.createDataFrame([(2, 0, "user", "b"), (2, 1, "assistant", "c")], MESSAGES)
    once = history.replace_conversations(stored, incoming)
    twice = history.replace_conversations(once, incoming)
    expected = {(1, 0, "a"), (2, 0, "b"), (2, 1, "c")}
    for df in (once, twice):
        assert {(r["conv_id"], r["turn"], r["text"]) for r in df.collect()} == expected
        assert df.count() == 3


def test_tool_calls(spark):
    calls = json.dumps([{"name": "search", "args": {"q": 1}}, {"name": "chart", "args": {}}])
    rows = spark.createDataFrame(
        [(1, 1, calls), (2, 1, calls), (2, 3, None), (3, 0, "[]")], "conv_id long, turn long, tool_calls string"
    )
    flat = history.tool_calls(rows).collect()
    assert len(flat) == 4 and json.loads(flat[0]["args"]) == {"q": 1}
    usage = {r["tool"]: (r["calls"], r["conversations"]) for r in history.tool_usage(rows).collect()}
    assert usage == {"search": (2, 2), "chart": (2, 2)}


def test_conversation_times_where_there_are_any(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1L, 0L, 'user', 'a', timestamp'2024-01-01', timestamp'2024-01-01'),
        (1L, 1L, 'assistant', 'b', timestamp'2024-01-02', timestamp'2024-01-05'),
        (2L, 0L, 'user', 'c', timestamp'2024-01-03', timestamp'2024-01-03')
        AS t(conv_id, turn, role, text, created_at, updated_at)""")
    found = history.list_conversations(rows, newest="updated_at").collect()
    assert [(r["conv_id"], r["created_at"].day, r["updated_at"].day) for r in found] == [(1, 1, 5), (2, 3, 3)]
    assert "created_at" not in history.list_conversations(rows.drop("created_at", "updated_at")).columns
