import json
import re

from tarn.llm import chat

J = json.dumps


def linked(spark, rows, schemas=None):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS id", "2 AS name", "3 AS call", "4 AS errors")
    own = spark.createDataFrame(schemas, chat.SCHEMA) if schemas else None
    out = [tuple(r) for r in chat.link(df, own).collect()]
    low = lambda x: (x is not None, x if x is not None else 0)
    return sorted(out, key=lambda r: (low(r[0]), low(r[3]), r[4], low(r[1])))


CALLS = {"content": "let me", "tool_calls": [{"id": "a", "name": "w", "arguments": {"n": 3, "city": "X"}}, {"id": "b", "function": {"name": "w", "arguments": '{"n":"s","z":1, "a":[2, {"q":1,"b":2}]}'}}]}
ROWS = [
    (1, 0, "user", 'hi "x"\n é/ '), (1, 1, "assistant", J(CALLS)), (1, 2, "tool", J({"tool_call_id": "b", "content": "B"})), (1, 3, "tool", J({"tool_call_id": "a", "content": "A"})),
    (1, 4, "tool", J({"tool_call_id": "zz", "content": "O"})), (1, 5, "tool", J({"tool_call_id": "a", "content": "A2"})), (1, 6, "assistant", "{bad json"), (2, 0, "tool", J({"tool_call_id": "a", "content": "other conversation"})),
]


def test_links_order_and_json(spark):
    got = linked(spark, ROWS, [("w", "city", "string", True), ("w", "n", "integer", False)])
    assert [(r[1], r[3], r[4], r[7]) for r in got] == [(0, 0, 0, "plain"), (1, 1, 0, "invalid"), (3, 1, 1, "linked"), (5, 1, 1, "duplicate"), (2, 1, 2, "linked"), (4, 4, 0, "orphan"), (6, 6, 0, "plain"), (0, 0, 0, "orphan")]
    assert got[1][8] == ["missing city", "n is no integer", "unknown a", "unknown z"]
    for r in got:
        told = json.loads(r[9])
        assert r[9] == json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    calls = json.loads(got[1][9])["tool_calls"]
    assert calls[1] == {"arguments": {"a": [2, {"b": 2, "q": 1}], "n": "s", "z": 1}, "id": "b", "name": "w"}
    assert json.loads(got[0][9])["content"] == ROWS[0][3]


def test_without_schemas_and_answers(spark):
    got = linked(spark, ROWS[:3])
    assert [r[7] for r in got] == ["plain", "unanswered", "linked"]
    assert [r[7] for r in linked(spark, ROWS[:4])] == ["plain", "calls", "linked", "linked"]


def test_types(spark):
    args = {"i": 1, "f": 1.5, "s": "x", "b": True, "l": [1], "o": {"k": 1}, "z": None}
    kinds = {"i": "integer", "f": "number", "s": "string", "b": "boolean", "l": "array", "o": "object", "z": "null"}
    row = [(1, 1, "assistant", J({"tool_calls": [{"id": "a", "name": "t", "arguments": args}]}))]
    assert linked(spark, row, [("t", k, v, True) for k, v in kinds.items()])[0][8] == []
    wrong = [("t", k, "boolean" if v != "boolean" else "string", True) for k, v in kinds.items()]
    assert len(linked(spark, row, wrong)[0][8]) == 7
    bad = [(1, 1, "assistant", J({"tool_calls": [{"id": "a", "name": "t", "arguments": "[1]"}]}))]
    assert linked(spark, bad, [("t", "i", "integer", True)])[0][8] == ["arguments are no object"]


def test_repeated_results_and_calls(spark):
    one = (5, 2, "tool", J({"tool_call_id": "k", "content": "same"}))
    rows = [(5, 1, "assistant", J({"tool_calls": [{"id": "k", "name": "w"}]})), (5, 3, "assistant", J({"tool_calls": [{"id": "k", "name": "w"}]})), one, one, one]
    got = linked(spark, rows)
    assert sorted(r[7] for r in got) == ["calls", "duplicate", "duplicate", "linked", "unanswered"]


def test_defined_cases(spark):
    rows = [(None, None, None, None), (2, None, "user", ""), (1, 0, "user", "x" * 300_000), (1, 0, "user", "x" * 300_000), (None, 1, "assistant", J({"tool_calls": [{"name": "q", "arguments": "nope"}]})), (3, 1, "assistant", J({"tool_calls": [{"id": "d"}, {"id": "d"}]})), (3, 2, "tool", J({"tool_call_id": "d", "content": "1"}))]
    got = linked(spark, rows)
    assert len(got) == len(rows)
    assert {r[7] for r in got} == {"plain", "unanswered", "linked"}
    assert linked(spark, []) == []


def test_native_plan(spark):
    df = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")
    assert not re.search("Python|Pandas|Arrow", chat.link(df)._jdf.queryExecution().executedPlan().toString())
