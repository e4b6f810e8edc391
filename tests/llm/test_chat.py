import json

from graphloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, json string"
TOOLS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"enum": ["x", "y"]}}}}}


def calls(*xs):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), x, strict=False)) for x in xs]})


def result(i, content="ok"):
    return json.dumps({"content": content, "tool_call_id": i})


def run(spark, rows, tools=TOOLS):
    got = chat.link(spark.createDataFrame([(*r, "j") for r in rows], SCHEMA), tools).collect()
    by = {}
    for r in got:
        by.setdefault(r.conv_id, []).append(r)
    for part in by.values():
        part.sort(key=lambda r: r.position)
        assert [r.position for r in part] == list(range(len(part)))
    return by


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", "hi é\n"),
        (1, 1, "tool", result("b")),
        (1, 2, "assistant", calls(("a", "add", {"b": ["x"], "a": 1}), ("b", "add", '{"a": 2}', ["a"]))),
        (1, 3, "tool", result("a", {"z": 1, "y": [2]})),
        (1, 4, "tool", result("nope")),
        (1, 5, "assistant", calls(("c", "add", {"a": -1, "q": 0}), (None, "no", {}))),
        (2, 0, "assistant", calls(("a", "add", {"a": 1}, ["d"]), ("d", "add", {"a": 1}, ["a"]))),
        (2, 1, "tool", result("a")),
    ]
    by = run(spark, rows)
    one = by[1]
    place = {(r.kind, r.call_id): r.position for r in one}
    assert place["call", "a"] < place["call", "b"] < place["result", "b"] and place["call", "a"] < place["result", "a"]
    bad = {(r.kind, r.call_id): r.error for r in one if not r.valid}
    assert bad == {("result", "nope"): "no such call", ("call", "c"): "$.a: out of bounds; $.q: unknown", ("call", None): "id: missing; name: no tool no"}
    assert {r.call_id: r.name for r in one if r.kind == "result"} == {"a": "add", "b": "add", "nope": None}
    assert one[0].json == '{"content":"hi é\\n","role":"user"}'
    assert next(r.json for r in one if r.call_id == "b" and r.kind == "call") == '{"role":"assistant","tool_call":{"arguments":{"a":2},"id":"b","name":"add"}}'
    assert {r.call_id for r in by[2] if "cyclic" in r.error} >= {"a", "d"}


def test_edges(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 0, "assistant", "{broken"), (1, 0, "assistant", "{broken"), (1, None, "tool", "[]"), (1, 1, "assistant", "{" * 5000), (1, 2, "assistant", "w" * 100000), (2, 0, "tool", result("x"))]
    by = run(spark, rows)
    assert {k: len(v) for k, v in by.items()} == {None: 2, 1: 5, 2: 1}
    assert chat.link(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation_is_ranked_in_order(spark):
    rows = [(7, (i * 7919) % 1000, "user", f"m{i}") for i in range(1000)]
    part = run(spark, rows)[7]
    assert [r.turn for r in part] == sorted(r.turn for r in part)


def test_long_chains_are_placed_and_only_cycles_are_marked(spark):
    n = 80
    # One turn of calls, each needing the one before, written backwards; a second need skips ahead.
    chain = [(f"k{i}", "add", {"a": i}, [f"k{i - 1}", f"k{i // 2}"] if i else []) for i in range(n)]
    rows = [(1, 0, "assistant", calls(*reversed(chain))), (1, 1, "tool", result(f"k{n - 1}"))]
    # A chain over turns whose first call comes last; a cycle, what needs it, and a chain beside it.
    rows += [(2, i, "assistant", calls((f"k{n - 1 - i}", "add", {"a": i}, [f"k{n - 2 - i}"] if i < n - 1 else []))) for i in range(n)]
    rows += [(3, 0, "assistant", calls(("x", "add", {"a": 1}, ["y"]), ("y", "add", {"a": 1}, ["x"]), ("z", "add", {"a": 1}, ["y"]), *chain)), (3, 1, "tool", result("z"))]
    by = run(spark, rows)
    for c in (1, 2, 3):
        place = {r.call_id: r.position for r in by[c] if r.kind == "call"}
        assert all(place[f"k{i - 1}"] < place[f"k{i}"] for i in range(1, n))
    assert by[1][-1].kind == "result" and by[3][-1].kind == "result"
    assert all(r.valid for c in (1, 2) for r in by[c])
    assert {(r.kind, r.call_id) for r in by[3] if "cyclic" in r.error} == {("call", "x"), ("call", "y"), ("call", "z"), ("result", "z")}
    assert all(r.valid == ("cyclic" not in r.error) for r in by[3])


def test_odd_arguments(spark):
    deep = "[" * 3000 + "]" * 3000
    calls = [
        '{"tool_calls":[{"id":"a\\ud83d","name":"t","arguments":{"x":"\\ud83d"}}]}',
        '{"tool_calls":[{"id":"b","name":"t","arguments":{"n":1' + "0" * 400 + "}}]}",
        '{"tool_calls":[{"id":"c","name":"t","arguments":{"x":null}}]}',
        '{"tool_calls":[{"id":"d","name":"t","arguments":{"e":true}}]}',
        '{"tool_calls":[{"id":"e","name":"t","arguments":{"e":1.0}}]}',
        '{"tool_calls":[{"id":"f","name":"t","arguments":{"deep":' + deep + "}}]}",
        '{"tool_calls":[{"id":"g","name":"t","arguments":{"never":1}}]}',
    ]
    rows = [(1, 2 * i, "assistant", c) for i, c in enumerate(calls)] + [(1, 1, "tool", '{"tool_call_id":"a\\ud83d","content":"x\\udc00y"}'), (1, 20, "assistant", "w " * 200_000)]
    schema = {"t": {"type": "object", "properties": {"x": {"type": ["string", "null"]}, "n": {"type": "integer"}, "e": {"enum": [1]}, "never": False}}}
    got = {(r.kind, r.turn): r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schema).collect()}
    assert len(got) == len(rows)
    by_turn = {t: r for (kind, t), r in got.items() if kind == "call"}
    assert [by_turn[t].valid for t in (0, 2, 4, 6, 8, 12)] == [True, True, True, False, True, False]
    assert by_turn[0].json == '{"role":"assistant","tool_call":{"arguments":{"x":"\\ud83d"},"id":"a\\ud83d","name":"t"}}'
    assert got["result", 1].linked and ("call", 10) in got or ("message", 10) in got
