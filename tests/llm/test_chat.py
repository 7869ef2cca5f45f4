import json
import time

from veritrail.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, kind string"
TOOLS = {"tools": [{"name": "add", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"], "additionalProperties": False}}]}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "depends_on": d} for i, n, a, d in calls]})


def result(i, x):
    return json.dumps({"content": x, "tool_call_id": i})


def test_linking_order_and_validation(corpus):
    rows = [
        (1, 0, "system", json.dumps(TOOLS)), (1, 1, "user", 'hi "x"\n'), (1, 2, "tool", result("c1", {"b": 1, "a": 2})),
        (1, 3, "assistant", call(("c1", "add", '{"a":1}', []), ("c2", "add", {"a": "x"}, []), ("c3", "zz", {}, []))), (1, 4, "tool", result("nope", 1)),
        (2, 0, "assistant", call(("a", "f", {}, ["b"]))), (2, 1, "tool", result("a", "ra")), (2, 2, "assistant", call(("b", "f", {}, []))), (2, 3, "tool", result("b", "rb")), (2, 4, "user", None),
        (3, 0, "assistant", call(("a", "f", {}, ["b"]))), (3, 1, "assistant", call(("b", "f", {}, ["a"]))), (None, None, None, "{bad"), (4, 0, "user", "same"), (4, 0, "user", "same"),
    ]
    out = chat.format_chats(corpus([(*r, "x") for r in rows], "conversations", SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    order = lambda c: [r.turn for r in sorted((r for r in out if r.conv_id == c), key=lambda r: (r.anchor, r.depth, r.turn))]
    assert order(1) == [0, 1, 3, 2, 4] and order(2) == [2, 3, 0, 1, 4]
    c = by[(1, 3)]
    assert (c.n_calls, c.n_valid, c.n_invalid, c.n_unanswered) == (3, 1, 1, 2)
    assert by[(1, 2)].linked and by[(1, 2)].call_turn == 3 and not by[(1, 4)].linked
    assert by[(1, 2)].message == '{"content":{"a":2,"b":1},"name":"add","role":"tool","tool_call_id":"c1"}'
    assert by[(1, 1)].message == chat.canonical({"role": "user", "content": 'hi "x"\n'})
    assert by[(3, 0)].in_cycle and by[(3, 1)].in_cycle and not by[(2, 0)].in_cycle
    assert by[(None, None)].message == '{"content":"{bad","role":"user"}' and by[(2, 4)].message == '{"content":null,"role":"user"}'


def test_any_json(corpus):
    tools = json.dumps({"tools": [{"name": n, "parameters": p} for n, p in (("a", {"required": 5}), ("b", {"minimum": "x"}), ("c", {"enum": 4}), ("d", {"type": 5}), ("e", {"properties": [1]}), ("f", {"maxLength": "3"}), ("g", [1]), ("h", {"properties": {"\ud800": False}}))]})
    texts = [tools, call(*[(n, n, x, []) for n, x in zip("abcdefgh", ({}, 1, 1, 1, {"k": 1}, '"long"', 1, {"\ud800": 1}))]), '{"tool_call_id":"a","content":"\\ud800"}', '{"tool_call_id":"a","content":1e999}', '{"tool_call_id":"\\ud800"}', '{"tools":5}', '{"tool_calls":[1]}', "{" * 5000, '{"tool_calls":null}']
    rows = [(c, i, "tool", t, "x") for c in (1, None) for i, t in enumerate(texts)]
    out = chat.format_chats(corpus(rows, "conversations", SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {r.turn: r for r in out if r.conv_id == 1}
    assert (by[1].n_calls, by[1].n_valid, by[1].n_invalid) == (8, 0, 1)
    assert by[2].linked and by[2].message == '{"content":"\\ud800","name":"a","role":"tool","tool_call_id":"a"}'
    assert [by[i].kind for i in range(3, 9)] == ["plain"] * 6
    assert not any(r.linked or r.n_valid or r.n_invalid for r in out if r.conv_id is None)


def test_empty(corpus):
    assert chat.format_chats(corpus([], "conversations", SCHEMA)).count() == 0


def test_schemas():
    s = {"type": "object", "properties": {"n": {"type": "number", "minimum": 1}, "t": {"enum": ["a", 1]}, "l": {"type": "array", "items": {"type": "string"}, "maxItems": 1}}}
    assert chat.problems({"n": 1.5, "t": 1, "l": ["x"]}, s) == []
    assert len(chat.problems({"n": 0, "t": True, "l": ["x", 2]}, s)) == 4
    assert chat.problems(True, {"type": "integer"}) and not chat.problems(2.0, {"type": "integer"})


def test_schema_keywords():
    cases = [
        ({"$ref": "#/$defs/n", "$defs": {"n": {"type": "integer"}}}, 1, "x"),
        ({"properties": {"k": {"$ref": "#"}}, "additionalProperties": False}, {"k": {"k": {}}}, {"k": {"z": 1}}),
        ({"anyOf": [{"type": "null"}, {"type": "string"}]}, None, 1),
        ({"oneOf": [{"minimum": 1}, {"maximum": 5}]}, 0, 3),
        ({"allOf": [{"minimum": 1}, {"maximum": 5}]}, 3, 6),
        ({"not": {"type": "string"}}, 1, "x"),
        ({"if": {"minimum": 5}, "then": {"multipleOf": 5}, "else": {"multipleOf": 2}}, 10, 3),
        ({"pattern": "^\\d+$"}, "12", "12\n"),
        ({"exclusiveMinimum": 1}, 2, 1),
        ({"exclusiveMaximum": 1}, 0, 1),
        ({"minimum": 1, "exclusiveMinimum": True}, 2, 1),
        ({"multipleOf": 0.1}, 0.3, 0.35),
        ({"uniqueItems": True}, [1, True, "1"], [1, 1.0]),
        ({"prefixItems": [{"type": "string"}], "items": False}, ["x"], ["x", 1]),
        ({"items": [{"type": "string"}], "additionalItems": False}, ["x"], ["x", 1]),
        ({"contains": {"const": 1}, "maxContains": 1}, [1, 2], [1, 1]),
        ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, {"x1": 1}, {"y": 1}),
        ({"propertyNames": {"maxLength": 1}}, {"a": 1}, {"ab": 1}),
        ({"dependentRequired": {"a": ["b"]}}, {"a": 1, "b": 1}, {"a": 1}),
        ({"const": 1}, 1.0, True),
    ]
    for schema, good, bad in cases:
        assert chat.checked(good, schema) == [] and chat.checked(bad, schema), schema


def test_what_is_not_checked_is_not_valid(corpus):
    for schema in ({"$ref": "http://x/y"}, {"$ref": "#"}, {"$ref": "#/none"}, {"unevaluatedProperties": False}, {"pattern": "\\p{L}"}, {"minimum": "x"}):
        assert chat.checked({"a": 1} if "minimum" not in schema else 1, schema if "pattern" not in schema else {"propertyNames": schema}) is None
    tools = json.dumps({"tools": [{"name": "f", "parameters": {"unevaluatedProperties": False}}, {"name": "g", "parameters": {"anyOf": [{"required": ["a"]}]}}]})
    rows = [(1, 0, "system", tools, "x"), (1, 1, "assistant", call(("a", "f", {}, []), ("b", "g", {}, []), ("c", "g", {"a": 1}, [])), "x")]
    r = chat.format_chats(corpus(rows, "conversations", SCHEMA)).filter("turn = 1").first()
    assert (r.n_calls, r.n_valid, r.n_invalid) == (3, 1, 1)


def test_checks_end():
    """Schemas that double at each step and patterns that backtrack without end count as unchecked or are matched in linear time."""
    doubling = {"definitions": {f"d{i}": {"allOf": [{"$ref": f"#/definitions/d{i + 1}"}] * 2} for i in range(31)} | {"d31": {"type": "string"}}, "$ref": "#/definitions/d0"}
    start = time.monotonic()
    assert chat.checked("x", doubling) is None
    evil = "a" * 40 + "!"
    assert chat.checked(evil, {"pattern": "^(a+)+$"}) == ["$: pattern"]
    assert chat.checked(evil, {"pattern": "^(?=(a+)+$)a"}) is None
    assert chat.checked("a" * 5000, {"pattern": "(?!b)a*a*a*c"}) is None
    assert time.monotonic() - start < 20


def test_linear_patterns_mean_the_same():
    for source, texts in {r"^\d{2}-\w+$": ["12-ab", "12-é", "٣٤-a"], r"[\s]x": [" x", " x", "ax"], r"Ab": ["Ab", "ab"], "a$": ["a", "a\n"], r"\Sx\S": ["axb", " xb"], "^(?=.*1)a": ["a1", "ab"]}.items():
        for t in texts:
            assert chat._found(source, t) == bool(chat._pattern(source).search(t)), (source, t)


def test_identifiers_of_any_type(spark):
    rows = [("c-1", "0", "user", "hello"), ("c-1", "x", None, "there"), (None, "1", "user", '{"tool_call_id": "a", "content": 1}')]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")).collect()
    assert sorted((r.conv_id or "", r.turn) for r in got if r.turn is not None) == [("", 1), ("c-1", 0)] and len(got) == 3
