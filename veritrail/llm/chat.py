"""Chat formatting: link tool calls and results, order messages, validate arguments, write canonical JSON.

A message is plain text unless it is a JSON object with one of these keys:
``tools`` (a list of ``name`` and ``parameters``, a JSON schema), ``tool_calls``
(a list of ``id``, ``name``, ``arguments`` as object or JSON text, and optional
``depends_on``, a list of call ids; name and arguments may stand in
``function``), or ``tool_call_id`` (a result, with ``content``).

Results meet calls in a hash join on conversation and identifier; the first
call, by turn, of equal identifiers counts. Calls meet the first declaration of
their tool. A result must follow its call, and a call the results it depends on
(or the call itself, where there is no result): messages are peeled level by
level, all conversations at once, each taking ``anchor`` (the greatest turn of
itself and all before it) and ``depth`` (steps after the message that set it).
Order by anchor, depth, turn: it keeps the turns wherever they already agree
with the links. Messages on a cycle, or after one, keep their turn and are
marked. One row per message goes out, so a conversation of any length is never
gathered in one task.

Defined results: a null text is null content; a null role is ``user``; malformed
JSON (numbers beyond a double too), or a malformed part of such an object, makes
the message plain; rows without conv_id never link; half a surrogate pair is
written as an escape; a result
without a call is kept, not linked; a call whose tool is not declared, or whose
schema cannot be checked in full or in ``MAX_VISITS`` steps, counts neither as valid nor as invalid; repeated rows are
messages of their own. Identifiers of conversations may be of any type; a turn that is no number counts as null.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import count
from re import _parser as sre_parser
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import prepare, release, stable_rows
from veritrail.runtime import materialize

_PARSED = "kind string, calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>, result_of string, tools array<struct<name:string,schema:string>>, body string"


def canonical(value) -> str:
    """Sorted keys, no white space; half a surrogate pair stays an escape, as it is no character."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _strict(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def _no_constant(name):
    raise ValueError(name)


def _finite(text):
    x = float(text)
    if not math.isfinite(x):
        raise ValueError(text)
    return x


def _text(value) -> str:
    """An identifier or name; one with half a surrogate pair is malformed."""
    return str(value).encode().decode()


def loads(text: str):
    return json.loads(text, object_pairs_hook=_strict, parse_constant=_no_constant, parse_float=_finite)


def parse(text: str | None) -> tuple:
    """Kind, calls, identifier answered, tools and canonical content of a message."""
    plain = ("plain", [], None, [], canonical(text))
    if text is None or not text.lstrip().startswith("{"):
        return plain
    try:
        value = loads(text)
        if "tools" in value:
            tools = [{"name": _text(t["name"]), "schema": canonical(t.get("parameters") or {})} for t in value["tools"]]
            return "tools", [], None, tools, canonical(value)
        if "tool_calls" in value:
            calls = []
            for c in value["tool_calls"]:
                f = c.get("function") or c
                arguments = f.get("arguments", {})
                arguments = loads(arguments) if isinstance(arguments, str) else arguments
                calls.append({"id": _text(c["id"]), "name": _text(f["name"]), "arguments": canonical(arguments), "depends_on": [_text(x) for x in c.get("depends_on") or []]})
            return "calls", calls, None, [], canonical(value.get("content"))
        if "tool_call_id" in value:
            return "result", [], _text(value["tool_call_id"]), [], canonical(value.get("content"))
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        pass
    return plain


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, ()))


class Unchecked(Exception):
    """The schema asks for something that is not checked here."""


#: Keywords that decide validity and are not checked; ``format`` and the like are notes, as JSON Schema has them by default.
UNCHECKED = ("$dynamicRef", "$recursiveRef", "unevaluatedProperties", "unevaluatedItems", "nullable", "extends", "disallow", "divisibleBy")


def _same(value) -> str:
    """Canonical text in which equal numbers are equal and true is not 1."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() else x

    return canonical(plain(value))


_CLASSES = {"d": "0-9", "w": "A-Za-z0-9_"}


@functools.lru_cache(1000)
def _pattern(source: str) -> re.Pattern:
    """An ECMA pattern for Python; what differs and is not translated is not checked."""
    out, inside, i = [], False, 0
    while i < len(source):
        c, two = source[i], source[i : i + 2]
        if c == "\\":
            x = source[i + 1 : i + 2]
            if x in _CLASSES:
                two = _CLASSES[x] if inside else f"[{_CLASSES[x]}]"
            elif x in ("D", "W") and not inside:
                two = f"[^{_CLASSES[x.lower()]}]"
            elif x.isalpha() and x not in "sStnrfvxu" and (inside or x not in "bB"):
                raise Unchecked(source)
            out.append(two)
            i += 2
            continue
        if inside:
            inside = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            inside = True
            if re.match(r"\[\^?\]", source[i:]):
                raise Unchecked(source)
            out.append(c)
        elif two == "(?" and not re.match(r"\(\?(:|=|!|<=|<!|<[A-Za-z_])", source[i:]):
            raise Unchecked(source)
        elif re.match(r"\(\?<[A-Za-z_]", source[i:]):
            out.append("(?P<")
            i += 3
            continue
        else:
            out.append(r"\Z" if c == "$" else c)
        i += 1
    return re.compile("".join(out))


#: Schema nodes that the check of one call visits at most, and steps that a backtracking match may need.
MAX_VISITS, MAX_BACKTRACKS = 100_000, 10_000_000
_SPACE = r"\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


@functools.lru_cache(1000)
def _linear(source: str) -> str | None:
    """The pattern for an engine that takes linear time; None where that has no way to say it."""
    out, inside, i = [], False, 0
    while i < len(source):
        c, x = source[i], source[i + 1 : i + 2]
        if c == "\\" and x:
            i += 2
            if x in "sS" and not (inside and x == "S"):
                out.append(_SPACE if inside else f"[{'^' * (x == 'S')}{_SPACE}]")
            elif x == "u":
                out.append(f"\\x{{{source[i : i + 4]}}}")
                i += 4
            else:
                out.append("\\z" if x == "Z" else c + x)
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    try:
        pc.match_substring_regex(pa.array([""]), "".join(out))
    except pa.ArrowInvalid:
        return None
    return "".join(out)


@functools.lru_cache(1000)
def _repeats(source: str) -> tuple[int, bool]:
    """Number of open-ended repeats of a pattern, and whether one stands inside another."""
    open_ended, nested = 0, False

    def walk(parsed, inside: bool) -> None:
        nonlocal open_ended, nested
        for kind, value in parsed:
            if str(kind) in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                wide = value[1] > 16
                open_ended += wide
                nested |= inside and value[1] > 1
                walk(value[2], inside or wide)
            else:
                for part in value if isinstance(value, (tuple, list)) else [value]:
                    for p in part if isinstance(part, list) and not isinstance(part, sre_parser.SubPattern) else [part]:
                        if isinstance(p, sre_parser.SubPattern):
                            walk(p, inside)

    walk(sre_parser.parse(source), False)
    return open_ended, nested


def _found(source: str, text: str) -> bool:
    """Whether a pattern is found, in bounded time; what could take longer is not checked."""
    pattern = _pattern(source)
    whole = not any("\ud800" <= c <= "\udfff" for c in text)
    if whole and (linear := _linear(pattern.pattern)) is not None:
        return pc.match_substring_regex(pa.array([text]), linear)[0].as_py()
    open_ended, nested = _repeats(pattern.pattern)
    if nested or (len(text) + 1) ** (open_ended + 1) > MAX_BACKTRACKS:
        raise Unchecked(source)
    return pattern.search(text) is not None


def _target(ref: str, root):
    """The part of the schema that ``#`` or ``#/a/b`` names."""
    if ref != "#" and not ref.startswith("#/"):
        raise Unchecked(ref)
    found = root
    for step in ref.split("/")[1:]:
        step = unquote(step).replace("~1", "/").replace("~0", "~")
        found = found[int(step)] if isinstance(found, list) else found[step]
    return found


def problems(value, schema, at: str = "$", root=None, visits: Iterator[int] | None = None) -> list[str]:
    """Where ``value`` breaks ``schema``; raises Unchecked where that depends on a keyword of ``UNCHECKED`` or takes too long."""
    visits = count() if visits is None else visits
    if next(visits) > MAX_VISITS:
        raise Unchecked("too many steps")
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed"]
    if not isinstance(schema, dict) or not all(isinstance(schema.get(k) or {}, dict) for k in ("properties", "patternProperties")):
        raise Unchecked(schema)
    root = schema if root is None else root
    out = []
    found = [k for k in UNCHECKED if k in schema]
    if found or "$id" in schema and schema is not root:
        raise Unchecked(found)
    below = lambda v, s, where=at: problems(v, s, where, root, visits)
    fits = lambda s, v=value: not below(v, s)
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    if "$ref" in schema:
        out += below(value, _target(schema["$ref"], root))
    if "enum" in schema and _same(value) not in map(_same, schema["enum"]):
        out.append(f"{at}: enum")
    if "const" in schema and _same(value) != _same(schema["const"]):
        out.append(f"{at}: const")
    for s in schema.get("allOf", ()):
        out += below(value, s)
    if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        out.append(f"{at}: anyOf")
    if "oneOf" in schema and sum(map(fits, schema["oneOf"])) != 1:
        out.append(f"{at}: oneOf")
    if "not" in schema and fits(schema["not"]):
        out.append(f"{at}: not")
    if "if" in schema:
        out += below(value, schema.get("then" if fits(schema["if"]) else "else", True))
    if isinstance(value, dict):
        known, patterns = schema.get("properties") or {}, schema.get("patternProperties") or {}
        out += [f"{at}.{k}: required" for k in schema.get("required") or [] if k not in value]
        for k, v in value.items():
            own = [known[k]] if k in known else []
            own += [s for p, s in patterns.items() if _found(p, k)]
            for s in own:
                out += below(v, s, f"{at}.{k}")
            if not own and schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
            elif not own and "additionalProperties" in schema:
                out += below(v, schema["additionalProperties"], f"{at}.{k}")
            if "propertyNames" in schema:
                out += below(k, schema["propertyNames"], f"{at}.{k}")
        for word in ("dependentRequired", "dependentSchemas", "dependencies"):
            for k, s in (schema.get(word) or {}).items():
                if k in value and isinstance(s, list):
                    out += [f"{at}.{x}: required" for x in s if x not in value]
                elif k in value:
                    out += below(value, s)
    if isinstance(value, list):
        first, rest = schema.get("prefixItems", ()), schema.get("items", True)
        if isinstance(rest, list):  # as older drafts write prefixItems
            first, rest = rest, schema.get("additionalItems", True)
        for i, v in enumerate(value):
            out += below(v, first[i] if i < len(first) else rest, f"{at}[{i}]")
        if schema.get("uniqueItems") and len(set(map(_same, value))) < len(value):
            out.append(f"{at}: uniqueItems")
        if "contains" in schema:
            n = sum(fits(schema["contains"], v) for v in value)
            if not schema.get("minContains", 1) <= n <= schema.get("maxContains", n):
                out.append(f"{at}: contains")
    if isinstance(value, str) and "pattern" in schema and not _found(schema["pattern"], value):
        out.append(f"{at}: pattern")
    size = len(value) if isinstance(value, (str, list, dict)) else None
    unit = {str: "Length", list: "Items", dict: "Properties"}.get(type(value))
    if _is(value, "number"):
        low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        low, high = (schema.get(k) if x is True else None if x is False else x for k, x in (("minimum", low), ("maximum", high)))
        bad = {"minimum": value < schema.get("minimum", value), "maximum": value > schema.get("maximum", value)}
        bad |= {"exclusiveMinimum": low is not None and value <= low, "exclusiveMaximum": high is not None and value >= high}
        bad["multipleOf"] = "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])) != 0
        out += [f"{at}: {k}" for k, x in bad.items() if x]
    elif size is not None and (size < schema.get(f"min{unit}", size) or size > schema.get(f"max{unit}", size)):
        out.append(f"{at}: size")
    return out


def checked(value, schema) -> list[str] | None:
    """The problems of a call, or None where its schema is malformed, without end or not checked in full."""
    try:
        return [p.encode(errors="backslashreplace").decode() for p in problems(value, schema)]
    except (Unchecked, re.error, LookupError, TypeError, ValueError, AttributeError, ArithmeticError, RecursionError):
        return None


def _validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for arguments, schema in zip(batch.column("arguments").to_pylist(), batch.column("schema").to_pylist()):
            found.append(None if schema is None else checked(json.loads(arguments), json.loads(schema)))
        keep = [c for c in batch.schema.names if c not in ("arguments", "schema")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.list_(pa.string()))], names=[*keep, "problems"])


def _ordered(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """Anchor and depth of messages with a link into them: _rid, anchor, depth, in_cycle. ``edges``: before, after."""
    done = materialize(turns.join(edges.select(F.col("after").alias("_rid")).distinct(), "_rid", "left_anti").select("_rid", F.col("turn").alias("anchor"), F.lit(0).alias("depth")), "placed")
    waiting = materialize(edges, "waiting")
    turns = materialize(turns, "turns")
    while True:
        # Messages all of whose predecessors have a place.
        met = waiting.join(done.withColumnRenamed("_rid", "before"), "before", "left")
        ready = met.groupBy("after").agg(F.count_if(F.col("anchor").isNull()).alias("open"), F.max(F.struct("anchor", "depth")).alias("last")).filter("open = 0")
        new = ready.select(F.col("after").alias("_rid"), "last").join(turns, "_rid")
        new = materialize(new.select("_rid", F.greatest("turn", "last.anchor").alias("anchor"), F.when(F.col("turn") > F.col("last.anchor"), 0).otherwise(F.col("last.depth") + 1).alias("depth")), "placed")
        if new.isEmpty():
            break
        done = materialize(done.unionByName(new), "placed")
        waiting = materialize(waiting.join(new.select(F.col("_rid").alias("after")), "after", "left_anti"), "waiting")
        release(waiting.sparkSession)
    stuck = waiting.select(F.col("after").alias("_rid")).distinct().join(turns, "_rid").select("_rid", F.col("turn").alias("anchor"), F.lit(0).alias("depth"), F.lit(True).alias("in_cycle"))
    return done.withColumn("in_cycle", F.lit(False)).unionByName(stuck)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            m = {"role": r["role"] or "user", "content": json.loads(r["body"])}
            if r["kind"] == "calls":
                m["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": json.loads(c["arguments"])} for c in r["calls"]]
            elif r["kind"] == "result":
                m |= {"tool_call_id": r["result_of"], "name": r["call_name"]}
            out.append(canonical(m))
        keep = [c for c in batch.schema.names if c not in ("body", "calls", "call_name")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, "message"])


def format_chats(df: DataFrame) -> DataFrame:
    """One row per message of ``df`` (conv_id, turn, role, text) with its links, order and canonical JSON."""
    spark = df.sparkSession
    prepare(spark)
    rid = f"_rid struct<f:long,i:long>, conv_id {df.schema['conv_id'].dataType.simpleString()}, turn long, role string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("depends_on", pa.list_(pa.string()))])
        kinds = [pa.string(), pa.list_(call), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())])), pa.string()]
        for batch in batches:
            columns = list(zip(*map(parse, batch.column("text").to_pylist()))) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_rid", "conv_id", "turn", "role")], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["_rid", "conv_id", "turn", "role", "kind", "calls", "result_of", "tools", "body"])

    base = stable_rows(df).select("_rid", "conv_id", F.col("turn").try_cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = materialize(base.mapInArrow(read, f"{rid}, {_PARSED}"), "messages")
    calls = parsed.filter("kind = 'calls'").select("_rid", "conv_id", "turn", F.posexplode("calls").alias("nth", "c")).select("_rid", "conv_id", "turn", "nth", "c.*")
    first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "_rid", "nth", "name")).alias("call")).select("conv_id", "id", F.col("call._rid").alias("call_rid"), F.col("call.turn").alias("call_turn"), F.col("call.name").alias("call_name"))
    first = materialize(first, "first-calls")
    results = materialize(parsed.filter("kind = 'result'").select("_rid", "conv_id", "turn", F.col("result_of").alias("id")).join(first, ["conv_id", "id"]), "results")
    declared = parsed.filter("kind = 'tools'").select("_rid", "conv_id", "turn", F.explode("tools").alias("t")).groupBy("conv_id", F.col("t.name").alias("name")).agg(F.min_by("t.schema", F.struct("turn", "_rid", "t.schema")).alias("schema"))
    checked = calls.join(declared, ["conv_id", "name"], "left").select("_rid", "id", "arguments", "schema").mapInArrow(_validate, "_rid struct<f:long,i:long>, id string, problems array<string>")
    answered = results.select("conv_id", "id").distinct().withColumn("answered", F.lit(1))
    per_call = checked.groupBy("_rid").agg(F.count("*").alias("n_calls"), F.count_if(F.size("problems") == 0).alias("n_valid"), F.count_if(F.size("problems") > 0).alias("n_invalid"))
    open_calls = calls.join(answered, ["conv_id", "id"], "left").groupBy("_rid").agg(F.count_if(F.col("answered").isNull()).alias("n_unanswered"))
    # Links that order messages: call to result, and what a call depends on to the call.
    needs = calls.select("_rid", "conv_id", F.explode("depends_on").alias("id"))
    sources = results.select("conv_id", "id", F.col("_rid").alias("source")).unionByName(first.join(answered, ["conv_id", "id"], "left_anti").select("conv_id", "id", F.col("call_rid").alias("source")))
    edges = results.select(F.col("call_rid").alias("before"), F.col("_rid").alias("after")).unionByName(needs.join(sources, ["conv_id", "id"]).select(F.col("source").alias("before"), F.col("_rid").alias("after"))).distinct()
    edges = materialize(edges, "edges")
    out = parsed.join(per_call, "_rid", "left").join(open_calls, "_rid", "left").join(results.select("_rid", "call_name", "call_turn"), "_rid", "left")
    if edges.isEmpty():
        out = out.withColumns({"anchor": F.col("turn"), "depth": F.lit(0), "in_cycle": F.lit(False)})
    else:
        linked = parsed.select("_rid", F.coalesce("turn", F.lit(0)).alias("turn")).join(edges.select(F.explode(F.array("before", "after")).alias("_rid")).distinct(), "_rid")
        out = out.join(_ordered(edges, linked), "_rid", "left").withColumns({"anchor": F.coalesce("anchor", "turn"), "depth": F.coalesce("depth", F.lit(0)), "in_cycle": F.coalesce("in_cycle", F.lit(False))})
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("_rid", "conv_id", "turn", "role", "kind", "result_of", "call_turn", F.col("call_turn").isNotNull().alias("linked"), "anchor", F.col("depth").cast("int").alias("depth"), "in_cycle", zero("n_calls"), zero("n_valid"), zero("n_invalid"), zero("n_unanswered"), "calls", "call_name", "body")
    schema = f"{rid}, kind string, result_of string, call_turn long, linked boolean, anchor long, depth int, in_cycle boolean, n_calls long, n_valid long, n_invalid long, n_unanswered long, message string"
    return out.mapInArrow(_written, schema).drop("_rid")


ORACLE = """
SELECT conv_id, turn, role, 'plain' AS kind, NULL::BIGINT AS call_turn, false AS linked, turn AS anchor, 0::INT AS depth, false AS in_cycle,
  0::BIGINT AS n_calls, 0::BIGINT AS n_valid, 0::BIGINT AS n_invalid, 0::BIGINT AS n_unanswered,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || to_json(coalesce(role, 'user'))::VARCHAR || '}' AS message
FROM conversations
"""
