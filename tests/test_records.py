"""Decision inputs, keyed hashes, whole receipts, event blocks, cursors and the retry sink on small hand-made rows."""

import datetime
import hashlib
import hmac
import json
import shutil

import pytest
from pyspark.sql import functions as F

from veritrail.functions import canon
from veritrail.operators import decisions, detect, events, index, policy, receipts, trajectory
from veritrail.sources import readers
from veritrail.streaming import sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_hashes_of_callers_and_values(spark):
    raw = '{"role": "r", "id": "é"}'
    flat = '{"id":"é","role":"r"}'.encode()
    got = one(
        spark, plain=canon.caller_hash(F.lit(raw)), salted=canon.caller_hash(F.lit(raw), b"s"), none=canon.caller_hash(F.lit(None).cast("string")),
        text=canon.value_hash(F.lit("é")), raw=canon.value_hash(F.lit(bytearray(b"\xff")), "binary"), json=canon.value_hash(F.lit(raw), "json"),
    )
    assert got.plain == got.json == "sha256:" + hashlib.sha256(flat).hexdigest()
    assert got.salted == "hmac-sha256:" + hmac.new(b"s", flat, "sha256").hexdigest()
    assert (got.none, got.text, got.raw) == (None, canon.sha256_text("é"), "sha256:" + hashlib.sha256(b"\xff").hexdigest())
    with pytest.raises(ValueError):
        canon.value_hash(F.lit("x"), "yaml")


def test_secret_is_read_where_it_is_used_and_never_defaults(spark, monkeypatch):
    monkeypatch.delenv("VERITRAIL_NO_KEY", raising=False)
    with pytest.raises(RuntimeError):
        canon.key_bytes(canon.Secret("VERITRAIL_NO_KEY"))
    rows = spark.createDataFrame([("sha256:1", "d", "sha256:v", "t", 0, 1)], ", ".join(f"{c} {'int' if c.startswith('chunk') else 'string'}" for c in index.SIGNED))
    with pytest.raises(Exception, match="VERITRAIL_NO_KEY"):
        index.sign(rows, canon.Secret("VERITRAIL_NO_KEY")).collect()
    monkeypatch.setenv("HOME_KEY", "k")
    assert canon.key_bytes(canon.Secret("HOME_KEY")) == b"k" == canon.key_bytes(b"k")


def test_inputs_keep_what_is_there(spark):
    request = decisions.request_block(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("p"), F.lit("t"))
    at, source = F.lit("2024"), F.lit("indexed_corpus")
    make = lambda m: decisions.chunk_inputs(F.lit(m).cast("string"), at, source, request)
    got = one(spark, none=make(None), null=make('{"ingested_at":null,"x":{"b":1,"a":"é"}}'), bare=decisions.chunk_inputs(F.lit("{}"), F.lit(None).cast("string"), source, request))
    block = {"caller": {}, "jurisdiction": None, "purpose": "p", "timestamp": "t"}
    told = lambda m: canon.canonical_json({"chunk_metadata": m, "request_context": block})
    assert got.none == told({"ingested_at": "2024", "content_source": "indexed_corpus"})
    assert got.null == told({"ingested_at": None, "content_source": "indexed_corpus", "x": {"a": "é", "b": 1}})
    assert got.bare == told({"content_source": "indexed_corpus"})
    tool = one(spark, x=decisions.tool_inputs(F.lit("n"), F.lit(None).cast("string"), F.lit(None).cast("string"), request, F.lit("s")))
    assert json.loads(tool.x) == {"tool_parameters": {"name": "n", "operation": None, "parameters": {}, "target_system": "s"}, "request_context": block}


def test_last_decision_wins_and_null_keys_meet_nothing(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    decided = spark.createDataFrame([("a", 1, "deny"), ("a", 2, "allow"), (None, 3, "deny")], "k string, pos int, decision string")
    assert {r.k: r.decision for r in decisions.attach(rows, decided, ["k"], "pos").collect()} == {"a": "allow", "b": None, None: None}


def test_receipt_halves(spark):
    heads = spark.createDataFrame([("q1", "r1", "t", "out"), ("q2", "r2", "t", None), ("q3", "r3", "t", "")], "request_id string, receipt_id string, issued_at string, output_text string")
    schema = "request_id string, chunk_index int, fingerprint string, document_id string, document_version string, ingested_at string, chunk_offset int, chunk_length int, authorized boolean, outcome string, decision string, rules_fired array<string>, inputs_hash string, inputs string"
    sources = spark.createDataFrame([("q1", 1, "f1", None, None, None, None, None, None, "UNVERIFIED", None, None, None, None), ("q1", 0, "f0", "d", "v", "t", 0, 1, True, "VERIFIED", "deny", ["x"], "h", '{"a":1}')], schema)
    actions = spark.createDataFrame([("q2", 0, "n", "op", "h", '{"z":1}', "deny", ["y"])], "request_id string, action_index int, name string, operation string, parameters_hash string, parameters string, decision string, rules_fired array<string>")
    named = {"evaluator": "e", "policy_id": "p", "policy_version_hash": "sha256:0"}
    flags = policy.VerificationPolicy()
    got = {r.request_id: json.loads(r.receipt) for r in receipts.full_receipts(heads, flags, sources, actions, named, named).collect()}
    a, b, c = got["q1"], got["q2"], got["q3"]
    assert [s["fingerprint"] for s in a["sources"]] == ["f0", "f1"] and a["sources"][1]["document_id"] is None and "claims" not in a["sources"][0]
    assert a["policy"]["access_control"] == {**named, "decisions": [{"chunk_fingerprint": "f0", "decision": "deny", "rules_fired": ["x"], "inputs_hash": "h", "inputs": {"a": 1}}]}
    assert (a["summary"]["overall_status"], "actions" in a, "total_actions" in a["summary"]) == ("PARTIAL", False, False)
    assert b["sources"] == [] and b["actions"][0]["parameters"] == {"z": 1} and b["policy"]["tool_call_control"]["decisions"][0]["inputs"] is None
    assert b["summary"] == {"total_chunks": 0, "verified": 0, "stale": 0, "unauthorized": 0, "unverified": 0, "tampered": 0, "overall_status": "FAIL", "total_actions": 1, "actions_allowed": 0, "actions_denied": 1}
    assert c["summary"]["overall_status"] == "PASS" and c["output"]["hash"] == b["output"]["hash"] == canon.sha256_text("") and "caller_hash" not in c
    alone = json.loads(receipts.full_receipts(heads.limit(0).union(heads.filter("request_id = 'q3'")), flags).first().receipt)
    assert set(alone["policy"]) == {"verification"} and alone["sources"] == []
    assert receipts.full_receipts(heads.limit(0), flags, sources, actions).count() == 0


def test_event_parts(spark):
    rows = spark.createDataFrame(
        [("source_blocked", "r", "VERIFIED", "deny", ["a", "b"], "h", None, "f"), ("source_blocked", "r", "STALE", "deny", ["a"], "h", "d", "f"), ("action_allowed", "r", None, "allow", ["a"], "h", None, None), ("action_allowed", "r", None, None, None, None, None, None)],
        "kind string, receipt_id string, outcome string, decision string, rules_fired array<string>, inputs_hash string, document_id string, fingerprint string",
    ).withColumn("issued_at", F.lit("2024-01-01T00:00:00Z"))
    got = events.blocks(rows, extra={"organization": "o"}).collect()
    assert [r.metadata.labels for r in got] == [["verification_outcome:VERIFIED", "rules_fired:a,b"], ["verification_outcome:STALE"], ["rules_fired:a", "inputs_hash:h", "rules_fired:a"], []]
    assert [r.finding_info and r.finding_info.types for r in got] == [["ACCESS_CONTROL_DENY"], ["STALE"], None, None]
    assert [r.resources and r.resources[0].uid for r in got] == ["f", "d", None, None] and {r.metadata.organization for r in got} == {"o"}
    assert got[3].api.service.name == "" and got[3].actor.user is None and got[0].api is None


def test_cursor_holds_agent_and_session(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [("t", at(0), "r0", "a", None, None), ("t", at(1), None, None, "s", None), ("t", at(2), "r2", None, None, "q"), ("t", at(3), "r3", "b", None, None), ("u", at(0), "r9", None, None, None)]
    steps = trajectory.next_steps(spark.createDataFrame(rows, "trajectory_id string, ts timestamp, receipt_id string, agent_id string, session_id string, request_session_id string"))
    got = {r.receipt_id: (r.step_index, r.parent_step_ids, r.agent_id, r.session_id) for r in steps.collect()}
    assert got == {"r0": (0, [], "a", None), "r2": (2, ["r0"], "a", "q"), "r3": (3, ["r2"], "b", "q"), "r9": (0, [], None, None)}


def test_percentiles_by_place(spark):
    values = [5, 1, 1, 9, 7, None, 3]
    row = detect.sorted_percentiles(spark.createDataFrame([("k", v) for v in values], "k string, v int"), "k", "v").first()
    s = sorted(v for v in values if v is not None)
    assert (row["count"], row.min, row.max, row.p50, row.p95, row.p999) == (6, 1, 9, s[2], s[4], s[4]) and row.mean == pytest.approx(26 / 6)
    names = spark.createDataFrame([("h", "b"), ("h", "a")], "caller_hash string, label string")
    rows = spark.createDataFrame([("h",), ("i",)], "caller_hash string")
    for bound in (0, 10):
        assert {r.caller_hash: r.label for r in detect.labelled(rows, names, bound).collect()} == {"h": "a", "i": "i"}


def test_hits_hold_nodes(spark):
    class Node:
        def get_content(self):
            return "said"

    class Odd:
        text = "field"

        def get_content(self, mode):
            return mode

    class Hit:
        def __init__(self, node):
            self.node = node

    assert [r.text for r in readers.chunk_rows(spark, [Hit(Node()), Node(), Odd(), Hit("plain")]).orderBy("chunk_index").collect()] == ["said", "said", "field", "plain"]


def test_retry_keeps_order_and_counts_what_is_lost(spark, tmp_path):
    seen, down = [], [True]

    def sink(df):
        if down[0]:
            raise OSError
        seen.append(df)

    gone = []
    retry = sinks.Retrying(sink, keep=2, hold=lambda x: x, drop=gone.append)
    for x in (1, 2, 3):
        retry(x)
    assert list(retry.waiting) == [2, 3]
    down[0] = False
    retry(4)
    assert seen == [2, 3, 4] and not retry.waiting and gone == [1, 2, 3]
    down[0] = True
    retry(5)
    assert retry.close() == 1
    with pytest.raises(RuntimeError):
        retry(6)
    with pytest.raises(ValueError):
        sinks.daily_lines(str(tmp_path), "../x")
    rows = spark.createDataFrame([("2024-02-03T23:30:00-01:00", "{}")], "issued_at string, receipt string")
    sinks.daily_lines(str(tmp_path / "o"), "audit")(rows)
    assert [p.name for p in (tmp_path / "o").iterdir() if p.is_dir()] == ["file=audit-2024-02-04"]


def test_batches_wait_as_rows(spark, tmp_path):
    """What waits can be written after its source is gone; a closed sink in a fan-out is raised, a broken one is not."""
    source = tmp_path / "in"
    spark.range(3).selectExpr("concat('r', id) AS receipt_id").write.parquet(str(source))
    seen, down = [], [True]

    def sink(df):
        if down[0]:
            raise OSError
        seen.extend(r.receipt_id for r in df.collect())

    retry = sinks.Retrying(sink)
    retry(spark.read.parquet(str(source)))
    shutil.rmtree(source)
    down[0] = False
    retry(spark.createDataFrame([("r9",)], "receipt_id string"))
    assert sorted(seen) == ["r0", "r1", "r2", "r9"]
    assert retry.close() == 0
    reached = []
    both = sinks.fan_out([lambda df: 1 / 0, lambda df: reached.append(df.count()), retry])
    with pytest.raises(sinks.SinkClosed):
        both(spark.range(2))
    assert reached == [2]


def test_events_are_forwarded(spark):
    rows = spark.createDataFrame(
        [("source_blocked", "r", "STALE", "deny", ["a"], "h", "d", "f", 4, "t"), ("action_allowed", "s", None, "allow", ["a"], "h", None, None, 1, None)],
        "kind string, receipt_id string, outcome string, decision string, rules_fired array<string>, inputs_hash string, document_id string, fingerprint string, severity_id int, title string",
    ).withColumns({"issued_at": F.lit("2024-01-01T00:00:00Z"), "trajectory_id": F.lit(None).cast("string")})
    out = []
    sinks.forward_events(lambda df: out.extend(df.collect()))(rows)
    got = {r.receipt_id: json.loads(r.receipt) for r in out}
    assert got["r"]["class_uid"] == 2004 and got["r"]["finding_info"]["types"] == ["STALE"] and got["s"]["class_uid"] == 6003
    assert {r.issued_at for r in out} == {"2024-01-01T00:00:00Z"}


def test_native_json_is_canonical(spark):
    texts = ["", 'q"\\', "".join(map(chr, range(0x20))), "\x7f é   \U0001f600", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(canon.quoted(F.col("t")).alias("q"), canon.object_of({"b": canon.quoted(F.col("t")), "a": F.lit("1")}).alias("o")).collect()
    assert [r.q for r in got] == [None if t is None else canon.canonical_json(t) for t in texts]
    assert [r.o for r in got] == [canon.canonical_json({"a": 1} if t is None else {"a": 1, "b": t}) for t in texts]


def test_receipts_read_each_side_once_and_write_each_part_once(spark):
    """sources and actions are read once each, and no JSON text is made again for each place that names it."""
    rows = spark.range(7).select(F.lit("r").alias("request_id"), F.col("id").cast("int").alias("action_index"), F.lit("n").alias("name"), F.lit("o").alias("operation"), F.col("id").cast("string").alias("parameters_hash"), F.lit("deny").alias("decision"), F.lit(None).cast("array<string>").alias("rules_fired"), F.lit("t").alias("target_system"))
    heads = spark.createDataFrame([("r", "prx_1", "now")], "request_id string, receipt_id string, issued_at string")
    made = receipts.full_receipts(heads, policy.VerificationPolicy(), actions=rows, tools={"evaluator": "rules", "policy_id": 'p"'})
    assert made._jdf.queryExecution().executedPlan().toString().count("Range (0, 7") == 1
    value = json.loads(made.first().receipt)
    assert [a["action_index"] for a in value["actions"]] == list(range(7)) and value["actions"][0]["target_system"] == "t"
    assert value["policy"]["tool_call_control"]["policy_id"] == 'p"' and len(value["policy"]["tool_call_control"]["decisions"]) == 7
    text = canon.merged(F.to_json(F.struct("name")), F.to_json(F.struct("operation")))
    assert rows.select(text.alias("x"))._jdf.queryExecution().analyzed().toString().count("to_json") == 2
