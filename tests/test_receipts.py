import json

from pyspark.sql import functions as F

from veritrail.operators import events, receipts

KEY = b"k"


def test_sign_and_audit(spark):
    raw = [json.dumps({"receipt_id": "x", "n": 1.5, "t": "ü\x1f", "e": 1e-05}), json.dumps({"a": None})]
    df = spark.createDataFrame([(r,) for r in raw], "receipt string").withColumn("receipt", receipts.sign_json(F.col("receipt"), KEY))
    assert {r.signature_state for r in receipts.audit(df, "receipt", KEY).collect()} == {"valid"}
    assert {r.signature_state for r in receipts.audit(df, "receipt", b"other").collect()} == {"invalid"}
    changed = df.withColumn("receipt", F.regexp_replace("receipt", '"n":1.5', '"n":2.5'))
    assert sorted(r.ok for r in receipts.audit(changed, "receipt", KEY).collect()) == [False, True]
    odd = spark.createDataFrame([("{}",), ("{bad",), (None,), ('{"signature":{"algorithm":"x","value":"y"}}',)], "receipt string")
    assert [r.signature_state for r in receipts.audit(odd, "receipt", KEY).collect()] == ["unsigned", "malformed", None, "invalid"]
    assert [r.ok for r in receipts.audit(odd, "receipt", KEY, allow_unsigned=True).collect()] == [True, False, False, False]


def test_summaries(spark):
    src = spark.createDataFrame([("p", "VERIFIED"), ("q", "STALE"), ("q", "VERIFIED"), ("f", "TAMPERED")], "r string, outcome string")
    got = {x.r: (x.total_chunks, x.stale, x.overall_status) for x in receipts.source_summary(src, "r", F.col("outcome") == "TAMPERED").collect()}
    assert got == {"p": (1, 0, "PASS"), "q": (2, 1, "PARTIAL"), "f": (1, 0, "FAIL")}
    act = spark.createDataFrame([("a", "deny"), ("a", None), ("b", "allow")], "r string, decision string")
    assert {x.r: (x.actions_allowed, x.actions_denied) for x in receipts.action_summary(act, "r").collect()} == {"a": (1, 1), "b": (1, 0)}


def test_event_kinds_and_severities(spark):
    rows = [("VERIFIED", False, None), ("VERIFIED", False, "deny"), ("STALE", False, "deny"), ("STALE", False, "allow"), ("TAMPERED", True, None), (None, None, None)]
    df = spark.createDataFrame(rows, "o string, g boolean, d string")
    kind = events.source_kind(F.col("o"), F.col("g"), F.col("d"))
    got = [tuple(r) for r in df.select(kind, events.severity(kind, F.col("o"), F.col("d"))).collect()]
    assert got == [("source_allowed", 1), ("source_blocked", 4), ("source_blocked", 5), ("source_allowed", 1), ("source_blocked", 5), ("source_allowed", 1)]
