"""Evaluators and signers from outside."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veritrail.operators import plugins, receipts

KEY = b"key"


class ByLength:
    evaluator_name, policy_id, policy_version_hash = "custom", "length", "sha256:0"

    def evaluate(self, inputs):
        if any(r["x"] == "boom" for r in inputs):
            raise RuntimeError("no")
        return [("maybe" if r["x"] == "odd" else "allow" if r["x"] and len(r["x"]) < 3 else "deny", ["short"]) for r in inputs]


class Short(ByLength):
    def evaluate(self, inputs):
        return super().evaluate(inputs)[:-1] if len(inputs) > 1 else super().evaluate(inputs)


def broken():
    raise OSError("no connection")


@pytest.mark.parametrize("factory", [ByLength, Short])
def test_what_fails_is_denied(spark, factory):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["ab", "abc", "boom", None, "odd", "c"])], "i int, x string").withColumn("decision", F.lit("old"))
    got = {r.i: (r.decision, r.rules_fired, r.decision_error) for r in plugins.evaluate(rows.coalesce(1), factory, {"x": F.col("x")}).collect()}
    bad = [plugins.FAILED]
    assert got == {0: ("allow", ["short"], None), 1: ("deny", ["short"], None), 2: ("deny", bad, "RuntimeError"), 3: ("deny", ["short"], None), 4: ("deny", bad, "ValueError"), 5: ("allow", ["short"], None)}
    assert isinstance(factory(), plugins.Evaluator)


def test_set_up_fails(spark):
    rows = spark.range(5)
    out = plugins.evaluate(rows, broken, {"x": F.col("id")})
    assert {(r.decision, r.decision_error) for r in out.collect()} == {("deny", "OSError")}
    assert [tuple(r) for r in plugins.failed(out).collect()] == [("OSError", 5)]
    assert plugins.evaluate(rows.limit(0), broken, {}).count() == 0


class Reversed(plugins.Signer):
    algorithm = "reversed-sha1"

    def sign(self, message):
        return hashlib.sha1(message[::-1]).hexdigest()


class Mute(Reversed):
    algorithm = "mute"

    def sign(self, message):
        raise OSError("token is gone")


def test_signers(spark):
    body = '{"receipt_id":"r1","n":1}'
    df = spark.createDataFrame([(body,), (None,)], "r string").withColumn("signed", plugins.sign_receipts(F.col("r"), Reversed))
    signed = df.collect()[0].signed
    assert json.loads(signed)["signature"]["algorithm"] == "reversed-sha1" and df.collect()[1].signed is None
    texts = [signed, signed.replace('"n":1', '"n":2'), body, "{", signed.replace("reversed-sha1", "other"), signed.replace("reversed-sha1", "mute"), None]
    states = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string").select("i", plugins.signature_state(F.col("r"), [Reversed, Mute]).alias("s")).orderBy("i").collect()
    assert [r.s for r in states] == ["valid", "invalid", "unsigned", "malformed", "invalid", "invalid", None]
    with pytest.raises(Exception, match="token is gone"):
        df.select(plugins.sign_receipts(F.col("r"), Mute)).collect()
    assert spark.createDataFrame([(signed,)], "r string").select(receipts.signature_state(F.col("r"), KEY)).first()[0] == "invalid"
