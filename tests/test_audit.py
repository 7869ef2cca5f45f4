import json

import pytest
from pyspark.sql import functions as F

from veritrail.functions import canon
from veritrail.operators import admission, audit, index, merkle, policy, receipts

KEY = b"k"
RULES = {"version": 1, "policy_id": "t", "tool_call_control": {"rules": [{"name": "known", "require": {"tool.name": {"in": ["search", "memory.write"]}}, "on_violation": "deny"}]}}


def test_admission(spark):
    calls = spark.createDataFrame([("r", 1, "search", "query", '{"b":1,"a":2}'), ("r", 2, "shell", "run", None)], "rid string, n int, name string, operation string, parameters string")
    bound = policy.map_binding({"tool.name": (F.col("name"), "string")}, {})
    out = admission.admit(calls, policy.bundle(RULES, "tool_call_control"), bound, F.lit("2026-01-01T00:00:00Z"), redact=True)
    rows = {r.name: r for r in out.collect()}
    assert rows["search"].parameters_hash == canon.sha256_text('{"a":2,"b":1}') and rows["search"].parameters is None
    assert (rows["search"].decision, rows["shell"].decision, rows["shell"].rules_fired) == ("allow", "deny", ["known"])
    with pytest.raises(admission.AdmissionDenied):
        admission.enforce(out)
    yes, no = admission.split(out)
    assert (admission.enforce(yes).count(), no.count()) == (1, 1)
    assert [a.action_index for a in admission.actions(out, "rid", ["n"]).first().actions] == [0, 1]
    assert {r.decision for r in admission.admit(calls, None, bound, F.lit("x")).collect()} == {"allow"}


def test_memory_and_model_calls(spark):
    w = admission.memory_writes(spark.createDataFrame([("k", "v", "ns")], "key string, value string, namespace string")).first()
    assert (w.name, w.operation, json.loads(w.parameters)) == ("memory.write", "k", {"value_hash": canon.sha256_text("v")})
    m = admission.model_calls(spark.createDataFrame([("m", "p", "x")], "model string, prompt string, provider string"), redact=False).first()
    assert (m.name, m.step_kind, json.loads(m.parameters)["prompt"]) == ("m", "model_inference", "p")


def test_proof_and_trajectory_audit(spark):
    rows = [(f"r{i}", f"sha256:{i}", "d", "sha256:v", "2024-01-01T00:00:00.000Z", 0, 5, i) for i in range(5)]
    src = spark.createDataFrame(rows, "receipt_id string, fingerprint string, document_id string, document_version string, ingested_at string, chunk_offset int, chunk_length int, leaf_index long")
    leaves = src.select("leaf_index", F.encode(canon.row_payload(*index.SIGNED), "UTF-8").alias("payload"))
    tree = merkle.nodes(leaves)
    top = merkle.root(tree).first()
    src = src.join(merkle.proofs(tree, leaves), "leaf_index").withColumns({"tree_size": F.lit(top.tree_size), "tree_root": F.lit("sha256:" + top.tree_root)})
    src = src.withColumns({
        "chunk_offset": F.when(F.col("leaf_index") == 1, 9).otherwise(F.col("chunk_offset")),
        "proof": F.when(F.col("leaf_index") != 2, F.col("proof")),
        "tree_root": F.when(F.col("leaf_index") != 3, F.col("tree_root")),
    })
    proofs = audit.proof_audit(src)
    assert [r.proof_state for r in proofs.orderBy("leaf_index").collect()] == ["valid", "invalid", "skipped", "no_log", "valid"]
    raw = spark.createDataFrame([(f"r{i}", json.dumps({"receipt_id": f"r{i}"}), "t" if i != 4 else "u", [] if i in (0, 4) else [f"r{i - 1}"]) for i in range(5)], "receipt_id string, receipt string, trajectory_id string, parent_step_ids array<string>")
    signed = raw.withColumn("receipt", receipts.sign_json(F.col("receipt"), KEY)).withColumn("g", F.col("trajectory_id"))
    audited = audit.receipt_audit(signed, KEY, proofs)
    assert {r.receipt_id: r.ok for r in audited.collect()} == {"r0": True, "r1": False, "r2": True, "r3": False, "r4": True}
    assert {r.g: (r.ok, r.failed_checks) for r in audit.trajectory_audit(audited, "g").collect()} == {"t": (False, []), "u": (True, [])}
