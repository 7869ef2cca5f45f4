"""Queries whose audits fail where something was forged, and admissions other than tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import canon
from veritrail.operators import admission, audit, index, merkle, policy, receipts, trajectory
from veritrail.plans import oracle as sql
from veritrail.plans.catalog import _LEAF_SQL, KEY, NOW, query
from veritrail.runtime import materialize
from veritrail.runtime import spread_table as table
from veritrail.sources import derived

# --- proofs ----------------------------------------------------------------


def _log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = index.stored_rows(index.sign(derived.ingest_log(spark, sf_dir), KEY))
    return materialize(merkle.numbered(stored, ["seq"]), "leaves")


@query(f"WITH {_LEAF_SQL} SELECT leaf_index, CASE leaf_index % 5 WHEN 1 THEN 'invalid' WHEN 2 THEN 'skipped' WHEN 3 THEN 'no_log' WHEN 4 THEN 'invalid' ELSE 'valid' END AS proof_state FROM leaf")
def forged_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every row, some with a sibling changed, without a proof, without a log, or for a row that was changed."""
    rows = _log_rows(spark, sf_dir)
    tree = materialize(merkle.nodes(rows.select("leaf_index", F.encode(canon.row_payload(*index.SIGNED), "UTF-8").alias("payload"))), "tree")
    proved = rows.join(merkle.proofs(tree, rows.select("leaf_index")), "leaf_index").crossJoin(F.broadcast(merkle.root(tree)))
    kind = F.col("leaf_index") % 5
    forged = F.transform("proof", lambda h, i: F.when(i == 0, F.sha2(h.cast("binary"), 256)).otherwise(h))
    spoilt = proved.withColumns({
        "proof": F.when(kind == 1, forged).when(kind != 2, F.col("proof")),
        "tree_root": F.when(kind != 3, F.concat(F.lit("sha256:"), "tree_root")),
        "chunk_length": F.when(kind == 4, F.col("chunk_length") + 1).otherwise(F.col("chunk_length")),
    })
    return audit.proof_audit(spoilt).select("leaf_index", "proof_state")


@query(
    f"""WITH {sql.LOG}, leaf AS (SELECT fingerprint, row_number() OVER (ORDER BY seq) - 1 AS leaf_index FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY fingerprint, document_id, document_version ORDER BY seq) = 1))
  SELECT fingerprint, max(leaf_index) AS leaf_index FROM leaf GROUP BY fingerprint"""
)
def latest_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.latest_leaf(_log_rows(spark, sf_dir))


# --- receipts and trajectories -----------------------------------------------


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signed receipt for every step; some changed after they were signed, some without signature, some no JSON."""
    steps = trajectory.linked_sessions(derived.calls(spark, sf_dir))
    body = F.to_json(F.struct("receipt_id", "issued_at", "step_kind", F.lit(receipts.ISSUER).alias("issuer")))
    signed = receipts.sign_json(body, KEY)
    kind = F.col("event_id") % 7
    text = F.when(kind == 1, F.replace(signed, F.lit('"issuer"'), F.lit('"issued_by"'))).when(kind == 2, body).when(kind == 3, F.concat(signed, F.lit("}"))).otherwise(signed)
    raw = steps.select("event_id", "trajectory_id", "receipt_id", "parent_step_ids", text.alias("receipt"))
    return materialize(audit.receipt_audit(raw, KEY).drop("receipt"), "audited")


_STATE = "CASE event_id % 7 WHEN 1 THEN 'invalid' WHEN 2 THEN 'unsigned' WHEN 3 THEN 'malformed' ELSE 'valid' END"


@query(f"SELECT event_id, {_STATE} AS signature_state, event_id % 7 NOT IN (1, 2, 3) AS ok FROM events")
def forged_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("event_id", "signature_state", "ok")


@query(
    f"""WITH {sql.STEPS} SELECT trajectory_id, bool_and(event_id % 7 NOT IN (1, 2, 3)) AS receipts_ok, count(*) AS receipts, '' AS failed_checks, bool_and(event_id % 7 NOT IN (1, 2, 3)) AS ok FROM steps GROUP BY trajectory_id"""
)
def trajectory_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.trajectory_audit(_audited(spark, sf_dir), "trajectory_id")
    return found.select("trajectory_id", "receipts_ok", "receipts", F.array_join("failed_checks", ",").alias("failed_checks"), "ok")


# --- admission of memory and models ------------------------------------------

MEMORY_POLICY = {
    "version": 1,
    "policy_id": "memory",
    "tool_call_control": {
        "rules": [
            {"name": "own_namespace", "when": {"tool.name": "memory.write"}, "require": {"tool.target_system": {"matches_pattern": "user*"}}, "on_violation": "deny"},
            {"name": "short_keys", "require": {"tool.operation": {"length_at_most": 9}}, "on_violation": "deny"},
        ]
    },
}


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, 'memory.write' AS name, conv_id || '-' || turn AS operation, role AS target_system, 'memory_write' AS step_kind, {sql.fp("'{\"value_hash\":\"' || " + sql.fp('text') + " || '\"}'")} AS parameters_hash FROM conversations
    UNION ALL SELECT conv_id, turn, role, 'model-' || conv_id % 3, 'inference', 'host', 'model_inference', {sql.fp("'{\"prompt_hash\":\"' || " + sql.fp('text') + " || '\"}'")} FROM conversations),
  d AS (SELECT *, name = 'memory.write' AS w0, NOT (target_system GLOB 'user*') AS v0, length(operation) > 9 AS v1 FROM c)
  SELECT conv_id, turn, name, operation, target_system, step_kind, parameters_hash, CASE WHEN w0 AND v0 OR v1 THEN 'deny' ELSE 'allow' END AS decision,
    array_to_string(list_filter([CASE WHEN w0 THEN 'own_namespace' END, CASE WHEN NOT (w0 AND v0) THEN 'short_keys' END], lambda r: r IS NOT NULL), ',') AS rules_fired FROM d"""
)
def memory_and_model_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a memory write in the namespace of its role, and as the prompt of a model; values are recorded as hashes only."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    writes = admission.memory_writes(turns.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("text").alias("value"), F.col("role").alias("namespace")))
    prompts = admission.model_calls(turns.select("conv_id", "turn", F.concat(F.lit("model-"), F.col("conv_id") % 3).alias("model"), F.col("text").alias("prompt"), F.lit("host").alias("provider")))
    columns = ("conv_id", "turn", "name", "operation", "target_system", "parameters", "step_kind")
    calls = writes.select(*columns).unionByName(prompts.select(*columns))
    bound = policy.map_binding({f"tool.{c}": (F.col(c), "string") for c in ("name", "operation", "target_system")}, {})
    admitted = admission.admit(calls, policy.load(MEMORY_POLICY).tool_call_control, bound, F.lit(NOW), redact=True)
    return admitted.select("conv_id", "turn", "name", "operation", "target_system", "step_kind", "parameters_hash", "decision", F.array_join("rules_fired", ",").alias("rules_fired"))
