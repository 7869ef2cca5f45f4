"""Security events from receipts (O1-O7): one row per source and per action.

The numbers, names and codes below are fixed values of the event format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.times import instant

#: class, name, category, category name, activity, activity name
CLASSES = {
    "source_allowed": (6005, "Application Activity", 6, "Application Activity", 1, "Access"),
    "action_allowed": (6003, "API Activity", 6, "Application Activity", 1, "Create"),
    "source_blocked": (2004, "Detection Finding", 2, "Findings", 1, "Create"),
    "action_denied": (2004, "Detection Finding", 2, "Findings", 1, "Create"),
}
SEVERITIES = {1: "Informational", 3: "Medium", 4: "High", 5: "Critical"}
VERSION = "1.3.0"
VENDOR = "Veritrail"
CODES = {"source_allowed": "verification.allow", "action_allowed": "admission.allow", "source_blocked": "verification.block", "action_denied": "admission.deny"}
FAILED = ("TAMPERED", "UNAUTHORIZED", "UNVERIFIED", "STALE")


def _pick(kind: Column, part: int) -> Column:
    out = None
    for name, values in CLASSES.items():
        out = (F if out is None else out).when(kind == name, F.lit(values[part]))
    return out


def blocked(outcome: Column, gate: Column, decision: Column) -> Column:
    """A source is blocked by the verification gate or by an access decision."""
    return F.coalesce((outcome != "VERIFIED") & gate, F.lit(False)) | F.coalesce(decision == "deny", F.lit(False))


def source_kind(outcome: Column, gate: Column, decision: Column) -> Column:
    return F.when(blocked(outcome, gate, decision), "source_blocked").otherwise("source_allowed")


def action_kind(decision: Column) -> Column:
    return F.when(F.coalesce(decision == "deny", F.lit(False)), "action_denied").otherwise("action_allowed")


def severity(kind: Column, outcome: Column, decision: Column) -> Column:
    """A blocked source is critical for any outcome but VERIFIED, even where only the policy denied it."""
    source = F.when(outcome.isin(*FAILED), 5).when(decision == "deny", 4).otherwise(3)
    return F.when(kind == "source_blocked", source).when(kind == "action_denied", 4).otherwise(1)


def title(kind: Column, outcome: Column, decision: Column, rules: Column) -> Column:
    named = lambda head: F.concat(F.lit(head), F.when(F.size(rules) > 0, F.concat(F.lit("; rules: "), F.array_join(rules, ", "))).otherwise(""))
    source = (
        F.when(outcome.isin(*FAILED), F.concat(F.lit("Verification block: "), outcome))
        .when(decision == "deny", named("Access control denied chunk"))
        .otherwise("Source blocked (unspecified)")
    )
    return F.when(kind == "source_blocked", source).when(kind == "action_denied", named("Tool-call admission denied"))


def skeleton(df: DataFrame) -> DataFrame:
    """Add the columns that all events share to rows with kind, severity_id, receipt_id, issued_at, trajectory_id, session_id, step_kind, caller_hash."""
    kind = F.col("kind")
    names = None
    for k, v in SEVERITIES.items():
        names = (F if names is None else names).when(F.col("severity_id") == k, v)
    return df.withColumns(
        {
            "class_uid": _pick(kind, 0),
            "class_name": _pick(kind, 1),
            "category_uid": _pick(kind, 2),
            "category_name": _pick(kind, 3),
            "activity_id": _pick(kind, 4),
            "activity_name": _pick(kind, 5),
            "type_uid": _pick(kind, 0) * 100 + _pick(kind, 4),
            "severity": names,
            "time": F.unix_millis(instant(F.col("issued_at"))),
            "correlation_uid": F.col("trajectory_id"),
            "version": F.lit(VERSION),
        }
    )


#: Columns that ``blocks`` reads; those that a table lacks count as null.
READ = {
    "issuer": "string", "schema_version": "string", "trajectory_id": "string", "session_id": "string", "step_kind": "string", "agent_id": "string", "caller_hash": "string",
    "document_id": "string", "fingerprint": "string", "document_version": "string", "content_source": "string", "outcome": "string",
    "name": "string", "operation": "string", "target_system": "string", "parameters_hash": "string",
    "decision": "string", "rules_fired": "array<string>", "inputs_hash": "string", "policy_id": "string", "policy_version_hash": "string",
}


def _entry(key: str, value: Column, when: Column | None = None) -> Column:
    there = value.isNotNull() & (value != "")
    return F.when(there if when is None else there & when, F.concat(F.lit(f"{key}:"), value))


def labels(kind: Column, outcome: Column, step_kind: Column, decision: Column, rules: Column, inputs_hash: Column) -> Column:
    """Labels of an event in their order; an allowed call names its rules before and after the hash of its inputs."""
    named = F.array_join(F.coalesce(rules, F.array().cast("array<string>")), ",")
    allowed_source, allowed_call = kind == "source_allowed", kind == "action_allowed"
    by_policy = (kind == "action_denied") | ((kind == "source_blocked") & ~F.coalesce(outcome.isin(*FAILED), F.lit(False)) & F.coalesce(decision == "deny", F.lit(False)))
    return F.array_compact(
        F.array(
            _entry("step_kind", step_kind),
            _entry("verification_outcome", outcome, kind.isin("source_allowed", "source_blocked")),
            _entry("rules_fired", named, allowed_call | by_policy),
            _entry("inputs_hash", inputs_hash, allowed_source | allowed_call),
            _entry("rules_fired", named, allowed_source | allowed_call),
        )
    )


def blocks(df: DataFrame, correlate: bool = True, extra: dict[str, str] | None = None) -> DataFrame:
    """Add metadata, actor, resource, api and finding_info to rows as ``skeleton`` takes them.

    ``extra`` are fixed texts for the metadata, whose own names it must not repeat.
    Parts that an event lacks are null: a source has no api, an allowed event no finding.
    """
    missing = {c: F.lit(None).cast(t) for c, t in READ.items() if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    c = F.col
    kind, is_source = c("kind"), c("kind").isin("source_allowed", "source_blocked")
    filled = lambda x: F.when(x != "", x)
    pick = None
    for k, v in CODES.items():
        pick = (F if pick is None else pick).when(kind == k, v)
    issuer = F.split(F.coalesce("issuer", F.lit("")), "/", 2)
    feature = F.when(filled(c("schema_version")).isNotNull(), F.struct(F.lit("receipt").alias("name"), c("schema_version").alias("version")))
    product = F.struct(F.coalesce(filled(F.get(issuer, F.lit(0))), F.lit("veritrail")).alias("name"), F.coalesce(F.get(issuer, F.lit(1)), F.lit("")).alias("version"), F.lit(VENDOR).alias("vendor_name"), feature.alias("feature"))
    metadata = F.struct(
        c("receipt_id").alias("uid"), pick.alias("event_code"), F.lit(VERSION).alias("version"), product.alias("product"),
        labels(kind, c("outcome"), c("step_kind"), c("decision"), c("rules_fired"), c("inputs_hash")).alias("labels"),
        (filled(c("trajectory_id")) if correlate else F.lit(None).cast("string")).alias("correlation_uid"), filled(c("session_id")).alias("session_uid"),
        filled(c("policy_id")).alias("policy_uid"), filled(c("policy_version_hash")).alias("policy_uid_alt"), *[F.lit(v).alias(k) for k, v in (extra or {}).items()],
    )
    user = F.when(filled(c("caller_hash")).isNotNull(), F.struct(c("caller_hash").alias("uid"), F.lit(1).alias("type_id")))
    process = F.when(filled(c("agent_id")).isNotNull(), F.struct(c("agent_id").alias("name")))
    data = F.struct("fingerprint", filled(c("document_version")).alias("document_version"), filled(c("content_source")).alias("content_source"))
    resource = F.struct(F.coalesce(filled(c("document_id")), c("fingerprint"), F.lit("")).alias("uid"), F.lit("document_chunk").alias("type"), data.alias("data"))
    service = F.struct(F.coalesce("name", F.lit("")).alias("name"), F.when(filled(c("target_system")).isNotNull(), F.array(F.concat(F.lit("target_system:"), "target_system"))).alias("labels"))
    api = F.struct("operation", service.alias("service"), F.struct(c("parameters_hash").alias("uid")).alias("request"))
    by_outcome, denied = c("outcome").isin(*FAILED), c("decision") == "deny"
    found = F.when(kind == "action_denied", "ADMISSION_DENY").when(by_outcome, c("outcome")).when(denied, "ACCESS_CONTROL_DENY").otherwise(F.coalesce(filled(c("outcome")), F.lit("UNKNOWN")))
    ref = lambda x, t: F.when(filled(x).isNotNull(), F.struct(x.alias("uid"), F.lit(t).alias("type")))
    related = F.array_compact(F.array(ref(c("inputs_hash"), "policy_inputs_hash"), F.when(kind == "action_denied", ref(c("parameters_hash"), "action_parameters_hash"))))
    info = F.struct(c("receipt_id").alias("uid"), title(kind, c("outcome"), c("decision"), c("rules_fired")).alias("title"), F.array(found).alias("types"), F.when(F.size(related) > 0, related).alias("related_events"))
    return df.withColumns(
        {
            "metadata": metadata,
            "actor": F.struct(user.alias("user"), process.alias("process")),
            "resources": F.when(is_source, F.array(resource)),
            "api": F.when(~is_source, api),
            "finding_info": F.when(kind.isin("source_blocked", "action_denied"), info),
            "status_id": F.lit(1),
            "status": F.lit("Success"),
            "time_dt": c("issued_at"),
        }
    )
