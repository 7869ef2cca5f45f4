"""Receipts as structs and signed JSON.

Summaries and status are aggregates over exploded sources and actions. A receipt
is one nested row; its canonical JSON and signature come from an Arrow function
over the JSON text, as another party must get the same bytes.
"""

from __future__ import annotations

import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from veritrail.functions.canon import Secret, canonical_json, key_bytes, merged, text_hash

#: Fixed values of the receipt format.
SCHEMA_VERSION = "2.3.0"
ALGORITHM = "hmac-sha256"
ISSUER = "veritrail/0.1.0"


def status(any_blocked: Column, any_other: Column) -> Column:
    return F.when(any_blocked, "FAIL").when(any_other, "PARTIAL").otherwise("PASS")


def source_summary(sources: DataFrame, key: str, blocked: Column, *more: Column) -> DataFrame:
    """Counts per outcome and status of the sources of each receipt, and the aggregates ``more``; ``blocked`` is the verification gate alone."""
    counts = [F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("VERIFIED", "STALE", "UNAUTHORIZED", "UNVERIFIED", "TAMPERED")]
    out = sources.groupBy(key).agg(F.count("*").alias("total_chunks"), *counts, F.bool_or(blocked).alias("_b"), F.bool_or(F.col("outcome") != "VERIFIED").alias("_o"), *more)
    return out.withColumn("overall_status", status(F.col("_b"), F.col("_o"))).drop("_b", "_o")


def action_summary(actions: DataFrame, key: str, *more: Column) -> DataFrame:
    """Counts of decisions, and the aggregates ``more``; a null decision (no policy) is an allowed action."""
    denied = F.coalesce(F.col("decision") == "deny", F.lit(False))
    return actions.groupBy(key).agg(F.count("*").alias("total_actions"), F.count_if(~denied).alias("actions_allowed"), F.count_if(denied).alias("actions_denied"), *more)


def combined_status(sources: Column, denied: Column) -> Column:
    """FAIL over PARTIAL over PASS; a denied action fails the receipt, a missing side passes."""
    return F.when((denied > 0) | (sources == "FAIL"), "FAIL").otherwise(F.coalesce(sources, F.lit("PASS")))


def payload(receipt_json: str) -> bytes:
    """Canonical bytes that a signature covers: everything but the signature."""
    value = json.loads(receipt_json)
    value.pop("signature", None)
    return canonical_json(value).encode()


def _mac(raw: bytes, value: dict) -> str:
    """The signature of a receipt without its signature block."""
    return hmac.digest(raw, canonical_json(value).encode(), "sha256").hex()


def sign_json(receipt_json: Column, key: bytes | Secret) -> Column:
    """The receipt with its signature block, as canonical JSON."""

    @pandas_udf(StringType())
    def sign(s: pd.Series) -> pd.Series:
        raw = key_bytes(key)

        def one(text):
            value = json.loads(text)
            value.pop("signature", None)
            # each field is written once, for the signed bytes and for the receipt
            fields = {k: f"{canonical_json(k)}:{canonical_json(v)}" for k, v in value.items()}
            body = "{" + ",".join([fields[k] for k in sorted(fields)]) + "}"
            fields["signature"] = f'"signature":{{"algorithm":"{ALGORITHM}","value":"{hmac.digest(raw, body.encode(), "sha256").hex()}"}}'
            return "{" + ",".join([fields[k] for k in sorted(fields)]) + "}"

        return s.map(one, na_action="ignore")

    return sign(receipt_json)


def signature_state(receipt_json: Column, key: bytes | Secret) -> Column:
    """valid, invalid, unsigned or malformed; another algorithm is invalid."""

    @pandas_udf(StringType())
    def check(s: pd.Series) -> pd.Series:
        raw = key_bytes(key)

        def one(text):
            try:
                value = json.loads(text)
                signature = value.pop("signature", None)
            except (ValueError, AttributeError, TypeError):
                return "malformed"
            if not signature:
                return "unsigned"
            good = _mac(raw, value)
            same = isinstance(signature, dict) and signature.get("algorithm") == ALGORITHM and hmac.compare_digest(str(signature.get("value")), good)
            return "valid" if same else "invalid"

        return s.map(one, na_action="ignore")

    return check(receipt_json)


def audit(receipts: DataFrame, json_column: str, key: bytes | Secret, allow_unsigned: bool = False) -> DataFrame:
    """Add ``signature_state`` and ``ok``."""
    state = signature_state(F.col(json_column), key)
    good = ["valid", "unsigned"] if allow_unsigned else ["valid"]
    return receipts.withColumn("signature_state", state).withColumn("ok", F.coalesce(F.col("signature_state").isin(good), F.lit(False)))


def verification_receipts(verified: DataFrame, flags: dict[str, bool], issued_at: Column) -> DataFrame:
    """One receipt JSON per request from verified chunks (request_id, chunk_index, outcome, index columns)."""
    source = F.struct(
        "chunk_index", "fingerprint", "document_id", "document_version", "ingested_at", "chunk_offset", "chunk_length", "authorized",
        F.col("outcome").alias("verification_outcome"),
    )
    grouped = verified.groupBy("request_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    rid = F.concat(F.lit("prx_"), F.substring(F.sha2(F.col("request_id").cast("binary"), 256), 1, 32))
    block = F.struct(F.struct(*[F.lit(v).alias(k) for k, v in flags.items()]).alias("verification"))
    body = F.struct(rid.alias("receipt_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), issued_at.alias("issued_at"), F.lit(ISSUER).alias("issuer"), "sources", block.alias("policy"))
    return grouped.select("request_id", rid.alias("receipt_id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("receipt"))


KEPT = {"ignoreNullFields": "false"}


def _object(df: DataFrame, kept: tuple[str, ...], optional: tuple[str, ...]) -> Column:
    """JSON text with all ``kept`` fields, and those ``optional`` ones that are there and not null."""
    there = [c for c in optional if c in df.columns]
    first = F.to_json(F.struct(*kept), KEPT)
    return merged(first, F.to_json(F.struct(*there))) if there else first


def _listed(items: Column, field: str) -> Column:
    """JSON text of an array from the non-null texts of one field."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x[field]), ","), F.lit("]"))


def _decision(df: DataFrame, reference: Column, name: str) -> Column:
    """Decision record of a row, null where there is no decision; ``inputs`` is JSON text and null where redacted."""
    if "decision" not in df.columns:
        return F.lit(None).cast("string")
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    body = F.to_json(F.struct(reference.alias(name), "decision", F.coalesce("rules_fired", F.array().cast("array<string>")).alias("rules_fired"), have("inputs_hash").alias("inputs_hash")), KEPT)
    return F.when(F.col("decision").isNotNull(), F.concat(F.lit('{"inputs":'), F.coalesce(have("inputs"), F.lit("null")), F.lit(","), F.substring(body, 2, 2147483647)))


def _control(head: dict[str, str], decisions: Column) -> Column:
    named = "".join(f",{canonical_json(k)}:{canonical_json(v)}" for k, v in head.items())
    return F.concat(F.lit('{"decisions":'), F.coalesce(decisions, F.lit("[]")), F.lit(f"{named}}}"))


def full_receipts(heads: DataFrame, flags, sources: DataFrame | None = None, actions: DataFrame | None = None, access: dict[str, str] | None = None, tools: dict[str, str] | None = None) -> DataFrame:
    """Whole receipts (request_id, receipt_id, receipt): JSON text, ready to sign.

    ``heads`` has request_id, receipt_id, issued_at, and optionally output_text
    (only its hash is recorded), caller_hash, trajectory and transparency_log
    (structs; null fields are left out). ``sources`` has request_id, chunk_index,
    fingerprint, the index columns and outcome, and optionally
    normalization_applied, leaf_index, inclusion_proof, claims, content_source
    and a decision (decision, rules_fired, inputs_hash, inputs). ``actions`` has
    request_id, action_index, name, operation, parameters_hash, and optionally
    parameters (JSON text), target_system, invocation_id and a decision.
    ``access`` and ``tools`` name the policies (evaluator, policy_id,
    policy_version_hash); a block is there only where a policy is given. Claims
    are signed with the rest and never checked. A receipt gathers its own
    sources and actions, as it is one record; each side is one shuffle.
    """
    columns = ["request_id", "receipt_id", "issued_at"]
    have = lambda c: F.col(c) if c in heads.columns else F.lit(None).cast("string")
    empty = lambda t: F.array().cast(t)
    out = heads
    counts = ["total_chunks", "verified", "stale", "unauthorized", "unverified", "tampered"]
    if sources is not None:
        rows = sources.withColumn("verification_outcome", F.col("outcome"))
        rows = rows.withColumn("normalization_applied", F.coalesce("normalization_applied", empty("array<string>")) if "normalization_applied" in rows.columns else empty("array<string>"))
        item = _object(
            rows, ("chunk_index", "fingerprint", "document_id", "document_version", "ingested_at", "chunk_offset", "chunk_length", "authorized", "verification_outcome", "normalization_applied"),
            ("leaf_index", "inclusion_proof", "claims", "content_source"),
        )
        rows = rows.select("request_id", "chunk_index", "outcome", item.alias("item"), _decision(rows, F.col("fingerprint"), "chunk_fingerprint").alias("decided"))
        listed = F.array_sort(F.collect_list(F.struct("chunk_index", "item", "decided"))).alias("_s")
        out = out.join(source_summary(rows, "request_id", flags.blocks(F.col("outcome")), listed), "request_id", "left")
    else:
        out = out.withColumns({c: F.lit(0) for c in counts} | {"_s": empty("array<struct<item:string,decided:string>>"), "overall_status": F.lit(None).cast("string")})
    if actions is not None:
        item = _object(actions, ("action_index", "name", "operation", "parameters_hash"), ("target_system", "invocation_id"))
        parameters = F.coalesce("parameters", F.lit("null")) if "parameters" in actions.columns else F.lit("null")
        item = F.concat(F.lit('{"parameters":'), parameters, F.lit(","), F.substring(item, 2, 2147483647))
        rows = actions.select("request_id", "action_index", item.alias("item"), _decision(actions, F.col("action_index"), "action_index").alias("decided"), (F.col("decision") if "decision" in actions.columns else F.lit(None).cast("string")).alias("decision"))
        listed = F.array_sort(F.collect_list(F.struct("action_index", "item", "decided"))).alias("_a")
        out = out.join(action_summary(rows, "request_id", listed), "request_id", "left")
    else:
        none = F.lit(None).cast("long")
        out = out.withColumns({"_a": F.lit(None).cast("array<struct<item:string,decided:string>>"), "total_actions": none, "actions_allowed": none, "actions_denied": none})
    status_ = combined_status(F.col("overall_status"), F.coalesce("actions_denied", F.lit(0)))
    summary = merged(
        F.to_json(F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in counts], status_.alias("overall_status"))),
        F.to_json(F.struct("total_actions", "actions_allowed", "actions_denied")),
    )
    nested = {"verification": F.to_json(F.struct(*[F.lit(getattr(flags, k)).alias(k) for k in flags.__dataclass_fields__]))}
    if access:
        nested["access_control"] = _control(access, _listed(F.col("_s"), "decided"))
    if tools:
        nested["tool_call_control"] = _control(tools, _listed(F.col("_a"), "decided"))
    policy = F.concat(F.lit("{"), *[x for i, (k, v) in enumerate(nested.items()) for x in (F.lit(f'{"," if i else ""}"{k}":'), v)], F.lit("}"))
    block = lambda name, text: F.coalesce(F.concat(F.lit(f',"{name}":'), text), F.lit(""))
    json_of = lambda c: F.when(F.col(c).isNotNull(), F.to_json(c)) if c in heads.columns else F.lit(None).cast("string")
    head = F.to_json(F.struct("receipt_id", F.lit(SCHEMA_VERSION).alias("schema_version"), "issued_at", F.lit(ISSUER).alias("issuer"), have("caller_hash").alias("caller_hash"), F.struct(text_hash(have("output_text")).alias("hash"), F.lit("sha256").alias("hash_algorithm")).alias("output")))
    body = F.concat(
        head.substr(F.lit(1), F.length(head) - 1), F.lit(',"sources":'), F.coalesce(_listed(F.col("_s"), "item"), F.lit("[]")), F.lit(',"policy":'), policy, F.lit(',"summary":'), summary,
        block("actions", _listed(F.col("_a"), "item")), block("transparency_log", json_of("transparency_log")), block("trajectory", json_of("trajectory")), F.lit("}"),
    )
    return out.select(*columns[:2], body.alias("receipt"))
