"""Admission of tool calls, memory writes and model calls as action records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import canon
from veritrail.operators.policy import Binding, Bundle


class AdmissionDenied(Exception):
    """Raised by :func:`enforce` for the first denied calls."""


def admit(calls: DataFrame, bundle: Bundle | None, binding: Binding, now: Column, redact: bool = False) -> DataFrame:
    """Add decision, rules_fired, parameters_hash, and the recorded parameters (null if redacted).

    ``calls`` has name, operation and parameters (JSON text of an object). The
    hash covers the parameters whether or not they are recorded. Without a
    bundle every call is allowed and no rule fires.
    """
    decision, fired = bundle.compile(binding, now) if bundle else (F.lit("allow"), F.array().cast("array<string>"))
    out = calls.withColumns({"decision": decision, "rules_fired": fired, "parameters_hash": canon.json_hash(F.coalesce("parameters", F.lit("{}")))})
    if redact:
        out = out.withColumn("parameters", F.lit(None).cast("string"))
    return out.withColumn("step_kind", F.coalesce("step_kind", F.lit("tool_call")) if "step_kind" in calls.columns else F.lit("tool_call"))


def memory_writes(writes: DataFrame, redact: bool = True) -> DataFrame:
    """Memory writes (key, value, namespace) as tool calls named memory.write; the value is a hash unless recorded."""
    value = F.struct(canon.text_hash(F.col("value")).alias("value_hash"), *([] if redact else ["value"]))
    return writes.withColumns({"name": F.lit("memory.write"), "operation": F.col("key"), "target_system": F.col("namespace"), "parameters": F.to_json(value), "step_kind": F.lit("memory_write")})


def model_calls(prompts: DataFrame, redact: bool = True) -> DataFrame:
    """Model calls (model, prompt, provider) as tool calls named after the model; the prompt is a hash unless recorded."""
    prompt = F.struct(canon.text_hash(F.col("prompt")).alias("prompt_hash"), *([] if redact else ["prompt"]))
    return prompts.withColumns({"name": F.col("model"), "operation": F.lit("inference"), "target_system": F.col("provider"), "parameters": F.to_json(prompt), "step_kind": F.lit("model_inference")})


def actions(admitted: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Action records of each receipt, numbered from 0 in the given order."""
    record = F.struct(*order, "name", "operation", "parameters_hash", "parameters", "decision", "rules_fired")
    grouped = admitted.groupBy(key).agg(F.array_sort(F.collect_list(record)).alias("x"))
    return grouped.select(
        key,
        F.transform("x", lambda a, i: F.struct(i.alias("action_index"), *[a[c].alias(c) for c in ("name", "operation", "parameters_hash", "parameters", "decision", "rules_fired")])).alias("actions"),
    )


def enforce(admitted: DataFrame, show: int = 5) -> DataFrame:
    """The calls, if all are allowed; otherwise an error that names a few of those denied. For driver code only."""
    denied = admitted.filter("decision = 'deny'").select("name", "rules_fired").take(show)
    if denied:
        raise AdmissionDenied("; ".join(f"{r.name}: {', '.join(r.rules_fired)}" for r in denied))
    return admitted


def split(admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Allowed and denied calls."""
    return admitted.filter("decision = 'allow'"), admitted.filter("decision = 'deny'")
