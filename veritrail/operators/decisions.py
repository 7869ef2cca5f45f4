"""Inputs of policy decisions, their hashes, and the join of decisions to what they decide.

An inputs record is canonical JSON, so that another party who kept the same
values gets the same hash whether or not the receipt carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import canon


def request_block(caller_json: Column, jurisdiction: Column, purpose: Column, timestamp: Column) -> Column:
    """What a rule could read of a request, as canonical JSON; its session is left out. All but the caller are texts."""
    texts = {"jurisdiction": jurisdiction, "purpose": purpose, "timestamp": timestamp}
    return canon.object_of({"caller": F.coalesce(canon.canonical(caller_json), F.lit("{}"))} | {k: F.coalesce(canon.quoted(v), F.lit("null")) for k, v in texts.items()})


def with_default(object_json: Column, name: str, value: Column) -> Column:
    """The JSON object with a text field added, unless the field is there (even as null) or the value is null."""
    lacking = ~F.coalesce(F.array_contains(F.json_object_keys(object_json), name), F.lit(False))
    return F.when(lacking & value.isNotNull(), canon.merged(object_json, F.to_json(F.struct(value.alias(name))))).otherwise(object_json)


def chunk_inputs(metadata_json: Column, ingested_at: Column, content_source: Column, request: Column) -> Column:
    """Inputs of a chunk's decision; a null metadata is an empty object. ``metadata_json`` is an object as ``to_json`` writes it, ``request`` comes from :func:`request_block`."""
    meta = F.coalesce(metadata_json, F.lit("{}"))
    meta = with_default(with_default(meta, "ingested_at", ingested_at), "content_source", content_source)
    return canon.object_of({"chunk_metadata": canon.canonical(meta), "request_context": request})


def tool_inputs(name: Column, operation: Column, parameters_json: Column, request: Column, target_system: Column | None = None, invocation_id: Column | None = None) -> Column:
    """Inputs of a tool call's decision, always with its whole parameters; absent names of target and invocation are left out. ``request`` comes from :func:`request_block`."""
    # only what may come in any form is parsed; the rest is written around it
    fields = {k: F.coalesce(canon.quoted(v), F.lit("null")) for k, v in (("name", name), ("operation", operation))}
    fields |= {k: canon.quoted(v) for k, v in (("target_system", target_system), ("invocation_id", invocation_id)) if v is not None}
    fields["parameters"] = F.coalesce(canon.canonical(parameters_json), F.lit("{}"))
    return canon.object_of({"request_context": request, "tool_parameters": canon.object_of(fields)})


def inputs_hash(inputs: Column) -> Column:
    """Hash of an inputs record as the two functions above make it."""
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(inputs, "UTF-8"), 256))


def attach(rows: DataFrame, decided: DataFrame, on: list[str], order: str) -> DataFrame:
    """Left join of sources or actions with the last decision on each; null keys meet nothing."""
    rest = [c for c in decided.columns if c not in (*on, order)]
    last = decided.groupBy(*on).agg(F.max_by(F.struct(*rest), order).alias("_d")).select(*on, "_d.*")
    return rows.join(last, on, "left")
