"""Audits of receipts: signatures, inclusion proofs of their sources, and whole trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions import canon
from veritrail.operators import merkle, receipts, trajectory
from veritrail.operators.index import SIGNED


def proof_audit(sources: DataFrame) -> DataFrame:
    """Check each source's inclusion proof against its receipt's log.

    ``sources`` has receipt_id, the signed columns, leaf_index, proof (array of
    hex, null where there is none), tree_size and tree_root (null without a
    log). A source without a proof is skipped; a proof without a log fails.
    """
    leaf = merkle.leaf_hash(F.encode(canon.row_payload(*SIGNED), "UTF-8"))
    out = sources.withColumn("_leaf", leaf).withColumn("_root", F.regexp_replace("tree_root", "^sha256:", ""))
    holds = merkle.proof_holds("_leaf", "leaf_index", "proof", "tree_size", "_root")
    state = F.when(F.col("proof").isNull(), "skipped").when(F.col("tree_root").isNull(), "no_log").when(holds, "valid").otherwise("invalid")
    return out.withColumn("proof_state", state).drop("_leaf", "_root")


def receipt_audit(raw: DataFrame, key: bytes, proofs: DataFrame | None = None, allow_unsigned: bool = False) -> DataFrame:
    """One row per receipt (receipt_id, receipt as JSON text): signature_state, bad_proofs, ok."""
    out = receipts.audit(raw, "receipt", key, allow_unsigned)
    if proofs is None:
        return out.withColumn("bad_proofs", F.lit(0).cast("long"))
    bad = proofs.groupBy("receipt_id").agg(F.count_if(F.col("proof_state").isin("invalid", "no_log")).alias("bad_proofs"))
    out = out.join(bad, "receipt_id", "left").withColumn("bad_proofs", F.coalesce("bad_proofs", F.lit(0).cast("long")))
    return out.withColumn("ok", F.col("ok") & (F.col("bad_proofs") == 0))


def trajectory_audit(audited: DataFrame, group: str) -> DataFrame:
    """One row per group of receipts: whether all receipts and all graph checks are good, and what failed."""
    state = trajectory.graph_state(audited, group, {"receipts_ok": F.bool_and("ok"), "receipts": F.count("*")}).filter(F.col(group).isNotNull())
    failed = F.array_sort(F.transform(F.filter("checks", lambda c: ~c["ok"]), lambda c: c["check"]))
    return state.select(group, "receipts_ok", "receipts", failed.alias("failed_checks")).withColumn("ok", F.col("receipts_ok") & (F.size("failed_checks") == 0))
