"""Queries over what is kept between batches (index, log) and over whole policy documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import canon
from veritrail.operators import index, merkle, plugins, policy
from veritrail.plans import oracle as sql
from veritrail.plans.catalog import CHUNK_POLICY, KEY, NOW, ORACLES, TOOLS, _verified, query
from veritrail.runtime import materialize, scratch_dir
from veritrail.sources import derived, kept

GATED_POLICY = {
    "version": 1,
    "policy_id": "gated",
    "verification": {"block_stale": True, "block_unauthorized": False, "flag_unverified": False},
    "access_control": {"rules": [{"name": "residency", "require": {"chunk.residency": {"in": ["en", "de"]}}, "on_violation": "deny"}, *CHUNK_POLICY["access_control"]["rules"][1:2]]},
}


@query(
    f"""WITH {sql.VERIFIED} SELECT request_id, chunk_index, outcome NOT IN ('STALE', 'TAMPERED') AND coalesce(residency IN ('en', 'de'), false) AS admitted,
    outcome IN ('STALE', 'UNAUTHORIZED', 'TAMPERED') AS flagged, CASE WHEN outcome IN ('STALE', 'TAMPERED') THEN '' ELSE 'residency' END AS rules_fired FROM verified"""
)
def policy_document_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of one policy document on every retrieved chunk: its gate on outcomes, then its access rules."""
    p = policy.load(GATED_POLICY)
    v = _verified(spark, sf_dir, residency=True)
    meta = F.map_filter(F.create_map(F.lit("residency"), F.col("residency")), lambda _, x: x.isNotNull())
    bound = policy.map_binding({"request.purpose": (F.lit("search"), "string")}, {"chunk": meta})
    admitted, flagged, fired = p.admits(F.col("outcome"), bound, F.lit(NOW))
    return v.select("request_id", "chunk_index", admitted.alias("admitted"), flagged.alias("flagged"), F.array_join(fired, ",").alias("rules_fired"))


def _mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed log with supersede and set_authorization events between the adds, and adds that must be refused."""
    log = derived.signed_log(spark, sf_dir)
    plain = log.withColumn("seq", F.col("seq") * 4)
    newer = log.filter("seq % 10 = 3").withColumns({"seq": F.col("seq") * 4 + 1, "kind": F.lit("supersede"), "document_version": F.concat(F.lit("sha256:new-"), F.col("seq"))})
    sets = log.filter("seq % 10 = 7").withColumns({"seq": F.col("seq") * 4 + 2, "kind": F.lit("set_authorization"), "authorized": F.col("seq") % 20 == 7})
    refused = log.filter("seq % 10 = 5").withColumns({"seq": F.col("seq") * 4 + 3, "fingerprint": F.concat(F.lit("md5:"), F.col("fingerprint")), "authorized": F.lit(False)})
    return plain.unionByName(newer).unionByName(sets).unionByName(refused)


@query(
    f"""WITH {sql.LOG},
  ev AS (SELECT seq * 4 AS seq, 'add' AS kind, fingerprint, document_id, document_version, authorized FROM log
    UNION ALL SELECT seq * 4 + 1, 'supersede', fingerprint, document_id, 'sha256:new-' || seq, NULL FROM log WHERE seq % 10 = 3
    UNION ALL SELECT seq * 4 + 2, 'set_authorization', fingerprint, document_id, document_version, seq % 20 = 7 FROM log WHERE seq % 10 = 7),
  st AS (SELECT * FROM ev WHERE kind = 'add' QUALIFY row_number() OVER (PARTITION BY fingerprint, document_id, document_version ORDER BY seq) = 1),
  state AS (SELECT document_id, arg_max(authorized, seq) FILTER (WHERE kind <> 'supersede') AS authorized, arg_max(document_version, seq) FILTER (WHERE kind <> 'set_authorization') AS current_version FROM ev GROUP BY document_id)
  SELECT st.seq, st.document_id, st.document_version, state.authorized, state.current_version,
    EXISTS (SELECT 1 FROM ev e WHERE e.kind <> 'set_authorization' AND e.document_id = st.document_id AND e.document_version <> st.document_version AND e.seq > st.seq) AS superseded
  FROM st JOIN state ON state.document_id = st.document_id"""
)
def kept_index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index kept over three batches that meet in the same documents and come out of order."""
    store = kept.IndexStore(spark, scratch_dir(spark, "index"), buckets=16)
    log = _mixed_log(spark, sf_dir)
    for k in (2, 0, 1):
        store.ingest(log.filter(F.pmod("seq", F.lit(3)) == k))
    return store.rows().select("seq", "document_id", "document_version", "authorized", "current_version", "superseded")


@query(f"WITH {sql.VERIFIED} SELECT request_id, chunk_index, document_id, outcome FROM verified")
def kept_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved chunks against the best rows as they are kept, in buckets of fingerprints."""
    store = kept.IndexStore(spark, scratch_dir(spark, "index"), buckets=16)
    plain = derived.ingest_log(spark, sf_dir)
    log = derived.signed_log(spark, sf_dir, plain)
    middle = log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    store.ingest(log.filter(F.col("seq") <= middle))
    store.ingest(log.filter(F.col("seq") > middle))
    store.publish(max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = store.verify(derived.retrieved(spark, sf_dir, plain, residency=False), KEY)
    return found.select("request_id", "chunk_index", "document_id", "outcome")


def _kept_log(spark: SparkSession, sf_dir: str) -> kept.MerkleLog:
    """Stored rows appended to a log in three uneven batches."""
    stored = materialize(index.stored_rows(index.sign(derived.ingest_log(spark, sf_dir), KEY)), "stored")
    log = kept.MerkleLog(spark, scratch_dir(spark, "log"))
    a, b = stored.agg(F.expr("percentile_approx(seq, array(0.07D, 0.61D))")).first()[0] or (0, 0)
    for part in (F.col("seq") <= a, (F.col("seq") > a) & (F.col("seq") <= b), F.col("seq") > b):
        log.append(stored.filter(part).select("seq", "fingerprint", F.encode(canon.row_payload(*index.SIGNED), "UTF-8").alias("payload")), ["seq"])
    return log


@query(ORACLES["merkle_root"])
def kept_log_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of a log that was appended to, from its nodes."""
    return merkle.root(_kept_log(spark, sf_dir).tree())


@query(ORACLES["merkle_proofs"])
def kept_log_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _kept_log(spark, sf_dir)
    return log.proofs(log.entries().select("leaf_index"))


class _ToolRules:
    """The tool-call rules of the catalog, told in Python as a backend that knows nothing of Columns would."""

    evaluator_name, policy_id, policy_version_hash = "custom", "tools", TOOLS.version_hash

    def evaluate(self, inputs):
        out = []
        for r in inputs:
            tool, fired = r["tool"], ["known_tools"]
            broken = tool == "error"
            if not broken and tool in ("click", "purchase"):
                fired.append("no_round_users")
                broken = r["caller"][-1] in "05"
            if not broken and tool == "purchase":
                fired.append("short_amounts")
                broken = r["amount"] is not None and len(str(r["amount"])) > 2
            out.append(("deny" if broken else "allow", fired))
        return out


@query(ORACLES["tool_admission"])
def tool_admission_by_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of ``tool_admission`` from an evaluator of unknown make."""
    calls = derived.calls(spark, sf_dir).select("event_id", "receipt_id", "event_type", "caller", "amount")
    decided = plugins.evaluate(calls, _ToolRules, {"tool": F.col("event_type"), "caller": F.col("caller"), "amount": F.col("amount")})
    return decided.select("event_id", "receipt_id", "decision", F.array_join("rules_fired", ",").alias("rules_fired"))
