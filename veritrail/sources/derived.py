"""Deterministic inputs derived from the given tables: ingest log, retrieved chunks, tool calls, receipts.

Only integer arithmetic and text functions, so that SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import text
from veritrail.functions.times import iso, micros_of_local
from veritrail.operators import index
from veritrail.runtime import materialize
from veritrail.runtime import spread_table as table
from veritrail.runtime import table as stored_table

#: A key for derived test data; production keys never stand in code.
TEST_KEY = b"veritrail-test-key"
#: Every so many documents, a row is changed after it was signed.
TAMPER_EVERY = 97


EPOCH_MS = 1704067200000


def ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One add per document, its whole text as one chunk; two versions per document_id.

    The log is written, as an index keeps it: rows, state and supersession each read it, and texts are hashed once.
    """
    # hashed before the join, so that no text moves
    docs = table(spark, sf_dir, "documents").select("doc_id", text.chunk_fingerprint(F.col("text")).alias("fingerprint"), F.length("text").alias("n"), "source")
    toxic = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    log = (
        docs.join(toxic, "doc_id", "left")
        .select(
            F.col("doc_id").alias("seq"),
            F.lit("add").alias("kind"),
            "fingerprint",
            F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 40).cast("long")).alias("document_id"),
            F.lit(0).alias("chunk_offset"),
            F.col("n").alias("chunk_length"),
            iso(F.lit(EPOCH_MS) + F.col("doc_id") * 1000).alias("ingested_at"),
            (F.coalesce("toxic", F.lit(0)) == 0).alias("authorized"),
        )
        .withColumn("document_version", F.col("fingerprint"))
    )
    return materialize(log, "log")


def signed(log: DataFrame) -> DataFrame:
    """Rows with signatures; some have their offset changed afterwards."""
    return index.sign(log, TEST_KEY).withColumn("chunk_offset", F.when(F.col("seq") % TAMPER_EVERY == 0, F.col("chunk_offset") + 1).otherwise(F.col("chunk_offset")))


def signed_log(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """The ingest log (as it is written, or anew), signed."""
    return signed(ingest_log(spark, sf_dir) if log is None else log)


def _window_rows(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """Columns of ``chunks`` (seq, fingerprint and others) for each sliding window of each text but the whole text, with digest, offset and part."""
    # texts meet their chunk before they are cut, so windows do not move
    docs = stored_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    met = docs.join(chunks.hint("shuffle_hash"), "seq").withColumn("t", text.normalize(F.col("text")))
    parts = text.parts(met, "t", keep=tuple(chunks.columns)).withColumn("digest", text.digest(F.col("part")))
    return parts.filter(F.col("digest") != text.packed(F.col("fingerprint")))


def window_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest log, signed, with an add for each sliding window of each text besides that of the whole text."""
    whole = ingest_log(spark, sf_dir)
    more = _window_rows(spark, sf_dir, whole).withColumns({"fingerprint": text.unpacked(F.col("digest")), "chunk_offset": F.col("offset"), "chunk_length": F.length("part")})
    return signed(whole.unionByName(more.select(*whole.columns)))


def window_parts(spark: SparkSession, sf_dir: str, adds: DataFrame) -> DataFrame:
    """As :func:`window_log`, unsigned, for ranked adds of the ingest log: digest, rank, version, seq, chunk_offset, chunk_length of texts and windows."""
    chunks = index.with_version(adds).select("seq", "rank", "version", "fingerprint", "chunk_offset", "chunk_length")
    rest = ["rank", "version", "seq"]
    windows = _window_rows(spark, sf_dir, chunks.select("fingerprint", *rest)).select("digest", *rest, F.col("offset").alias("chunk_offset"), F.length("part").alias("chunk_length"))
    return chunks.select(text.packed(F.col("fingerprint")).alias("digest"), *rest, "chunk_offset", "chunk_length").unionByName(windows)


def retrieved(spark: SparkSession, sf_dir: str, log: DataFrame | None = None, residency: bool = True) -> DataFrame:
    """Chunks that requests retrieved: all documents, benchmark items and conversation turns, eight a request.

    With the written ingest log, documents take their fingerprints from there, so that their texts are not read and
    hashed a second time, and no chunk has its text; ``residency`` then says whether that of documents is looked up.
    """
    parts = []
    for name, key, extra in (("documents", "doc_id", "lang"), ("benchmark", "item_id", "cast(null AS string)"), ("conversations", "conv_id * 100 + turn", "cast(null AS string)")):
        n = F.expr(key).cast("long")
        if log is not None and name == "documents":
            known = log.select(F.col("seq").alias("doc_id"), "fingerprint")
            t = known.join(table(spark, sf_dir, name).select("doc_id", "lang"), "doc_id") if residency else known.withColumn("lang", F.lit(None).cast("string"))
            fingerprint = F.col("fingerprint")
        else:
            t = table(spark, sf_dir, name)
            fingerprint = text.chunk_fingerprint(F.col("text"))
        body = [F.col("text")] if log is None else []
        parts.append(t.select(F.concat(F.lit(f"{name}-"), F.floor(n / 8).cast("long")).alias("request_id"), (n % 8).cast("int").alias("chunk_index"), F.lit(name).alias("origin"), n.alias("n"), F.expr(extra).alias("residency"), *body, fingerprint.alias("fingerprint")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool call per event; ``k`` is the parameter in its props."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(micros_of_local(F.col("ts"))))
    kinds = F.create_map(*[F.lit(x) for p in (("view", "retrieval"), ("click", "tool_call"), ("purchase", "memory_write"), ("signup", "model_inference"), ("error", "memory_read")) for x in p])
    return e.select(
        "event_id",
        "user_id",
        "ts",
        iso(F.unix_millis("ts")).alias("issued_at"),
        F.concat(F.lit("prx_"), F.substring(F.sha2(F.concat(F.lit("event-"), F.col("event_id")).cast("binary"), 256), 1, 32)).alias("receipt_id"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("caller"),
        "event_type",
        kinds[F.col("event_type")].alias("step_kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor(F.col("value")).cast("long").alias("amount"),
    )
