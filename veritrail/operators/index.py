"""The fingerprint index as a state derived from an ordered event log.

An event has ``seq``, ``kind`` (add, supersede or set_authorization),
``fingerprint``, ``document_id``, ``document_version``, ``chunk_offset``,
``chunk_length``, ``ingested_at`` and ``authorized``. Nothing is updated in place:
rows, document state and supersession are aggregates with map-side combine, so
neither a document nor a fingerprint with very many events is gathered anywhere;
``superseded_counts`` scans large documents in slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.canon import Secret, has_control, mac, row_payload
from veritrail.functions.times import instant
from veritrail.functions.text import unpacked
from veritrail.operators.merkle import numbered
from veritrail.operators.scan import sliced

SIGNED = ("fingerprint", "document_id", "document_version", "ingested_at", "chunk_offset", "chunk_length")
OUTCOMES = ("VERIFIED", "STALE", "UNAUTHORIZED", "UNVERIFIED", "TAMPERED")


def _refused() -> Column:
    """Whether an event is an add that the index must refuse: wrong prefix or a control character in a signed text."""
    bad = ~F.col("fingerprint").startswith("sha256:") | ~F.col("document_version").startswith("sha256:")
    for c in ("fingerprint", "document_id", "document_version", "ingested_at"):
        bad = bad | has_control(c)
    return (F.col("kind") == "add") & F.coalesce(bad, F.lit(True))


def rejected(events: DataFrame) -> DataFrame:
    """Add events that the index refuses."""
    return events.filter(_refused())


def accepted(events: DataFrame) -> DataFrame:
    """The events that take effect; refused adds change neither rows nor the state of their document."""
    return events.filter(~F.coalesce(_refused(), F.lit(False)))


def sign(rows: DataFrame, key: bytes | Secret) -> DataFrame:
    return rows.withColumn("signature", mac(row_payload(*SIGNED), key))


def stored_rows(events: DataFrame) -> DataFrame:
    """The first add of each (fingerprint, document, version); later ones are ignored."""
    keys = ["fingerprint", "document_id", "document_version"]
    rest = [c for c in events.columns if c not in (*keys, "kind", "seq", "authorized")]
    first = accepted(events).filter("kind = 'add'").groupBy(*keys).agg(F.min(F.struct("seq", *rest)).alias("x"))
    return first.select(*keys, "x.*")


def document_marks(events: DataFrame) -> DataFrame:
    """Per document: number of adds, last event that set the authorization, last event that named a version."""
    is_add, sets = F.col("kind") == "add", F.col("kind").isin("add", "set_authorization")
    return events.groupBy("document_id").agg(
        F.count_if(is_add).alias("adds"),
        F.max(F.when(sets, F.struct("seq", "authorized"))).alias("a"),
        F.max(F.when(F.col("kind").isin("add", "supersede"), F.struct("seq", "document_version"))).alias("v"),
    )


def merged_documents(marks: DataFrame) -> DataFrame:
    """One row per document from :func:`document_marks` of several batches."""
    return marks.groupBy("document_id").agg(F.sum("adds").alias("adds"), F.max("a").alias("a"), F.max("v").alias("v"))


def settled(marks: DataFrame) -> DataFrame:
    """Authorization and current version of each document that has an add."""
    return marks.filter("adds > 0").select("document_id", F.col("a.authorized").alias("authorized"), F.col("v.document_version").alias("current_version"))


def document_state(events: DataFrame) -> DataFrame:
    """Authorization and current version of each document that has an add: the last event of the kind decides."""
    return settled(document_marks(events))


def version_marks(events: DataFrame) -> DataFrame:
    """The last add or supersede that named each version of a document."""
    return events.filter("kind IN ('add', 'supersede')").groupBy("document_id", "document_version").agg(F.max("seq").alias("m"))


def merged_marks(marks: DataFrame) -> DataFrame:
    """One row per version from :func:`version_marks` of several batches."""
    return marks.groupBy("document_id", "document_version").agg(F.max("m").alias("m"))


def superseded_by(rows: DataFrame, last: DataFrame) -> DataFrame:
    """Add ``superseded`` to stored rows: a later add or supersede of the document named another version.

    It is enough to know the version with the last such event of a document
    (``last`` has them all), and when the last event with any other version was.
    """
    top = last.groupBy("document_id").agg(F.max(F.struct("m", "document_version")).alias("top")).select("document_id", F.col("top.m").alias("m1"), F.col("top.document_version").alias("v1"))
    other = last.join(top, "document_id").filter("document_version <> v1").groupBy("document_id").agg(F.max("m").alias("m2"))
    marks = top.join(other, "document_id", "left")
    later = F.when(F.col("document_version") != F.col("v1"), F.col("m1")).otherwise(F.col("m2"))
    return rows.join(marks, "document_id").withColumn("superseded", F.coalesce(later > F.col("seq"), F.lit(False))).drop("m1", "v1", "m2")


def with_supersession(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``superseded`` from the events themselves."""
    return superseded_by(rows, version_marks(events))


def index_rows(events: DataFrame) -> DataFrame:
    """Stored rows with supersession and the state of their document."""
    events = accepted(events)
    return with_supersession(stored_rows(events), events).join(document_state(events), "document_id")


def best_rows(index: DataFrame) -> DataFrame:
    """One row per fingerprint: not superseded first, then newest, then least document and version."""
    order = F.struct("superseded", (-F.unix_millis(instant(F.col("ingested_at")))).alias("age"), "document_id", "document_version")
    rest = [c for c in index.columns if c not in ("fingerprint", "superseded", "document_id", "document_version")]
    best = index.groupBy("fingerprint").agg(F.min(F.struct(order.alias("o"), F.struct(*rest).alias("r"))).alias("x"))
    return best.select("fingerprint", "x.o.superseded", "x.o.document_id", "x.o.document_version", "x.r.*")


def outcome(key: bytes | Secret) -> Column:
    """Outcome of a chunk joined with its best row; the first that applies counts."""
    genuine = mac(row_payload(*SIGNED), key) == F.col("signature")
    return (
        F.when(F.col("document_id").isNull(), "UNVERIFIED")
        .when(~F.coalesce(genuine, F.lit(False)), "TAMPERED")
        .when(~F.col("authorized"), "UNAUTHORIZED")
        .when(F.col("superseded"), "STALE")
        .otherwise("VERIFIED")
    )


def verify(chunks: DataFrame, index: DataFrame, key: bytes | Secret) -> DataFrame:
    """Left join of chunks (with ``fingerprint``) and best rows; a chunk that is not found is unverified."""
    return verify_best(chunks, best_rows(index), key)


def verify_best(chunks: DataFrame, best: DataFrame, key: bytes | Secret) -> DataFrame:
    """As :func:`verify`, with the best rows as they are kept."""
    return chunks.join(best, "fingerprint", "left").withColumn("outcome", outcome(key))


def ranked_adds(events: DataFrame) -> DataFrame:
    """Every accepted add with supersession, the state of its document, and ``rank``, its place in the order of :func:`best_rows`.

    For chunks with many parts (sliding windows) in the index: these share all but digest, offset and length with their
    chunk, so they move with the rank alone and meet the rest where a part was found (:func:`best_parts`, :func:`found_parts`).
    """
    events = accepted(events)
    rows = with_supersession(events.filter("kind = 'add'").drop("authorized"), events).join(document_state(events), "document_id")
    rows = rows.withColumn("_age", -F.unix_millis(instant(F.col("ingested_at"))))
    return numbered(rows, ["superseded", "_age", "document_id", "document_version", "seq"], "rank").drop("_age")


def with_version(adds: DataFrame) -> DataFrame:
    """Add ``version``, one number for all adds of a document's version, to ranked adds."""
    one = adds.groupBy("document_id", "document_version").agg(F.min("rank").alias("version"))
    return adds.join(one, ["document_id", "document_version"])


def best_parts(parts: DataFrame) -> DataFrame:
    """One row per digest (rank, chunk_offset, chunk_length) from parts with digest, rank, version, seq, chunk_offset, chunk_length.

    As :func:`stored_rows` and :func:`best_rows`: the first add of a digest in each version of a document counts, and of those the least rank.
    """
    first = parts.groupBy("digest", "version").agg(F.min(F.struct("seq", "chunk_offset", "chunk_length", "rank")).alias("x"))
    return first.groupBy("digest").agg(F.min(F.struct("x.rank", "x.chunk_offset", "x.chunk_length")).alias("x")).select("digest", "x.*")


def found_parts(chunks: DataFrame, best: DataFrame, adds: DataFrame) -> DataFrame:
    """Chunks (with ``digest``) with fingerprint and the columns of their best row, null where there is none."""
    # chunks that are not found are dealt to all tasks by negative numbers, which no rank is
    met = chunks.join(best, "digest", "left").withColumn("rank", F.coalesce("rank", -1 - F.abs(F.hash("digest")).cast("long")))
    return met.join(adds.drop("fingerprint", "chunk_offset", "chunk_length"), "rank", "left").withColumn("fingerprint", unpacked(F.col("digest"))).drop("digest", "rank")


def verify_memory(chunks: DataFrame, index: DataFrame, key: bytes | Secret) -> DataFrame:
    """Verify entries of a memory store. ``step_kind`` and ``content_source`` of a row win over the defaults."""
    found = verify(chunks, index, key)
    for name, default in (("step_kind", "memory_read"), ("content_source", "memory_store")):
        found = found.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in chunks.columns else F.lit(default))
    return found


def ingest_counts(events: DataFrame) -> DataFrame:
    """Chunks and fingerprints that were sent in for each document: attempts, whether or not a row was stored.

    ``whole`` marks the add of a chunk itself, as against those of its windows.
    """
    adds = events.filter("kind = 'add'").groupBy("document_id")
    return adds.agg(F.count("*").alias("fingerprint_count"), F.count_if("whole").alias("chunk_count"))


def superseded_counts(events: DataFrame) -> DataFrame:
    """For each supersede event, the stored rows that it newly marks."""
    # The first event after a row that names another version: runs of events that name one version are numbered
    # by their place, so a row needs the start of the next run only, not a meeting with every event.
    # Documents are scanned in slices, forwards for the event before and backwards for the run after.
    key, forward = ["document_id"], [F.col("seq")]
    marks = events.filter("kind IN ('add', 'supersede')").select("document_id", "seq", "document_version").distinct()
    before = sliced(marks, key, forward).scan(key, forward, previous={"_before": ["document_version"]}).rows
    starts = before.filter("_before IS NULL OR _before.document_version <> document_version").select("document_id", "seq")
    runs = sliced(starts, key, [F.col("seq").desc()]).scan(key, [F.col("seq").desc()], previous={"_after": ["seq"]}).rows.select("document_id", "seq", F.col("_after.seq").alias("at"))
    both = runs.withColumn("_row", F.lit(0)).unionByName(stored_rows(events).select("document_id", "seq", F.lit(None).cast("long").alias("at"), F.lit(1).alias("_row")))
    inside = [F.col("seq"), F.col("_row")]
    first = sliced(both, key, inside).scan(key, inside, latest={"_last": F.when(F.col("_row") == 0, F.struct("at"))}).rows.filter("_row = 1 AND _last.at IS NOT NULL").select("document_id", F.col("_last.at").alias("at"))
    return events.filter("kind = 'supersede'").select("document_id", F.col("seq").alias("at"), "document_version").join(first.groupBy("document_id", "at").agg(F.count("*").alias("marked")), ["document_id", "at"], "left").select("document_id", F.col("at").alias("seq"), F.coalesce("marked", F.lit(0)).alias("marked"))
