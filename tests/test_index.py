import os
import random

import pytest
from pyspark.sql import functions as F

from veritrail.functions import text
from veritrail.operators import index
from veritrail.plans import catalog

EVENT = "seq long, kind string, fingerprint string, document_id string, document_version string, chunk_offset int, chunk_length int, ingested_at string, authorized boolean"
FP = {c: "sha256:" + c * 64 for c in "abcdef"}
KEY = b"secret"


def add(seq, fp, doc, version, authorized=True, offset=0):
    return (seq, "add", FP[fp], doc, FP[version], offset, 10, f"2024-01-01T00:00:{seq:02d}.000Z", authorized)


def log(spark, rows):
    return index.sign(spark.createDataFrame(rows, EVENT), KEY)


def outcomes(spark, events, fps):
    chunks = spark.createDataFrame([(FP[f],) for f in fps], "fingerprint string")
    got = {r.fingerprint[7]: r.outcome for r in index.verify(chunks, index.index_rows(events), KEY).collect()}
    return [got[f] for f in fps]


def test_outcomes_and_their_order(spark):
    events = log(spark, [add(1, "a", "d1", "b"), add(2, "c", "d1", "d"), add(3, "e", "d2", "e", authorized=False)])
    assert outcomes(spark, events, "acef") == ["STALE", "VERIFIED", "UNAUTHORIZED", "UNVERIFIED"]
    tampered = events.withColumn("chunk_offset", F.lit(9999))
    assert outcomes(spark, tampered, "ae") == ["TAMPERED", "TAMPERED"]


def test_back_to_an_old_version_stays_stale_and_add_authorizes_again(spark):
    events = log(spark, [add(1, "a", "d", "a"), add(2, "b", "d", "b"), add(3, "a", "d", "a"), (4, "set_authorization", None, "d", None, None, None, None, False), add(5, "c", "d", "a")])
    rows = {r.fingerprint[7]: r for r in index.index_rows(events).collect()}
    assert rows["a"].superseded and rows["b"].superseded and not rows["c"].superseded
    assert rows["a"].authorized and rows["a"].current_version == FP["a"]


def test_state_like_a_step_by_step_model(spark):
    rng = random.Random(4)
    rows, expect = [], {}
    for run in range(60):
        doc, stored, authorized, current = f"d{run}", {}, None, None
        for step in range(rng.randint(1, 9)):
            seq = run * 100 + step
            kind = rng.choice(["add", "add", "supersede", "set_authorization"])
            fp, v, yes = rng.choice("abc"), rng.choice("ab"), rng.random() < 0.5
            if kind == "add":
                rows.append((seq, kind, FP[fp], doc, FP[v], 0, 1, "2024-01-01T00:00:00.000Z", yes))
                for k in stored:
                    stored[k] |= k[1] != v
                stored.setdefault((fp, v), False)
                authorized, current = yes, v
            elif kind == "supersede":
                rows.append((seq, kind, None, doc, FP[v], None, None, None, None))
                for k in stored:
                    stored[k] |= k[1] != v
                current = v if current else None
            else:
                rows.append((seq, kind, None, doc, None, None, None, None, yes))
                authorized = yes if current else None
        expect |= {(doc, *k): (s, authorized, current) for k, s in stored.items()}
    got = {(r.document_id, r.fingerprint[7], r.document_version[7]): (r.superseded, r.authorized, r.current_version[7]) for r in index.index_rows(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == expect


def test_supersede_counts(spark):
    events = spark.createDataFrame([add(1, "a", "d", "a"), add(2, "b", "d", "a"), (3, "supersede", None, "d", FP["f"], None, None, None, None), (4, "supersede", None, "d", FP["e"], None, None, None, None)], EVENT)
    assert sorted((r.seq, r.marked) for r in index.superseded_counts(events).collect()) == [(3, 2), (4, 0)]


def test_rejected(spark):
    bad = [(1, "add", "md5:x", "d", FP["a"], 0, 1, "t", True), (2, "add", FP["a"], "d\nx", FP["a"], 0, 1, "t", True), (3, "add", FP["a"], None, FP["a"], 0, 1, "t", True), add(4, "a", "d", "a")]
    assert sorted(r.seq for r in index.rejected(spark.createDataFrame(bad, EVENT)).collect()) == [1, 2, 3]


@pytest.mark.parametrize("rows", [[], [add(1, "a", "d", "a")]])
def test_empty_sides(spark, rows):
    events = log(spark, rows)
    assert index.best_rows(index.index_rows(events)).count() == len(rows)


def test_parts_are_found_as_rows_are(spark):
    """Parts that move by rank alone give the outcomes of rows that move whole (F2): versions that come again, parts of many documents, chunks not there."""
    rng = random.Random(3)
    names = {c: "sha256:" + c * 64 for c in "0123456789abcdef"}
    rows = []
    for seq in range(0, 400, 2):
        doc, version = f"d{rng.randrange(12)}", names[rng.choice("abcdef")]
        rows.append((seq, "add", version, doc, version, 0, 10, f"2024-01-01T00:{rng.randrange(60):02d}:00.000Z", rng.random() < 0.8))
        if rng.random() < 0.2:
            rows.append((seq + 1, rng.choice(["supersede", "set_authorization"]), None, doc, names[rng.choice("abcdef")], None, None, None, rng.random() < 0.5))
    whole = spark.createDataFrame(rows, EVENT).withColumn("chunk_offset", F.coalesce("chunk_offset", F.lit(0)))
    pieces = [(r[0], names[rng.choice("0123456789")], rng.randrange(5), rng.randrange(1, 9)) for r in rows if r[1] == "add" for _ in range(3)]
    pieces = spark.createDataFrame(list({p[:3]: p for p in pieces}.values()), "seq long, part string, o int, n int")
    more = whole.filter("kind = 'add'").join(pieces, "seq").withColumns({"fingerprint": F.col("part"), "chunk_offset": F.col("o"), "chunk_length": F.col("n")}).select(*whole.columns)
    chunks = spark.createDataFrame([(i, f) for i, f in enumerate([*names.values(), "sha256:" + "e1" * 32])], "i int, fingerprint string")
    columns = ["i", "fingerprint", "document_id", "document_version", "chunk_offset", "chunk_length", "ingested_at", "authorized", "superseded"]
    want = chunks.join(index.best_rows(index.index_rows(whole.unionByName(more))), "fingerprint", "left").select(*columns)
    adds = index.ranked_adds(whole)
    at = index.with_version(adds).select("seq", "rank", "version", "chunk_offset", "chunk_length", "fingerprint")
    packed = at.unionByName(at.drop("fingerprint", "chunk_offset", "chunk_length").join(pieces, "seq").select("seq", "rank", "version", F.col("o").alias("chunk_offset"), F.col("n").alias("chunk_length"), F.col("part").alias("fingerprint")))
    packed = packed.withColumn("digest", text.packed(F.col("fingerprint"))).drop("fingerprint")
    got = index.found_parts(chunks.select("i", text.packed(F.col("fingerprint")).alias("digest")), index.best_parts(packed), adds).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sum(r.document_id is None for r in want.collect()) == 1


def test_windows_of_the_index_are_made_once(spark):
    """Texts are read for the windows and for the new cuts only (F2); rows, state and supersession read the written log."""
    data = os.environ.get("VERITRAIL_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    plan = catalog.QUERIES["rechunked_outcomes"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 2
