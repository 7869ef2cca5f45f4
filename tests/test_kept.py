"""What is kept between batches equals what all events at once would make."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from veritrail.operators import index, merkle
from veritrail.sources import kept

KEY = b"k"
COLUMNS = "seq long, kind string, fingerprint string, document_id string, document_version string, chunk_offset int, chunk_length int, ingested_at string, authorized boolean, signature string"


def events(n, seed=1, docs=12):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["add"] * 6 + ["supersede", "set_authorization"])
        fp = f"sha256:{rng.randrange(40)}" if rng.random() > 0.1 else f"md5:{i}"
        out.append((i, kind, fp, f"d{rng.randrange(docs)}", f"sha256:v{rng.randrange(3)}", i, 5, f"2031-01-{1 + i % 28:02d}T00:00:00.000Z", rng.random() > 0.3 if kind != "supersede" else None, "s"))
    return out


def rows(df):
    columns = sorted(df.columns)
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


def test_batches_equal_all_at_once(spark, tmp_path):
    log = events(300)
    store = kept.IndexStore(spark, str(tmp_path / "index"), buckets=8)
    shuffled = random.Random(2).sample(log, len(log))
    for part in (shuffled[:40], shuffled[40:200], shuffled[200:], shuffled[:10]):  # the last one repeats
        store.ingest(spark.createDataFrame(part, COLUMNS))
    want = index.index_rows(spark.createDataFrame(log, COLUMNS))
    assert rows(store.rows()) == rows(want) and store.rows().count() > 20
    again = kept.IndexStore(spark, str(tmp_path / "index"), buckets=99)
    assert again.buckets == 8 and rows(again.rows()) == rows(want)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    store = kept.IndexStore(spark, str(tmp_path / "index"), buckets=8)
    store.ingest(spark.createDataFrame(events(200, docs=30), COLUMNS))
    before, first = files(tmp_path), store.manifests.read()[1]["buckets"]
    one = [(1000, "add", "sha256:new", "d3", "sha256:v9", 0, 1, "2031-02-01T00:00:00.000Z", True, "s")]
    store.ingest(spark.createDataFrame(one, COLUMNS))
    after = store.manifests.read()[1]["buckets"]
    assert len([b for b in after if after[b] != first.get(b)]) == 1
    assert {f: t for f, t in files(tmp_path).items() if f in before} == before
    assert {r.document_id for r in store.rows().collect() if r.document_version == "sha256:v9"} == {"d3"}
    assert rows(store.rows(1)) != rows(store.rows())  # the older state can still be read
    assert store.vacuum(keep=2) == []
    store.ingest(spark.createDataFrame(events(200, docs=30), COLUMNS))  # every bucket anew
    want = rows(store.rows())
    assert len(store.vacuum()) == 2 and not set(before) & set(files(tmp_path))
    assert rows(store.rows()) == want and store.manifests.versions() == [3]


def test_two_batches_at_once(spark, tmp_path, monkeypatch):
    store, other = (kept.IndexStore(spark, str(tmp_path / "index"), buckets=4) for _ in range(2))
    log = events(60)
    read, once = store.manifests.read, []

    def slow(version=None):
        found = read(version)
        if not once:
            once.append(other.ingest(spark.createDataFrame(log[:30], COLUMNS)))
        return found

    monkeypatch.setattr(store.manifests, "read", slow)
    assert store.ingest(spark.createDataFrame(log[30:], COLUMNS)) == 2
    assert rows(store.rows()) == rows(index.index_rows(spark.createDataFrame(log, COLUMNS)))
    with pytest.raises(kept.Conflict):
        other.manifests.commit(2, {})


def test_lookups_move_their_probes_only(spark, tmp_path):
    store = kept.IndexStore(spark, str(tmp_path / "index"), buckets=4)
    store.ingest(spark.createDataFrame(events(200), COLUMNS))
    with pytest.raises(ValueError):
        store.best()
    store.publish(8)
    probes = spark.createDataFrame([(i, f"sha256:{i}") for i in range(60)], "i int, fingerprint string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = store.verify(probes, KEY)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = rows(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange ") == 1 and "Bucketed: true" in plan
    want = rows(index.verify(probes, store.rows(), KEY))
    assert got == want
    spark.catalog.dropTempView("none")
    for t in spark.catalog.listTables():
        if t.name.startswith("veritrail_best_"):
            spark.sql(f"DROP TABLE {t.name}")
    assert rows(kept.IndexStore(spark, str(tmp_path / "index")).verify(probes, KEY)) == want  # as a new session finds it


def test_columns_are_checked_and_empty_batches_are_fine(spark, tmp_path):
    store = kept.IndexStore(spark, str(tmp_path / "index"), buckets=4)
    with pytest.raises(ValueError):
        store.rows()
    store.ingest(spark.createDataFrame([], COLUMNS))
    assert store.rows().count() == 0
    store.ingest(spark.createDataFrame(events(20), COLUMNS))
    with pytest.raises(ValueError):
        store.ingest(spark.createDataFrame(events(5), COLUMNS).withColumn("more", F.lit(1)))


def plain_nodes(leaves):
    level, out, k = [hashlib.sha256(b"\x00" + x).digest() for x in leaves], [], 0
    while level:
        out += [(k, i, h) for i, h in enumerate(level)]
        if len(level) == 1:
            break
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        k += 1
    return out


def test_right_edge_for_every_size():
    for n in range(1, 70):
        nodes = {(k, i): h for k, i, h in plain_nodes([b"%d" % i for i in range(n)])}
        peaks = {k: nodes[k, (n >> k) - 1] for k in range(n.bit_length()) if n >> k & 1}
        whole = {(k, i): nodes[k, i] for k, i in nodes if (i + 1) << k <= n}
        assert whole | {(k, i): h for k, i, h in merkle.right_edge(n, peaks)} == nodes
        assert merkle.peaks_root(n, peaks) == nodes[max(nodes)]


@pytest.mark.parametrize("levels,batches", [(2, [1, 1, 3, 0, 7, 30]), (8, [5, 300, 1])])
def test_appends_equal_the_tree_from_scratch(spark, tmp_path, monkeypatch, levels, batches):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    log, n = kept.MerkleLog(spark, str(tmp_path / "log")), 0
    assert log.root() == (0, hashlib.sha256(b"").hexdigest()) and log.replays()
    for size in batches:
        df = spark.createDataFrame([(i, bytearray(b"%d" % i)) for i in range(n, n + size)], "i int, payload binary")
        n += size
        assert log.append(df.repartition(2), ["i"]) == n
    want = plain_nodes([b"%d" % i for i in range(n)])
    assert sorted((r.level, r.idx, bytes(r["hash"])) for r in log.tree().collect()) == sorted(want)
    assert log.root() == (n, max(want)[2].hex()) and log.replays()
    size, root = log.root()
    proofs = log.proofs(log.entries().select("leaf_index"))
    checked = log.entries().join(proofs, "leaf_index").withColumn("leaf", merkle.leaf_hash(F.col("payload")))
    held = checked.select(merkle.proof_holds("leaf", "leaf_index", "proof", f"{size}L", f"'{root}'")).collect()
    assert len(held) == n and all(r[0] for r in held)


def test_appends_make_nodes_on_the_right_edge_only(spark, tmp_path):
    log = kept.MerkleLog(spark, str(tmp_path / "log"))
    row = lambda a, b: spark.createDataFrame([(i, bytearray(b"%d" % i)) for i in range(a, b)], "i int, payload binary")
    log.append(row(0, 1000), ["i"])
    before = files(tmp_path)
    log.append(row(1000, 1003), ["i"])
    new = log.state()["in"][-1]
    made = spark.read.parquet(f"{tmp_path}/log/{new}/nodes")
    assert made.count() <= 3 + 3 and {f: t for f, t in files(tmp_path).items() if f in before} == before
    old = log.root(1)
    assert old[0] == 1000 and old != log.root()
    with pytest.raises(ValueError):
        log.append(row(0, 1).withColumn("more", F.lit(1)), ["i"])


def test_replay_finds_changed_entries(spark, tmp_path):
    log = kept.MerkleLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([(i, bytearray(b"%d" % i)) for i in range(20)], "i int, payload binary"), ["i"])
    assert log.replays()
    folder = f"{tmp_path}/log/{log.state()['in'][0]}/entries"
    forged = spark.read.parquet(folder).withColumn("payload", F.when(F.col("i") == 7, F.lit(bytearray(b"x"))).otherwise(F.col("payload"))).collect()
    spark.createDataFrame(forged, "i int, payload binary, leaf_index long").write.mode("overwrite").parquet(folder)
    assert not log.replays()
