"""Data that stays between batches: an index in buckets of documents and a Merkle log, each behind numbered manifests.

A batch writes files of its own and then a manifest that names all files that
count from there on. A manifest is renamed into place and never replaced, so a
reader sees one state whole, a batch that dies leaves nothing that counts, and of
two batches at once the later one starts again from what the other left.
Files of older states stay until :meth:`Manifests.vacuum`.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.functions.canon import Secret
from veritrail.operators import index, merkle
from veritrail.runtime import discard, materialize


class Conflict(RuntimeError):
    """Another batch took the next number."""


class Manifests:
    """Numbered states of a folder, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop(self.path).getFileSystem(self._conf)

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder below this one; nothing where it does not exist."""
        at = self._hadoop(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("_manifests") if n.endswith(".json")]

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """The number and content of a state, the newest by default; 0 and {} before the first."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return 0, {}
        stream = self._fs.open(self._hadoop(f"{self.path}/_manifests/{version:012d}.json"))
        try:
            return version, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, content: dict) -> None:
        """Make ``content`` the state ``version``; :class:`Conflict` where there is one of that number already."""
        new = self._hadoop(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(new, False)
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(self._conf).getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(new, self._hadoop(f"{self.path}/_manifests/{version:012d}.json"), options)
        except Exception as e:  # py4j gives Java errors one class
            self._fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"state {version} of {self.path} exists") from None
            raise

    def folder(self, version: int) -> str:
        """A name for the files of one attempt at a batch."""
        return f"g{version:012d}-{uuid.uuid4().hex[:12]}"

    def vacuum(self, used, keep: int = 1) -> list[str]:
        """Delete folders that none of the last ``keep`` states use (``used`` names those of a state), and older manifests."""
        versions = self.versions()
        live = {f for v in versions[-keep:] for f in used(self.read(v)[1])}
        gone = [n for n in self.names("") if n.startswith("g") and n not in live]
        for n in gone:
            self._fs.delete(self._hadoop(f"{self.path}/{n}"), True)
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/_manifests/{v:012d}.json"), False)
        return gone


def _bucket(n: int):
    return F.pmod(F.xxhash64("document_id"), F.lit(n)).cast("int")


class IndexStore:
    """The fingerprint index, kept: an ingest batch reads and rewrites the buckets of the documents it names, no others.

    Each bucket of documents has rows (with supersession and the document's state already in them), the last event of
    each version and the state of each document. These are minima and maxima over events, so batches may come in any
    order, may repeat, and may hold events older than those before. ``publish`` writes the best row of each fingerprint,
    bucketed by fingerprint, for lookups that move only their probes.
    """

    TABLES = ("rows", "marks", "docs")

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.manifests = spark, Manifests(spark, path)
        self.buckets = self.manifests.read()[1].get("n", buckets)

    def _read(self, state: dict, table: str, buckets=None) -> DataFrame | None:
        paths = [f"{self.manifests.path}/{at['in']}/{table}/bucket={b}" for b, at in state.get("buckets", {}).items() if table in at["tables"] and (buckets is None or int(b) in buckets)]
        schema = state.get("schemas", {}).get(table)
        return self.spark.read.schema(T.StructType.fromJson(schema)).parquet(*paths) if paths else None

    def ingest(self, events: DataFrame, attempts: int = 3) -> int:
        """Add a batch of events; the number of the new state. A batch that meets another one starts again on its result."""
        for left in reversed(range(attempts)):
            try:
                return self._ingest(events)
            except Conflict:
                if not left:
                    raise
        raise ValueError("attempts must be positive")

    def _ingest(self, events: DataFrame) -> int:
        version, state = self.manifests.read()
        batch = index.accepted(events)
        touched = {r[0] for r in batch.select(_bucket(self.buckets)).distinct().collect()}  # at most one row a bucket
        old = {t: self._read(state, t, touched) for t in self.TABLES}
        if known := state.get("schemas"):
            have = set(T.StructType.fromJson(known["rows"]).fieldNames()) - {"superseded", "current_version", "authorized"}
            if have != set(batch.columns) - {"kind", "authorized"}:
                raise ValueError(f"the index has columns {sorted(have)}")
        adds = batch if old["rows"] is None else old["rows"].drop("superseded", "current_version").withColumn("kind", F.lit("add")).unionByName(batch)
        union = lambda a, b: b if a is None else a.unionByName(b)
        folder = self.manifests.folder(version + 1)
        write = lambda df, t: df.withColumn("bucket", _bucket(self.buckets)).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.manifests.path}/{folder}/{t}")
        marks = index.merged_marks(union(old["marks"], index.version_marks(batch)))
        docs = index.merged_documents(union(old["docs"], index.document_marks(batch)))
        write(marks, "marks")
        write(docs, "docs")
        new = {t: self.spark.read.schema(df.schema).parquet(f"{self.manifests.path}/{folder}/{t}") for t, df in (("marks", marks), ("docs", docs))}
        rows = index.superseded_by(index.stored_rows(adds), new["marks"]).join(index.settled(new["docs"]), "document_id")
        write(rows, "rows")
        written = {t: {int(n[7:]) for n in self.manifests.names(f"{folder}/{t}") if n.startswith("bucket=")} for t in self.TABLES}
        buckets = {b: at for b, at in state.get("buckets", {}).items() if int(b) not in touched}
        buckets |= {str(b): {"in": folder, "tables": [t for t in self.TABLES if b in written[t]]} for b in sorted(touched)}
        schemas = {t: df.schema.jsonValue() for t, df in (("rows", rows), ("marks", marks), ("docs", docs))}
        self.manifests.commit(version + 1, {"n": self.buckets, "buckets": buckets, "schemas": schemas, "best": state.get("best")})
        return version + 1

    def rows(self, version: int | None = None) -> DataFrame:
        """The index as it stood, with ``superseded``, ``authorized`` and ``current_version``; as :func:`index.index_rows` of all events."""
        state = self.manifests.read(version)[1]
        if not state:
            raise ValueError(f"no index in {self.manifests.path}")
        found = self._read(state, "rows")
        return found if found is not None else self.spark.createDataFrame([], T.StructType.fromJson(state["schemas"]["rows"]))

    def publish(self, buckets: int) -> None:
        """Write the best row of each fingerprint in ``buckets`` buckets of fingerprints, as part of the next state."""
        version, state = self.manifests.read()
        folder = self.manifests.folder(version + 1)
        best = index.best_rows(self.rows(version))
        name = _table_name(folder)
        best.repartition(buckets, "fingerprint").write.bucketBy(buckets, "fingerprint").sortBy("fingerprint").option("path", f"{self.manifests.path}/{folder}/best").saveAsTable(name)
        self.manifests.commit(version + 1, {**state, "best": {"in": folder, "n": buckets, "of": version, "schema": best.schema.jsonValue()}})

    def best(self) -> DataFrame:
        """The published best rows; a join by ``fingerprint`` reads them where they lie."""
        best = self.manifests.read()[1].get("best")
        if not best:
            raise ValueError("nothing is published")
        name = _table_name(best["in"])
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(best["schema"]))
            place = f"{self.manifests.path}/{best['in']}/best".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {best['n']} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def verify(self, chunks: DataFrame, key: bytes | Secret) -> DataFrame:
        """As :func:`index.verify` against the published rows."""
        return index.verify_best(chunks, self.best(), key)

    def vacuum(self, keep: int = 1) -> list[str]:
        def used(state: dict) -> set[str]:
            return {at["in"] for at in state.get("buckets", {}).values()} | ({state["best"]["in"]} if state.get("best") else set())

        return self.manifests.vacuum(used, keep)


def _table_name(folder: str) -> str:
    return f"veritrail_best_{folder.replace('-', '_')}"


class MerkleLog:
    """An append-only log: entries, the complete nodes above them, and a frontier of at most 64 peaks.

    An append numbers its entries from the size of the log and makes the nodes that become complete with it, which all
    lie on the right edge: their children are new nodes or peaks, so no stored node is read. The few nodes of the
    right edge that are not complete follow from the peaks.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.manifests = spark, Manifests(spark, path)

    def state(self, version: int | None = None) -> dict:
        return self.manifests.read(version)[1] or {"size": 0, "peaks": {}, "in": [], "schema": None}

    @property
    def size(self) -> int:
        return self.state()["size"]

    def append(self, rows: DataFrame, order: list[str]) -> int:
        """Add rows (``payload`` binary and whatever else an entry keeps) in the order of ``order``; the new size.

        :class:`Conflict` where another append came between; numbers depend on it, so the caller decides what to do then.
        """
        version = self.manifests.read()[0]
        state = self.state(version)
        if state["schema"] and (want := T.StructType.fromJson(state["schema"])).fieldNames() != [*rows.columns, "leaf_index"]:
            raise ValueError(f"the log has columns {want.fieldNames()}")
        start, folder = state["size"], self.manifests.folder(version + 1)
        entries = merkle.numbered(rows, order).withColumn("leaf_index", F.col("leaf_index") + start)
        entries.write.parquet(f"{self.manifests.path}/{folder}/entries")
        entries = self.spark.read.schema(entries.schema).parquet(f"{self.manifests.path}/{folder}/entries")
        end = start + entries.count()
        if end == start:
            return start
        peaks = {int(level): bytes.fromhex(h) for level, h in state["peaks"].items()}
        made = merkle.grown(entries, start, end, peaks)
        reduce(DataFrame.unionByName, made).write.parquet(f"{self.manifests.path}/{folder}/nodes")
        for df in made:
            discard(df)
        edge = {(level, (end >> level) - 1) for level in range(end.bit_length()) if end >> level & 1}
        nodes = self.spark.read.parquet(f"{self.manifests.path}/{folder}/nodes")
        wanted = reduce(lambda a, b: a | b, [(F.col("level") == level) & (F.col("idx") == i) for level, i in edge])
        found = {r["level"]: r["hash"].hex() for r in nodes.filter(wanted).collect()}  # at most 64
        kept = {level: found.get(level) or peaks[level].hex() for level, _ in edge}
        self.manifests.commit(version + 1, {"size": end, "peaks": kept, "in": [*state["in"], folder], "schema": entries.schema.jsonValue()})
        return end

    def entries(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        if not state["in"]:
            raise ValueError(f"no log in {self.manifests.path}")
        return self.spark.read.schema(T.StructType.fromJson(state["schema"])).parquet(*[f"{self.manifests.path}/{f}/entries" for f in state["in"]])

    def tree(self, version: int | None = None) -> DataFrame:
        """All nodes (level, idx, hash), as :func:`merkle.nodes` of all entries."""
        state = self.state(version)
        schema = "level int, idx long, hash binary"
        edge = merkle.right_edge(state["size"], {int(k): bytes.fromhex(h) for k, h in state["peaks"].items()})
        edge = self.spark.createDataFrame([(level, i, bytearray(h)) for level, i, h in edge], schema)
        if not state["in"]:
            return edge
        return self.spark.read.schema(schema).parquet(*[f"{self.manifests.path}/{f}/nodes" for f in state["in"]]).unionByName(edge)

    def root(self, version: int | None = None) -> tuple[int, str]:
        """Size and root (hex), from the frontier alone."""
        state = self.state(version)
        return state["size"], merkle.peaks_root(state["size"], {int(k): bytes.fromhex(h) for k, h in state["peaks"].items()}).hex()

    def proofs(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        return merkle.proofs(self.tree(version), wanted)

    def replays(self, version: int | None = None) -> bool:
        """Whether the stored entries still have dense numbers and lead to the root of the frontier."""
        size, root = self.root(version)
        if size == 0:
            return True
        entries = self.entries(version)
        span = entries.agg(F.min("leaf_index").alias("a"), F.max("leaf_index").alias("b"), F.count("*").alias("n"), F.count_distinct("leaf_index").alias("d")).first()
        if (span["a"], span["b"], span["n"], span["d"]) != (0, size - 1, size, size):
            return False
        tree = materialize(merkle.nodes(entries), "replay")
        try:
            return merkle.root(tree).first()["tree_root"] == root
        finally:
            discard(tree)


