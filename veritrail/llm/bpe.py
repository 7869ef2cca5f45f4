"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per Python worker.

Each match of the split pattern ("piece") is encoded alone. A query holds one
row per token and position; every round joins neighbouring tokens with the
merge table, contracts each piece's leftmost pair of minimum rank, and stops
when no piece has a pair left. The ids of a text go out as numbers and as
text from one array, and that array is what decoding reads: ids join the
vocabulary, and the bytes in order of position are cut into texts.

A piece of more than ``LONG_PIECE`` bytes is first cut where no vocabulary entry
that stands in it crosses the cut, so that no merge can; its parts are then
encoded by the same query in a form that contracts all pairs of the minimum
rank in a round (every second one of an overlapping run, from the left). That
is the same result in fewer rounds where the new token is not part of a merge
of lower rank; where it is, only the leftmost pair is contracted.

Defined results: a null text is encoded as the empty text (no ids, empty
bytes); any Unicode text round-trips; rows are independent, so repeated rows
give repeated results; an empty table gives an empty table. Pieces already
encoded are remembered, ``CACHE_PIECES`` entries at most, so memory is bounded
and a full cache only costs time.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import extended, prepare, slices, worker_state

#: Entries of the cache of encoded strings; beyond it the cache starts anew.
CACHE_PIECES = 200_000
#: Pieces encoded by one recursive query.
QUERY_PIECES = 20_000
#: Bytes of text that a worker works on at once.
SLICE = 2 << 20
#: What a worker's database may hold.
WORKER_MEMORY = "120MB"
LONG_PIECE = 64

ENCODE_SQL = """
WITH RECURSIVE t(w, pos, tok, done) AS (
  SELECT w, pos, tok, false FROM seed
  UNION ALL
  (WITH n AS (
     SELECT w, pos, tok, lead(tok) OVER o AS nx, lead(w) OVER o AS nw, lag(pos) OVER o AS pp
     FROM t WHERE NOT done WINDOW o AS (ORDER BY pos)),
   best AS (
     SELECT n.w, min((m.merged::BIGINT << 32) | n.pos) AS b
     FROM n JOIN merges m ON m.l = n.tok AND m.r = n.nx
     WHERE n.nw = n.w GROUP BY n.w)
   SELECT n.w, n.pos, CASE WHEN n.pos = (b & 4294967295) THEN (b >> 32)::INT ELSE tok END, b IS NULL
   FROM n LEFT JOIN best USING (w)
   WHERE b IS NULL OR pp IS NULL OR pp <> (b & 4294967295)))
SELECT w, tok FROM t WHERE done ORDER BY pos
"""

#: As above, with all pairs of the minimum rank contracted in one round where that is the same (``NOT alone``).
ENCODE_LONG_SQL = """
WITH RECURSIVE t(w, pos, tok, done) AS (
  SELECT w, pos, tok, false FROM seed
  UNION ALL
  (WITH n AS (
     SELECT w, pos, tok, lead(tok) OVER o AS nx, lead(w) OVER o AS nw, row_number() OVER o AS rn
     FROM t WHERE NOT done WINDOW o AS (ORDER BY pos)),
   c AS (SELECT n.w, n.rn, m.merged, m.alone FROM n JOIN merges m ON m.l = n.tok AND m.r = n.nx WHERE n.nw = n.w),
   best AS (SELECT w, min(merged) AS b, arg_min(rn, merged::BIGINT << 32 | rn) AS leftmost FROM c GROUP BY w),
   hit AS (SELECT c.rn, best.b, c.rn - row_number() OVER (ORDER BY c.rn) AS run
     FROM c JOIN best ON best.w = c.w AND best.b = c.merged WHERE NOT c.alone OR c.rn = best.leftmost),
   chosen AS (SELECT rn, b FROM (SELECT rn, b, rn - min(rn) OVER (PARTITION BY run) AS nth FROM hit) WHERE nth % 2 = 0),
   change AS (SELECT rn, b FROM chosen UNION ALL SELECT rn + 1, NULL FROM chosen)
   SELECT n.w, n.pos, CASE WHEN change.rn IS NULL THEN n.tok ELSE change.b END, best.b IS NULL
   FROM n LEFT JOIN change USING (rn) LEFT JOIN best ON best.w = n.w
   WHERE change.rn IS NULL OR change.b IS NOT NULL))
SELECT w, tok FROM t WHERE done ORDER BY pos
"""

DECODE_SQL = "SELECT bytes FROM ids LEFT JOIN vocab USING (tok) ORDER BY pos"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks by token bytes from a file with one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Coder:
    """Encoder and decoder of one vocabulary, in one worker process."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(raw)
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], "int32")
        merges = array("i")
        for b, rank in self.ranks.items():
            for i in range(1, len(b)):
                if (l := self.ranks.get(b[:i])) is not None and (r := self.ranks.get(b[i:])) is not None:
                    merges.extend((l, r, rank))
        l, r, merged = np.frombuffer(merges, "int32").reshape(-1, 3).T if merges else np.zeros((3, 0), "int32")
        falling = np.concatenate([l[merged < l], r[merged < r]])
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": WORKER_MEMORY, "allocator_flush_threshold": "1MB"})
        self._table("merges", {"l": l.copy(), "r": r.copy(), "merged": merged.copy(), "alone": np.isin(merged, falling)})
        self._table("vocab", {"tok": np.fromiter(self.ranks.values(), "int32"), "bytes": pa.array(list(self.ranks), pa.binary())})
        self._forget()

    def _forget(self) -> None:
        """An empty cache: the place of each known string, and the ids at each place."""
        self.known: dict[str, int] = {}
        self.flat, self.start = np.zeros(0, "int32"), np.zeros(1, "int64")

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _rows(self, sql: str, name: str, columns: dict) -> pa.Table:
        self.con.register(name, pa.table(columns))
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def _cut(self, piece: bytes) -> list[bytes]:
        """The parts of a piece between places that no vocabulary entry crosses."""
        crossed = np.zeros(len(piece) + 1, "int32")
        for n in range(2, min(self.longest, len(piece)) + 1):
            at = [i for i in range(len(piece) - n + 1) if piece[i : i + n] in self.ranks]
            np.add.at(crossed, np.array(at, "int64") + 1, 1)
            np.add.at(crossed, np.array(at, "int64") + n, -1)
        ends = [0, *(np.flatnonzero(np.cumsum(crossed)[1:-1] == 0) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(ends, ends[1:])]

    def _contract(self, sql: str, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and their number in each."""
        flat, sizes = [np.zeros(0, "int32")], [np.zeros(0, "int64")]
        for at in range(0, len(parts), QUERY_PIECES):
            part = parts[at : at + QUERY_PIECES]
            raw = np.frombuffer(b"".join(part), "uint8")
            w = np.repeat(np.arange(len(part), dtype="int32"), [len(p) for p in part])
            got = self._rows(sql, "seed", {"w": w, "pos": np.arange(len(raw), dtype="int32"), "tok": self.of_byte[raw]})
            flat.append(got.column("tok").to_numpy())
            sizes.append(np.bincount(got.column("w").to_numpy(), minlength=len(part)))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, pieces: list[str]) -> None:
        """Encode distinct pieces into the cache; a recursive query for all that are not single tokens."""
        raw = [p.encode() for p in pieces]
        found = list(map(self.ranks.get, raw))
        whole = [i for i, r in enumerate(found) if r is not None]
        self._remember([pieces[i] for i in whole], np.array([found[i] for i in whole], "int32"), np.ones(len(whole), "int64"))
        short = [i for i, r in enumerate(found) if r is None and len(raw[i]) <= LONG_PIECE]
        self._remember([pieces[i] for i in short], *self._contract(ENCODE_SQL, [raw[i] for i in short]))
        long = [i for i, r in enumerate(found) if r is None and len(raw[i]) > LONG_PIECE]
        parts = [self._cut(raw[i]) for i in long]
        flat, sizes = self._contract(ENCODE_LONG_SQL, [p for ps in parts for p in ps])
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, parts)])]
        self._remember([pieces[i] for i in long], flat, np.diff(ends))

    def decode_ids(self, flat: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Bytes of each list of ids (``flat``, one after the other), by a join with the vocabulary in order of position; an id that is not there has none."""
        got = self._rows(DECODE_SQL, "ids", {"pos": np.arange(len(flat), dtype="int64"), "tok": flat})
        # the values of a column stand one after the other, so a text is one cut out of them
        values = pa.chunked_array([[], *got.column("bytes").chunks], pa.binary()).combine_chunks().cast(pa.large_binary())
        raw, ends = values.buffers()[2], np.frombuffer(values.buffers()[1], "int64")[values.offset : values.offset + len(values) + 1]
        cuts = ends[np.concatenate([[0], np.cumsum(lengths)]).astype("int64")].tolist() if len(values) else [0] * (len(lengths) + 1)
        raw = memoryview(raw) if raw is not None else b""
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _remember(self, strings: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.start) - 1
        self.known.update(zip(strings, range(first, first + len(strings))))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat.astype("int32")])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number in each."""
        found = list(map(self.pattern.findall, texts))
        pieces = pa.array(chain.from_iterable(found), pa.string(), size=sum(map(len, found))).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.known) > CACHE_PIECES:
            self._forget()
        self._learn([p for p in distinct if p not in self.known])
        at = np.fromiter(map(self.known.__getitem__, distinct), "int64", len(distinct))[pieces.indices.to_numpy()]
        first = self.start[at]
        size = self.start[at + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        return flat, np.diff(ends[np.cumsum([0, *map(len, found)])])

    def code(self, texts: list[str]) -> tuple[list[str], list[int], list[bytes]]:
        """Ids as text, number of ids and decoded bytes of each text."""
        flat, n = self.encode(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat).cast(pa.string()))
        return pc.binary_join(lists, ",").to_pylist(), n.tolist(), self.decode_ids(flat, n)


def coder(raw: bytes, pattern: str) -> Coder:
    return worker_state("bpe", (hash(raw), pattern), lambda: Coder(raw, pattern))


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", decoded: str = "decoded") -> DataFrame:
    """Add ``ids`` (decimal ids joined by commas), ``count`` and ``decoded`` (binary) to ``df``.

    The columns that the operator adds replace columns of the same names. The
    vocabulary has a fixed size (under 1 MB) and goes to workers with the code.
    """
    spark = df.sparkSession
    prepare(spark)
    with open(ranks_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    df = df.drop(*[c for c in (ids, count, decoded) if c in df.columns])
    schema = extended(df, **{ids: "string", count: "long", decoded: "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(raw.value, pattern)
        for part in slices(batches, text, SLICE):
            a, n, b = c.code([t or "" for t in part.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a, pa.string()), pa.array(n, pa.int64()), pa.array(b, pa.binary())], names=[*part.schema.names, ids, count, decoded])

    return df.mapInArrow(run, schema)


def ids_array(col: str = "token_ids"):
    """The ids as an array of ints, for callers that want numbers."""
    return F.when(F.col(col) == "", F.array().cast("array<int>")).otherwise(F.split(col, ",").cast("array<int>"))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary) for an array column of ids; null arrays decode to empty bytes."""
    spark = df.sparkSession
    prepare(spark)
    with open(ranks_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    df = df.drop(decoded) if decoded in df.columns else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(raw.value, r"(?s:.+)")
        for part in batches:
            rows = [x or [] for x in part.column(ids).to_pylist()]
            b = c.decode_ids(np.array([i for x in rows for i in x], "int32"), np.array([len(x) for x in rows], "int64"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(b, pa.binary())], names=[*part.schema.names, decoded])

    return df.mapInArrow(run, extended(df, **{decoded: "binary"}))
