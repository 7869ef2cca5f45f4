"""Repeated byte windows by minimisers and hash grouping, in place of a radix sort of suffixes.

Suffixes are never put in order: windows of ``LENGTH`` bytes are grouped by
hashes, here called digits, and windows that stay equal are the repeated ones.
A pass drops groups of one, so each works on what the one before kept:

1. Digit one of a window is its least hashed ``GRAM``-byte string (the leftmost
   of equals) and that string's place in the window. Equal windows have equal
   digits, and neighbouring windows share theirs, so one row ("anchor") stands
   for a run of suffixes. Anchors with a string of their own are dropped.
2. Digit two is the anchor's whole surroundings: all bytes that its windows
   can reach. Anchors with equal surroundings repeat each other's windows.
3. What is left are anchors whose surroundings differ in part. For these, and
   one of each group of step 2 that shares their string, the last digit is the
   window itself, as a 128-bit hash.

Removed are all bytes covered by a window that starts at two places or more,
in one document or several, judged on the input. Defined results: null and
empty texts and texts under ``LENGTH`` bytes have nothing removed; repeated
rows are copies of each other like any others; an empty table gives an empty
one. A text is worked on in tiles, so its length does not bound memory.
Groups of step 3 with more than ``GROUP_ROWS`` members are spread window by
window over all tasks, smaller ones meet in one task.

The same passes over words (maximal runs of other than white space) in place of
bytes find the words in runs of ``WORDS.length`` that start at two places or
more. Passages of so many words are often shorter than ``LENGTH`` bytes; they are
counted (``n_passage_words``), not removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import extended, prepare, release, stable_rows
from veritrail.llm.similar import _word_hashes
from veritrail.llm.windows import Roller, mix, sliding_min
from veritrail.runtime import discard, materialize

LENGTH = 400
GRAM = 200
#: Window starts of a text that are worked on at once.
TILE = 1 << 20
#: Anchors that share a string and are compared in one task.
GROUP_ROWS = 20_000
#: Anchors of a task of step 3.
TASK_ROWS = 30_000

#: Bytes between words become spaces.
_SPACES = bytes(32 if 9 <= c <= 13 else c for c in range(256))


@dataclass(frozen=True)
class Unit:
    """What a text is a sequence of, the length of a window and of the strings by which windows are grouped."""

    length: int
    gram: int
    words: bool = False

    def sequence(self, text: str | None) -> np.ndarray:
        return _word_hashes(text or "", _SPACES) if self.words else np.frombuffer((text or "").encode(), "uint8")

    def read(self, part: bytes) -> np.ndarray:
        return np.frombuffer(part, "uint64" if self.words else "uint8")


BYTES = Unit(LENGTH, GRAM)
WORDS = Unit(51, 26, words=True)

U = np.uint64
_LOCAL = U((1 << 24) - 1)
_rollers: list[Roller] = []


def _roll() -> list[Roller]:
    if not _rollers:
        _rollers.extend(Roller(TILE + 4 * LENGTH, seed) for seed in (11, 77))
    return _rollers


def _tile_anchors(raw: np.ndarray, lo: int, hi: int, u: Unit) -> tuple[np.ndarray, ...]:
    """Anchors of the windows that start in [lo, hi): place, first and last window, string hash, hashes of surroundings."""
    n, length, gram = len(raw), u.length, u.gram
    first, last = max(0, lo - gram), min(n, hi + 2 * length)
    part = raw[first:last]
    a, b = _roll()
    pa_, pb = a.prefix(part), b.prefix(part)
    at = lo - first
    grams = a.every(pa_[at : at + (hi - 1 - lo) + length + 1], gram) if at == 0 else a.every(pa_, gram)[at : at + (hi - lo) + length - gram]
    packed = (grams & ~_LOCAL) | np.arange(len(grams), dtype=U)
    least = sliding_min(packed, length - gram + 1)[: hi - lo]
    start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    end = np.r_[start[1:], len(least)] - 1
    local = (least[start] & _LOCAL).astype(np.int64)
    place = local + lo
    left, right = np.maximum(place - gram, 0), np.minimum(place + length, n)
    shape = mix((place - left).astype(U) * U(1024) + (right - place).astype(U) + U(1))
    return place, start + lo, end + lo, grams[local], a.window(pa_, left - first, right - first) ^ shape, b.window(pb, left - first, right - first) ^ mix(shape)


def anchors(raw: np.ndarray, u: Unit = BYTES) -> list[np.ndarray]:
    """Anchors of one text; runs that tiles cut are joined again."""
    n = len(raw) - u.length + 1
    if n <= 0:
        return []
    parts: list[list[np.ndarray]] = []
    for lo in range(0, n, TILE):
        new = list(_tile_anchors(raw, lo, min(n, lo + TILE), u))
        if parts and new[0][0] == parts[-1][0][-1]:
            new[1][0] = parts[-1][1][-1]
            parts[-1] = [x[:-1] for x in parts[-1]]
        parts.append(new)
    return [np.concatenate(x) for x in zip(*parts)]


def _anchor_rows(batches: Iterator[pa.RecordBatch], u: Unit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = batch.column("_rid")
        f, i = rid.field("f").to_pylist(), rid.field("i").to_pylist()
        got: list[list[np.ndarray]] = []
        held = 0

        def out(got):
            place, first, last, gram, c1, c2 = (np.concatenate([g[k] for g in got]) for k in range(2, 8))
            ff, ii = (np.concatenate([g[k] for g in got]) for k in (0, 1))
            columns = [ff, ii, place.astype("int32"), (place - first).astype("int16"), (place - last).astype("int16"), gram.view("int64"), c1.view("int64"), c2.view("int64")]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["f", "i", "place", "far", "near", "gram", "c1", "c2"])

        for k, text in enumerate(batch.column("text").to_pylist()):
            if found := anchors(u.sequence(text), u):
                m = len(found[0])
                got.append([np.full(m, f[k], "int64"), np.full(m, i[k], "int64"), *found])
                held += m
                if held > 200_000:
                    yield out(got)
                    got, held = [], 0
        if got:
            yield out(got)


def _surroundings(batches: Iterator[pa.RecordBatch], u: Unit) -> Iterator[pa.RecordBatch]:
    """One row per anchor with the part of the text that its windows can reach."""
    for batch in batches:
        texts, marks = batch.column("text").to_pylist(), batch.column("_marks").to_pylist()
        rid = batch.column("_rid")
        f, i = rid.field("f").to_pylist(), rid.field("i").to_pylist()
        rows: list[tuple] = []
        for k, text in enumerate(texts):
            raw = u.sequence(text)
            for m in marks[k]:
                rows.append((m["gram"], m["big"], f[k], i[k], m["place"], m["far"], m["near"], raw[m["place"] - m["far"] : m["place"] - m["near"] + u.length].tobytes()))
            if len(rows) > 20_000 or (k == len(texts) - 1 and rows):
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["gram", "big", "f", "i", "place", "far", "near", "part"])
                rows = []


def _window_hashes(batch: pa.RecordBatch, u: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and distance from the anchor of each window of a batch of surroundings, and its two hashes."""
    a, b = _roll()
    parts = batch.column("part").to_pylist()
    far, near = batch.column("far").to_numpy(), batch.column("near").to_numpy()
    rows, ds, h1, h2 = [], [], [], []
    for k, part in enumerate(parts):
        raw = u.read(part)
        m = int(far[k]) - int(near[k]) + 1
        rows.append(np.full(m, k, "int32"))
        ds.append(np.arange(far[k], far[k] - m, -1, dtype="int16"))
        h1.append(a.every(a.prefix(raw), u.length))
        h2.append(b.every(b.prefix(raw), u.length))
    return tuple(np.concatenate(x) for x in (rows, ds, h1, h2))


def _resolve_task(batches: Iterator[pa.RecordBatch], u: Unit) -> Iterator[pa.RecordBatch]:
    """Least and greatest distance of each anchor's repeated windows, where a task holds whole groups."""
    names = ["f", "i", "place"]
    held, keys, n = [], [], 0
    for batch in batches:
        if batch.num_rows:
            rows, ds, h1, h2 = _window_hashes(batch, u)
            gram = batch.column("gram").to_numpy().view(U)[rows]
            keys.append((rows + n, ds, mix(h1 ^ gram), h2))
            held.append(batch.select(names))
            n += batch.num_rows
    if not n:
        return
    rows, ds, h1, h2 = (np.concatenate(x) for x in zip(*keys))
    order = np.lexsort((h2, h1))
    s1, s2 = h1[order], h2[order]
    same = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
    twice = np.zeros(len(order), bool)
    twice[order] = np.r_[same, False] | np.r_[False, same]
    far, near = np.full(n, -1, "int16"), np.full(n, 1 << 14, "int16")
    np.maximum.at(far, rows[twice], ds[twice])
    np.minimum.at(near, rows[twice], ds[twice])
    table = pa.Table.from_batches(held).append_column("far", pa.array(far)).append_column("near", pa.array(near))
    yield from table.filter(pa.array(far >= 0)).combine_chunks().to_batches()


def _window_rows(batches: Iterator[pa.RecordBatch], u: Unit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            rows, ds, h1, h2 = _window_hashes(part, u)
            columns = [part.column(c).take(pa.array(rows)) for c in ("f", "i", "place")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ds), pa.array(h1.view("int64")), pa.array(h2.view("int64"))], names=["f", "i", "place", "d", "h1", "h2"])


def repeated_spans(docs: DataFrame, u: Unit = BYTES) -> DataFrame:
    """Covered stretches of each row of ``docs`` (``_rid``, ``text``) in its unit: f, i, spans; stretches may overlap."""
    spark = docs.sparkSession
    prepare(spark)
    place = "f long, i long, place int, far short, near short"
    found = materialize(docs.select("_rid", "text").mapInArrow(lambda x: _anchor_rows(x, u), f"{place}, gram long, c1 long, c2 long"), "anchors")
    shared = found.groupBy("gram").count().filter("count > 1").select("gram")
    kept = materialize(found.join(shared, "gram"), "shared")
    release(spark)
    discard(found)
    # Digit two: anchors by their surroundings; the least member stands for its group.
    groups = materialize(kept.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("f", "i", "place", "far", "near")).alias("one")), "groups")
    copied = kept.join(groups.filter("n > 1").select("gram", "c1", "c2"), ["gram", "c1", "c2"]).select("f", "i", (F.col("place") - F.col("far")).alias("lo"), (F.col("place") - F.col("near") + u.length).alias("hi"))
    copied = copied.groupBy("f", "i").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    copied = materialize(copied, "copied")
    release(spark)
    discard(kept)
    # Digit three: strings with an anchor whose surroundings are its own.
    mixed = groups.groupBy("gram").agg(F.min("n").alias("least"), F.count("*").alias("members")).filter("least = 1 AND members > 1").select("gram", (F.col("members") > GROUP_ROWS).alias("big"))
    edges = groups.join(mixed, "gram").select("gram", "big", "n", "one.*")
    marks = edges.groupBy(F.struct("f", "i").alias("_rid")).agg(F.collect_list(F.struct("gram", "big", "place", "far", "near")).alias("_marks"))
    near_by = docs.select("_rid", "text").join(marks, "_rid").mapInArrow(lambda x: _surroundings(x, u), f"gram long, big boolean, {place}, part binary")
    near_by = materialize(near_by, "surroundings")
    release(spark)
    total, big = near_by.agg(F.count("*"), F.count_if("big")).first()
    small = near_by.filter("NOT big").repartition(max(1, -(-(total - big) // TASK_ROWS)), "gram").mapInArrow(lambda x: _resolve_task(x, u), place)
    if big:
        rows = materialize(near_by.filter("big").mapInArrow(lambda x: _window_rows(x, u), "f long, i long, place int, d short, h1 long, h2 long"), "rows")
        twice = rows.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
        small = small.unionByName(rows.join(twice, ["h1", "h2"]).groupBy("f", "i", "place").agg(F.max("d").alias("far"), F.min("d").alias("near")))
    partly = small.select("f", "i", (F.col("place") - F.col("far")).alias("lo"), (F.col("place") - F.col("near") + u.length).alias("hi")).groupBy("f", "i").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = copied.unionByName(partly).groupBy("f", "i").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = materialize(spans, "spans")
    release(spark)
    for t in (copied, groups, near_by):
        discard(t)
    return out


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """Add to each row ``spans`` (removed stretches, in bytes), ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans`` and ``n_passage_words``.

    Columns of these names in ``df`` are replaced.
    """
    own = ("spans", "kept", "n_bytes", "n_removed", "n_spans", "n_passage_words", "_rid")
    df = stable_rows(df.drop(*[c for c in own if c in df.columns]))
    docs = df.select("_rid", F.col(text).alias("text"))
    both = None
    for unit, name in ((BYTES, "_spans"), (WORDS, "_passages")):
        found = repeated_spans(docs, unit).select("f", "i", F.col("spans").alias(name))
        both = found if both is None else both.join(found, ["f", "i"], "full")
    joined = df.join(both.select(F.struct("f", "i").alias("_rid"), "_spans", "_passages"), "_rid", "left").drop("_rid")
    rest = joined.drop("_spans", "_passages")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: [] for k in ("spans", "kept", "n_bytes", "n_removed", "n_spans", "n_passage_words")}
            for t, s, p in zip(*(batch.column(c).to_pylist() for c in (text, "_spans", "_passages"))):
                raw, at, kept = (t or "").encode(), 0, []
                runs = _merged(s)
                for lo, hi in runs:
                    kept.append(raw[at:lo])
                    at = hi
                kept.append(raw[at:])
                left = b"".join(kept)
                for k, v in zip(columns, ([{"lo": a, "hi": b} for a, b in runs], left, len(raw), len(raw) - len(left), len(runs), sum(b - a for a, b in _merged(p)))):
                    columns[k].append(v)
            kinds = [pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.binary(), *[pa.int64()] * 4]
            old = [c for c in batch.schema.names if c not in ("_spans", "_passages")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in old], *[pa.array(v, t) for v, t in zip(columns.values(), kinds)]], names=[*old, *columns])

    return joined.mapInArrow(cut, extended(rest, spans="array<struct<lo:int,hi:int>>", kept="binary", n_bytes="long", n_removed="long", n_spans="long", n_passage_words="long"))


def _covered(source: str, length: int) -> str:
    """Stretches lo to hi (from 1, hi excluded) covered by windows of ``length`` in ``source`` (rid, i, h) that occur twice."""
    return f"""(SELECT rid, min(i) AS lo, max(i) + {length} AS hi FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k
    FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh
      FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM {source}) WHERE n > 1)) GROUP BY rid, k)"""


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT rid, i, md5(array_slice(b, i, i + {LENGTH - 1})) AS h FROM (SELECT rid, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d)),
s AS MATERIALIZED {_covered('x', LENGTH)},
y AS (SELECT rid, i, md5(array_to_string(w[i : i + {WORDS.length - 1}], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - {WORDS.length - 2})) AS i FROM d)),
p AS (SELECT rid, sum(hi - lo) AS n FROM {_covered('y', WORDS.length)} GROUP BY rid),
gap AS (SELECT rid, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 1) AS a, lo AS z FROM s UNION ALL SELECT rid, max(hi), any_value(octet_length(b)) + 1 FROM s JOIN d USING (rid) GROUP BY rid),
kept AS (SELECT rid, string_agg(hex(array_slice(b, a, z - 1)), '' ORDER BY a) AS x FROM gap JOIN d USING (rid) WHERE z > a GROUP BY rid),
c AS (SELECT rid, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM s GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN c.rid IS NULL THEN b ELSE unhex(coalesce(kept.x, '')) END) AS kept_sha256, coalesce(p.n, 0)::BIGINT AS n_passage_words
FROM d LEFT JOIN c USING (rid) LEFT JOIN kept USING (rid) LEFT JOIN p USING (rid)
"""
