"""Source divergence audit: how far the word use of each source of a language is from that of every other.

Terms are counted per (language, source) group; a language keeps the terms in at
least ``MIN_DOCS`` of its documents. Each group is a vector of shares over its
language's kept terms, smoothed and in units of 1e-9, and two groups are apart by
the triangular discrimination of their vectors, in whole numbers throughout.

The pairs are computed in tiles. Kept terms are dealt by hash to vocabulary chunks
of about ``CHUNK`` terms and numbered inside; a group's counts in a chunk are one
packed vector. Groups form blocks of ``BLOCK``; a vector is replicated to every
tile (block by block) of its block. Tiles are laid out by range of (language, tile,
chunk), so that a task meets the chunks of a tile one after the other, holds one
chunk's vectors and one submatrix at a time, and hands on a submatrix per tile; the
parts of a tile that lay in several tasks are added up. Memory depends on BLOCK and
CHUNK alone, work is dealt out by tile and chunk however large one group or language is.

Defined results: null text, language and source count as the empty string. Repeated
rows are documents of their own. A group without terms, or in a language that keeps
none, takes part with zero counts (values are 0 in the latter). Texts are whole, of any
length. Equal values are ranked by item in order of UTF-8 bytes. An empty table gives
an empty table; other columns of the input are not read. Exact while a group has
under 9e15 occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.common import prepare, slices
from veritrail.runtime import discard, materialize

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP = 10, 10
UNIT, SMOOTH = 1_000_000_000, 2
BLOCK, CHUNK = 32, 2048
#: Bytes of text whose terms are summed together before they are shuffled.
SLICE = 12 << 20


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Partial sums (lang, source, term, count, docs) per slice of documents; several rows may share a key."""
    prepare(df.sparkSession)
    find = re.compile(TERM).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found = [find(t.encode().lower().decode()) for t in part.column("text").to_pylist()]  # lower() of bytes is A-Z alone
            n = np.fromiter(map(len, found), "int64", len(found))
            coded = pa.array((t for ts in found for t in ts), pa.string(), size=int(n.sum())).dictionary_encode()
            del found
            names = [part.column(c).dictionary_encode() for c in ("lang", "source")]
            l, s = (x.indices.to_numpy().astype("int64") for x in names)
            size = max(1, len(coded.dictionary))
            key, times = np.unique(np.repeat(np.arange(len(part)), n) * size + coded.indices.to_numpy(), return_counts=True)
            doc, term = np.divmod(key, size)
            width = max(1, len(names[1].dictionary))
            key, at, docs = np.unique((l * width + s)[doc] * size + term, return_inverse=True, return_counts=True)
            count = np.bincount(at, times, len(key)).astype("int64")
            group, term = np.divmod(key, size)
            cols = [names[0].dictionary.take(pa.array(group // width)), names[1].dictionary.take(pa.array(group % width)), coded.dictionary.take(pa.array(term)), pa.array(count), pa.array(docs.astype("int64"))]
            for b in pa.Table.from_arrays(cols, names=["lang", "source", "term", "count", "docs"]).to_batches(max_chunksize=100_000):
                yield b

    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("text", text), ("lang", lang), ("source", source))])
    return named.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def kept_counts(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, count, lang_count, is_first) of the terms that their language keeps.

    ``lang_count`` is the term's sum over sources and ``is_first`` marks one row per term. One shuffle, by language and
    term; what it moves is summed per slice, so a frequent term is a row per slice and group at most.
    """
    by_group = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    summed = by_group.select("lang", "source", "term", "count", F.sum("docs").over(whole).alias("_docs"), F.sum("count").over(whole).alias("lang_count"), (F.row_number().over(whole.orderBy("source")) == 1).alias("is_first"))
    return summed.filter(F.col("_docs") >= min_docs).drop("_docs")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), exact."""
    return F.expr(f"1 + (CAST({count} + {SMOOTH} AS DECIMAL(25, 0)) * CAST({UNIT} AS DECIMAL(10, 0))) div CAST({total} + {SMOOTH} * {terms} AS DECIMAL(25, 0))")


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """As :func:`share`, a row per group; three digits at a time, so that 64 bits hold every product."""
    below = (total + SMOOTH * terms)[:, None]
    out, rest = np.divmod(count + SMOOTH, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digits
    return out + 1


def discrimination(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over terms of floor((p - q)^2 / (p + q)) of one row against each row of ``q``."""
    d = p - q
    return ((d * d) // (p + q)).sum(axis=1)


def group_sizes(df: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, n, g: number within the language, groups) and languages (lang, terms, lang_n, chunks), written."""
    occurring = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    inside = Window.partitionBy("lang")
    groups = occurring.join(sums, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.row_number().over(inside.orderBy("source")) - 1).alias("g"), F.count(F.lit(1)).over(inside).cast("int").alias("groups")
    )
    groups = materialize(groups, "groups")
    terms = kept.groupBy("lang").agg(F.sum(F.col("is_first").cast("long")).alias("terms"), F.sum("count").alias("lang_n"))
    known = groups.select("lang").distinct().join(terms, "lang", "left")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("terms") / F.lit(CHUNK)))
    known = known.select("lang", F.coalesce("terms", F.lit(0)).cast("long").alias("terms"), F.coalesce("lang_n", F.lit(0)).cast("long").alias("lang_n"), F.coalesce(chunks, F.lit(1)).cast("int").alias("chunks"))
    return groups, materialize(known, "languages")


def packed_vectors(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """A row per group and chunk of its language: the places and counts of its terms there, empty where it has none."""
    placed = kept.join(langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    chunk = Window.partitionBy("lang", "chunk")
    cells = placed.select("lang", "chunk", "source", "count", (F.dense_rank().over(chunk.orderBy("term")) - 1).alias("at"))
    vectors = cells.groupBy("lang", "chunk", "source").agg(F.collect_list(F.struct("at", "count")).alias("_v"))
    sizes = cells.groupBy("lang", "chunk").agg((F.max("at") + 1).alias("width"))
    grid = groups.join(langs, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    full = grid.join(sizes, ["lang", "chunk"], "left").join(vectors, ["lang", "chunk", "source"], "left")
    return full.select("lang", "source", "n", "g", "groups", "terms", "chunk", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce(F.col("_v.at"), F.array().cast("array<int>")).alias("at"), F.coalesce(F.col("_v.count"), F.array().cast("array<bigint>")).alias("count"))


def replicate(vectors: DataFrame) -> DataFrame:
    """Each packed vector to all tiles (``i`` <= ``j``) of its block of groups."""
    block = F.floor(F.col("g") / F.lit(BLOCK)).cast("int")
    last = F.floor((F.col("groups") - 1) / F.lit(BLOCK)).cast("int")
    to = vectors.withColumn("_own", block).withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    return to.select("*", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") == F.least("_own", "_other")).alias("first"))


class Tile:
    """The submatrix of one pair of blocks, chunk by chunk."""

    def __init__(self, row: dict) -> None:
        self.lang, self.i, self.j = row["lang"], row["i"], row["j"]
        self.source: dict[int, str] = {}
        self.sums: dict[int, np.ndarray] = {}

    def add(self, rows: list[dict]) -> None:
        """The rows of one chunk, in order of group; every group of both blocks has one."""
        count = np.zeros((len(rows), rows[0]["width"]), "int64")
        for k, r in enumerate(rows):
            count[k, r["at"]] = r["count"]
        p = shares(count, np.array([r["n"] for r in rows], "int64"), rows[0]["terms"]) if rows[0]["terms"] else count + 1
        cut = 0 if self.i == self.j else sum(r["first"] for r in rows)
        self.order = [r["g"] for r in rows]
        self.source.update((r["g"], r["source"]) for r in rows)
        for k, g in enumerate(self.order[: cut or len(rows)]):
            first = max(k + 1, cut)
            value = discrimination(p[k], p[first:])
            self.sums[g] = self.sums[g] + value if g in self.sums else value

    def rows(self) -> pa.RecordBatch:
        out = [(self.lang, self.source[g], self.source[h], int(v)) for g, values in self.sums.items() for h, v in zip(self.order[len(self.order) - len(values) :], values)]
        lang, a, b, value = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tile, held, now = None, [], None
    for batch in batches:
        ends = np.cumsum(batch.column("at").value_lengths().to_numpy())[:-1]
        at, count = (np.split(batch.column(c).flatten().to_numpy(), ends) for c in ("at", "count"))
        for k, row in enumerate(batch.drop_columns(["at", "count"]).to_pylist()):
            row |= {"at": at[k], "count": count[k]}
            key = (row["lang"], row["i"], row["j"], row["chunk"])
            if key != now:
                if held:
                    tile.add(held)
                if now is None or key[:3] != now[:3]:
                    if tile:
                        yield tile.rows()
                    tile = Tile(row)
                held, now = [], key
            held.append(row)
    if held:
        tile.add(held)
        yield tile.rows()


def pair_values(vectors: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of groups of a language."""
    prepare(vectors.sparkSession)
    order = ("lang", "i", "j", "chunk")
    tiles = replicate(vectors).select(*order, "g", "source", "n", "first", "terms", "width", "at", "count")
    parts = tiles.repartitionByRange(*order).sortWithinPartitions(*order, "g").mapInArrow(_tiles, "lang string, a string, b string, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("_p"), "value").select("lang", "_p.source", "_p.item", "value")


def typical_terms(kept: DataFrame, groups: DataFrame, langs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more than its language, ``top`` of each group."""
    known = kept.join(groups.select("lang", "source", "n"), ["lang", "source"]).join(langs, "lang")
    shared = known.select("lang", "source", F.col("term").alias("item"), share("count", "n", "terms").alias("p"), share("lang_count", "lang_n", "terms").alias("q")).filter("p > q")
    return ranked(shared.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))).filter(F.col("rank") <= top)


def ranked(values: DataFrame) -> DataFrame:
    return values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every other source of the language, ``term`` rows for the ``top`` terms."""
    kept = materialize(kept_counts(term_counts(df, text, lang, source), min_docs), "kept")
    groups, langs = group_sizes(df, kept, lang, source)
    vectors = materialize(packed_vectors(kept, groups, langs), "vectors")
    pairs = materialize(ranked(pair_values(vectors)), "pairs")
    discard(vectors)
    terms = typical_terms(kept, groups, langs, top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
ln AS (SELECT lang, sum(c) AS n FROM c GROUP BY lang),
lc AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lc.lang, lc.term, 1 + (1000000000::HUGEINT * (lc.c + 2)) // (ln.n + 2 * v.v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
