"""Near-duplicate join on word n-grams: MinHash bands find candidates, full n-gram sets verify them.

Texts are sets of ``GRAM``-word n-grams (hashed to 64 bits); words are those of
benchmark decontamination. Rows with equal sets are one class of copies from
the start and only its representative goes on, with its number of rows. Bands
and rows per band come from :func:`plan`, for a target recall at the threshold.
Band hashes are shuffled; a bucket links its members to its least member, and
connected buckets form candidate groups, a superset of all linked pairs that
the bands can find. Groups are cut into blocks of bounded size, each pair of
blocks goes to one task, and there every pair of texts is verified exactly. A
task returns, per text, its number of links and one link into its local
component, so the output grows with texts, not with pairs.

Defined results: a text of 1 to ``GRAM`` - 1 words is one n-gram of all its
words; null, empty and word-free texts are alone in their class and have no
links; repeated rows are copies of each other; ties of similarity at the
threshold count as similar. ``class_id`` is the least id of a class; ``n_links``
counts the other rows whose set is similar, copies included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import prepare, release, stable_rows
from veritrail.llm.components import components
from veritrail.llm.windows import U, _splitmix, mix
from veritrail.llm.winnow import oracle_words
from veritrail.runtime import discard, materialize

GRAM = 5
#: Similar means 5 * |A and B| >= 4 * |A or B|.
THRESHOLD = (4, 5)
RECALL = 0.99999
#: n-grams and texts of one block of a candidate group, at most on average.
BLOCK_GRAMS = 1_000_000
BLOCK_TEXTS = 1_000

_TABLE = bytes(c if c >= 0x80 or 97 <= c <= 122 or 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_CODE = _splitmix(256, 3) | U(1)
_POWERS = np.multiply.accumulate(np.r_[U(1), np.full(4095, int(_splitmix(1, 9)[0]) | 5, U)])


def plan(threshold: float = THRESHOLD[0] / THRESHOLD[1], recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """Bands needed so that a pair at the threshold meets in one with probability ``recall``, and rows of a band."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands, rows


BANDS, ROWS = plan()
_MULTIPLY = _splitmix(BANDS * ROWS, 21) | U(1)
_ADD = _splitmix(BANDS * ROWS, 22)


def _word_hashes(text: str, table: bytes = _TABLE) -> np.ndarray:
    """64-bit hashes of the words, tile by tile; ``table`` makes spaces of the bytes between words."""
    raw = text.encode().translate(table)
    out = []
    for lo in range(0, len(raw), 1 << 22):
        hi = min(len(raw), lo + (1 << 22))
        while lo and lo < hi and raw[lo - 1] != 32 and raw[lo] != 32:
            lo += 1  # the tile before has the rest of this word
        while hi < len(raw) and raw[hi - 1] != 32 and raw[hi] != 32:
            hi += 1
        x = np.frombuffer(raw[lo:hi], "uint8")
        word = x != 32
        start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
        if not len(start):
            continue
        letters = x[word]
        length = np.add.reduceat(word, start, dtype=np.int64)
        first = np.cumsum(length) - length
        place = np.arange(len(letters)) - np.repeat(first, length)
        if place.max() >= len(_POWERS):
            place %= len(_POWERS)
        out.append(mix(np.add.reduceat(_CODE[letters] * _POWERS[place], first) + length.astype(U)))
    return np.concatenate(out) if out else np.zeros(0, U)


def gram_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text."""
    w = _word_hashes(text or "")
    n = min(GRAM, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, U)
    for j in range(n):
        h = mix(h + w[j : len(w) - n + 1 + j])
    return np.unique(h)


def _bands(grams: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, U)
    for lo in range(0, len(grams), 2048):
        least = np.minimum(least, (grams[lo : lo + 2048, None] * _MULTIPLY + _ADD).min(axis=0))
    h = np.arange(1, BANDS + 1, dtype=U)
    for j in range(ROWS):
        h = mix(h + least.reshape(BANDS, ROWS)[:, j])
    return h


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids: list[list] = [[], [], []]
        bands = []
        for text in batch.column("text").to_pylist():
            g = gram_set(text)
            ids[0].append(int(mix(g).sum().view("int64")) if len(g) else 0)
            ids[1].append(int(np.bitwise_xor.reduce(mix(g + U(77))).view("int64")) if len(g) else 0)
            ids[2].append(len(g))
            bands.append(_bands(g).view("int64") if len(g) else [])
        yield pa.RecordBatch.from_arrays([batch.column("_rid"), batch.column("_id"), *[pa.array(x, pa.int64()) for x in ids], pa.array(bands, pa.list_(pa.int64()))], names=["_rid", "_id", "k1", "k2", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [gram_set(t).tobytes() for t in batch.column("text").to_pylist()]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sets, pa.binary())], names=[*keep, "grams"])


def _similar(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of which pairs of sets are similar, from sums of shared n-grams by matrix products."""
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(common) - 1
    hit = common[place]
    owner, place = owner[hit], column[place[hit]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    shared = np.zeros((len(sets), len(sets)), "float32")
    width = max(256, min(4096, 8_000_000 // len(sets)))
    for lo in range(0, int(common.sum()), width):
        a, b = np.searchsorted(place, (lo, lo + width))
        m = np.zeros((len(sets), min(width, int(common.sum()) - lo)), "float32")
        m[owner[a:b], place[a:b] - lo] = 1
        shared += m @ m.T
    up, down = THRESHOLD
    inter = np.rint(shared).astype("int64")
    out = down * inter >= up * (sizes[:, None] + sizes[None, :] - inter)
    np.fill_diagonal(out, False)
    return out


def _verified(rows: list[dict], p: int, q: int) -> Iterator[tuple]:
    """Of each text of a pair of blocks: links found here (rows on the other side) and a linked node of its local component."""
    if len(rows) < 2:
        return
    pairs = _similar([np.frombuffer(r["grams"], U) for r in rows])
    block = np.array([r["block"] for r in rows])
    if p != q:
        pairs &= block[:, None] != block[None, :]
    mult = np.array([r["mult"] for r in rows])
    links = pairs @ mult
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(pairs, label[None, :], len(rows)).min(axis=1))
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(links):
        yield (*rows[i]["node"].values(), *rows[label[i]]["node"].values(), int(links[i]))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and pair of blocks; one pair of blocks is held at a time."""
    held: list[dict] = []
    key = None

    def out(found):
        kinds = [pa.int64()] * 5
        columns = list(zip(*found)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a1", "a2", "b1", "b2", "links"])

    found: list[tuple] = []
    for batch in batches:
        for r in batch.to_pylist():
            k = (r["component"]["k1"], r["component"]["k2"], r["p"], r["q"])
            if k != key:
                if key:
                    found.extend(_verified(held, *key[2:]))
                held, key = [], k
                if len(found) > 20_000:
                    yield out(found)
                    found = []
            held.append(r)
    if key:
        found.extend(_verified(held, *key[2:]))
    yield out(found)


def similar_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Class and number of links of each row: _rid, _id, class_id, class_node (of null ids too), n_links, n_grams."""
    spark = df.sparkSession
    prepare(spark)
    docs = (df if "_rid" in df.columns else stable_rows(df)).select("_rid", F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    rid = "struct<f:long,i:long>"
    signed = materialize(docs.mapInArrow(_signatures, f"_rid {rid}, _id {docs.schema['_id'].dataType.simpleString()}, k1 long, k2 long, n long, bands array<long>").withColumn("node", F.struct("k1", "k2")), "signatures")
    classes = materialize(signed.filter("n > 0").groupBy("node").agg(F.count("*").alias("mult"), F.min("_id").alias("least"), F.first("n").alias("n"), F.min("_rid").alias("_rid"), F.first("bands").alias("bands")), "classes")
    release(spark)
    banded = classes.select("node", F.explode("bands").alias("band"))
    lead = banded.groupBy("band").agg(F.count("*").alias("c"), F.min("node").alias("v")).filter("c > 1").select("band", "v")
    groups = materialize(components(banded.join(lead, "band").select(F.col("node").alias("u"), "v")), "groups")
    release(spark)
    # Blocks of groups; each text goes to the pairs of blocks that its own is part of.
    sized = classes.select("node", "mult", "n", "_rid").join(groups, "node")
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("nb"))
    placed = sized.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    fetched = materialize(docs.select("_rid", "text").join(placed, "_rid").select("component", "node", "mult", "nb", "block", "text").mapInArrow(_sets, "component struct<k1:long,k2:long>, node struct<k1:long,k2:long>, mult long, nb int, block int, grams binary"), "sets")
    release(spark)
    paired = fetched.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "mult", "block", "grams")
    found = materialize(paired.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q").mapInArrow(_verify, "a1 long, a2 long, b1 long, b2 long, links long"), "links")
    node = lambda x: F.struct(F.col(f"{x}1").alias("k1"), F.col(f"{x}2").alias("k2"))
    linked = found.groupBy(node("a").alias("node")).agg(F.sum("links").alias("links"))
    classed = components(found.select(node("a").alias("u"), node("b").alias("v")))
    release(spark)
    whole = classes.select("node", "mult", "least").join(classed, "node", "left").join(linked, "node", "left").withColumn("class_node", F.coalesce("component", "node")).drop("component")
    names = whole.groupBy("class_node").agg(F.min("least").alias("class_id"))
    whole = materialize(whole.join(names, "class_node").select("node", "class_node", "class_id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classed")
    release(spark)
    for t in (fetched, groups, classes):
        discard(t)
    out = signed.filter("n > 0").select("_rid", "_id", "n", "node").join(whole, "node")
    alone = signed.filter("n = 0").select("_rid", "_id", F.col("_id").alias("class_id"), F.struct(F.col("_rid.f").alias("k1"), F.col("_rid.i").alias("k2")).alias("class_node"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_grams"))
    return out.select("_rid", "_id", "class_id", "class_node", "n_links", F.col("n").alias("n_grams")).unionByName(alone)


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each class the row with the least id stays."""
    rows = stable_rows(df)
    classes = similar_classes(rows, doc_id, text)
    first = classes.groupBy("class_node", F.col("n_grams") > 0).agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_rid"))).alias("x")).select("x._rid")
    return rows.join(materialize(first, "kept"), "_rid", "left_semi").drop("_rid")


ORACLE = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {oracle_words('text')} AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT rid, w[i : i + n - 1] AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT rid, w, least(len(w), {GRAM}) AS n FROM d WHERE len(w) > 0))),
size AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
pair AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pair JOIN size a ON a.rid = x JOIN size b ON b.rid = y WHERE {THRESHOLD[1]} * c >= {THRESHOLD[0]} * (a.n + b.n - c)),
reach AS (SELECT rid AS x, rid AS y FROM size UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
class AS (SELECT x AS rid, min(doc_id) AS class_id FROM reach JOIN d ON d.rid = reach.y GROUP BY x),
degree AS (SELECT x AS rid, count(*) AS n FROM link GROUP BY x)
SELECT doc_id, coalesce(class_id, doc_id)::BIGINT AS class_id, coalesce(degree.n, 0)::BIGINT AS n_links, coalesce(size.n, 0)::BIGINT AS n_grams
FROM d LEFT JOIN class USING (rid) LEFT JOIN degree USING (rid) LEFT JOIN size USING (rid)
"""
