"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are maximal runs of characters outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``
after A-Z are lower-cased. Every ``K``-gram of words has a hash; of each
``SPAN - K + 1`` consecutive hashes the least is kept with its position (the
leftmost of equal ones). Two equal spans of ``SPAN`` words keep the same
fingerprint at the same place, so every shared span meets in the join of
document and benchmark fingerprints. A meeting is extended: the ``SPAN``-word
windows around it are compared as words, which also removes false meetings.

An item with fewer than ``SPAN`` words, but not none, is one window of its own
length; documents are then also fingerprinted at that length with windows of
one gram. Defined results: null, empty and word-free texts have no words and no
hits; benchmark rows with null text or null id are no items; repeated items
count once per item_id; an empty benchmark leaves all documents clean.

The benchmark side is broadcast only when its counted rows are at most
``BROADCAST_ROWS``; beyond that the same joins run as shuffled joins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import stable_rows, with_row_id
from veritrail.runtime import materialize

SPAN = 10
K = 5
BROADCAST_ROWS = 200_000
#: Low bits of a packed fingerprint hold the position, high bits order the hashes.
POSITION_BITS = 31

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WIDE_UPPER = r"[\P{ASCII}&&[\p{IsUppercase}\p{Lt}]]"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other characters as they are; ``lower`` serves where both agree."""
    return F.when(~text.rlike(_WIDE_UPPER), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), _NOT_WORD), ""), F.array().cast("array<string>"))


def _grams(n: int) -> str:
    return ", ".join(f"element_at(_w, i + {j})" if j else "element_at(_w, i)" for j in range(n))


def _candidates(lengths: list[int], wide: bool) -> Column:
    """Fingerprints of column ``_w`` as array of (len, key, start, ws); ws holds the words needed to extend."""
    parts = []
    for n in lengths:
        if n < SPAN:
            parts.append(
                F.expr(
                    f"IF(size(_w) >= {n}, transform(sequence(1, greatest(size(_w) - {n - 1}, 1)), i -> "
                    f"struct({n} AS len, shiftright(xxhash64({_grams(n)}), {POSITION_BITS}) AS key, i AS start, slice(_w, i, {n}) AS ws)), array())"
                )
            )
        else:
            parts.append(
                F.expr(
                    "IF(size(_w) >= {span}, transform(array_distinct(transform(sequence(1, greatest(size(_f) - {width} + 1, 1)), i -> array_min(slice(_f, i, {width})))), p -> "
                    "struct({span} AS len, shiftright(p, {bits}) AS key, greatest(cast(p & {mask} AS int) - {width} + 1, 1) AS start, "
                    "slice(_w, greatest(cast(p & {mask} AS int) - {width} + 1, 1), least(cast(p & {mask} AS int), {width}) + {span} - 1) AS ws)), array())".format(span=SPAN, width=SPAN - K + 1, bits=POSITION_BITS, mask=(1 << POSITION_BITS) - 1)
                )
            )
    kind = "array<struct<len:int,key:bigint,start:int,ws:array<string>>>"
    parts = [p.cast(kind) for p in parts]
    if wide:  # one row for every document, found or not; its key spreads such rows and meets nothing, as no mark has length 0
        parts.append(F.expr(f"array(struct(0 AS len, xxhash64(_rid) AS key, cast(null AS int) AS start, cast(null AS array<string>) AS ws))").cast(kind))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _fingerprinted(df: DataFrame, lengths: list[int], wide: bool) -> DataFrame:
    mask = (1 << 63) - (1 << POSITION_BITS)
    if SPAN in lengths:
        grams = F.expr(f"IF(size(_w) >= {K}, transform(sequence(1, greatest(size(_w) - {K - 1}, 1)), i -> ((xxhash64({_grams(K)}) & {mask}L) | i)), array())").cast("array<bigint>")
        df = df.withColumn("_f", grams)
    return df.select(*[c for c in df.columns if c not in ("_w", "_f", "text")], F.size("_w").alias("n_words"), F.explode(_candidates(lengths, wide)).alias("_c")).select("*", "_c.*").drop("_c")


def _windows() -> Column:
    """All windows of ``len`` words inside ``ws``, with their first word's place in the text."""
    return F.expr("transform(sequence(0, greatest(size(ws) - len, 0)), o -> struct(start + o AS at, array_join(slice(ws, o + 1, len), ' ') AS win))")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hits(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences of benchmark windows, and the windows themselves.

    The first table has, for each document row (``_rid``, the row's other
    columns but the text, ``n_words``), one row with null ``win`` and one row
    per occurrence: ``at`` (first word, from 1), ``len`` (words) and ``win``.
    The second has ``win`` and ``item_id``.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("_w")).filter("item_id IS NOT NULL AND size(_w) > 0")
    windows = materialize(
        items.select("item_id", F.least(F.size("_w"), F.lit(SPAN)).alias("len"), "_w")
        .select("item_id", "len", F.explode(F.expr("transform(sequence(1, size(_w) - len + 1), i -> array_join(slice(_w, i, len), ' '))")).alias("win"))
        .distinct(),
        "windows",
    )
    rows = windows.count()
    lengths = sorted(r.len for r in windows.select("len").distinct().collect()) or [SPAN]  # SPAN values at most
    marks = materialize(
        _fingerprinted(items.select("_w"), lengths, False).join(items.select(F.size("_w").alias("n_words"), F.least(F.size("_w"), F.lit(SPAN)).alias("own")).distinct(), "n_words").filter("len = own").select("len", "key").distinct(),
        "marks",
    ).withColumn("met", F.lit(True))
    documents = documents if "_rid" in documents.columns else with_row_id(documents)
    docs = documents.withColumn("_w", words(F.col("text"))).drop("text")
    found = _fingerprinted(docs, lengths, True).join(_bounded(marks, rows), ["len", "key"], "left").filter("met OR len = 0")
    spread = found.withColumn("_x", F.explode_outer(_windows())).select("*", "_x.at", F.coalesce("_x.win", F.col("key").cast("string")).alias("win")).drop("_x", "ws", "key", "start", "met")
    known = windows.select("win", "len").distinct().withColumn("met", F.lit(True))
    met = spread.join(_bounded(known, rows), ["win", "len"], "left").filter("met OR len = 0").drop("met")
    return met.withColumn("win", F.when(F.col("len") > 0, F.col("win"))), windows


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: its columns but the text, n_words, n_hit, n_items, items (array of ids), contaminated."""
    names = [c for c in documents.columns if c not in ("text", "n_words", "n_hit", "n_items", "items", "contaminated")]
    keep = [f"_k{i}" for i in range(len(names))]  # no column of the caller's meets one of ours
    occurrences, windows = hits(documents.select(*[F.col(c).alias(k) for c, k in zip(names, keep)], "text"), benchmark)
    occurrences = materialize(occurrences, "hits")
    # Words in the union of [at, at + len): sorted starts, then one fold with the end of what is covered.
    covered = F.expr(
        "aggregate(array_sort(collect_set(IF(win IS NULL, NULL, struct(at, len)))), struct(0 AS n, 0 AS upto), "
        "(s, x) -> struct(s.n + greatest(x.at + x.len - greatest(x.at, s.upto), 0) AS n, greatest(s.upto, x.at + x.len) AS upto), s -> s.n)"
    )
    spans = occurrences.groupBy("_rid", *keep, "n_words").agg(covered.cast("long").alias("n_hit"))
    items = (
        occurrences.filter("win IS NOT NULL").select("_rid", "win").distinct().join(windows.select("win", "item_id"), "win").select("_rid", "item_id").distinct()
        .groupBy("_rid").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    )
    out = spans.join(items, "_rid", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, keep)], F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no benchmark window occurs, with all their columns."""
    rows = stable_rows(documents)
    found, _ = hits(rows.select("_rid", "text"), benchmark)
    return rows.join(materialize(found.filter("win IS NOT NULL").select("_rid").distinct(), "contaminated"), "_rid", "left_anti").drop("_rid")


def oracle_words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {oracle_words('text')} AS w FROM documents),
b AS (SELECT item_id, {oracle_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS n, unnest([array_to_string(w[i : i + least(len(w), {SPAN}) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), {SPAN}) + 2)]) AS win FROM b WHERE len(w) > 0),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
