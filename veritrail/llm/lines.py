"""Line deduplication by a suffix array over line ids, in DataFrame operations only.

The text of all documents, in order of id, is one sequence of line ids; lines
without a word are skipped. Prefix doubling ranks the suffixes: the rank at depth
1 is that of the line, the rank at depth 2d that of the pair of ranks at depth
d of a suffix and of the suffix d lines on. Ranks are order-preserving numbers
from a range-sorted table of the distinct pairs, so nothing passes through one
task. A pair that occurs once cannot be part of a repeated run and gets no
rank, so later rounds see fewer rows; rounds end when no pair occurs twice. All
suffixes with one rank at depth d are one interval of the suffix array whose
longest common prefix is d lines or more.

The length of the longest repeated run from each line follows by descent: from
its deepest interval, the ranks of half the depth, a quarter and so on narrow
the interval as long as two suffixes stay in it. A run is maximal if the run
from the line before is not one line longer. The first copy of a line (by id,
then place) stays and all later ones are deleted, in runs of any length: a line
stands in a later copy of a repeated run just where it occurs earlier itself.

Defined results: blank lines always stay; a null text stays null with no lines;
rows without an id come after all others; repeated rows are later copies of the
first; a run never goes on into the next document. Columns named like the
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.common import release, stable_rows
from veritrail.runtime import discard, materialize


def _line_table(docs: DataFrame) -> DataFrame:
    """One row per line with a word: f, i, o (id), k (number among them) and two hashes."""
    lines = F.expr("filter(split(text, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')")
    out = docs.filter("text IS NOT NULL").select("_rid.f", "_rid.i", F.col("_id").alias("o"), F.posexplode(lines).alias("k", "line"))
    return out.select("f", "i", "o", "k", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def _ranked(pairs: DataFrame, *more) -> DataFrame:
    """Ranks r of the pairs (a, b) that occur twice or more, in their order, with aggregates of their rows."""
    twice = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), *more).filter("n > 1").drop("n")
    return twice.orderBy("a", "b").withColumn("r", F.monotonically_increasing_id())


def _paired(level: DataFrame, d: int) -> DataFrame:
    """f, i, k and the ranks a, b at depth ``d`` of a suffix and of the one d lines on, where all between have a rank."""
    o = Window.partitionBy("f", "i").orderBy("k")
    both = level.select("f", "i", "k", F.col("r").alias("a"), F.when(F.lead("k", d).over(o) == F.col("k") + d, F.lead("r", d).over(o)).alias("b"))
    return both.filter("b IS NOT NULL")


def suffix_levels(first: DataFrame) -> list[DataFrame]:
    """Ranks at depth 1, 2, 4, ... of the suffixes whose run of that depth repeats: f, i, k, r each; ``first`` is depth 1."""
    levels, d = [first], 1
    while True:
        pairs = materialize(_paired(levels[-1], d), "pairs")
        deeper = materialize(pairs.join(_ranked(pairs), ["a", "b"]).select("f", "i", "k", "r"), "suffixes")
        discard(pairs)
        release(first.sparkSession)
        if deeper.isEmpty():
            discard(deeper)
            return levels
        levels.append(deeper)
        d *= 2


def run_lengths(levels: list[DataFrame]) -> DataFrame:
    """Longest repeated run from each line that repeats: f, i, k, c (lines)."""
    # One row per suffix and depth it reaches: c lines are known to repeat, and key tells their interval. Where
    # some of an interval go on and others stay, those that go on leave one of each new interval behind
    # (real is false), as what stays may share a shorter piece with it.
    here = None
    for j in range(len(levels) - 1, -1, -1):
        own = levels[j].select("f", "i", "k", F.lit(1 << j).alias("c"), F.col("r").alias("key"), F.lit(True).alias("real"))
        if here is None:
            here = materialize(own, "lengths")
            continue
        step = levels[j].select("f", "i", F.col("k").alias("at"), "r")
        met = materialize(here.withColumn("at", F.col("k") + F.col("c")).join(step, ["f", "i", "at"], "left").drop("at"), "met")
        longer = met.filter("r IS NOT NULL").groupBy("c", "key", "r").agg(F.count("*").alias("n"), F.min(F.struct("f", "i", "k")).alias("one")).filter("n > 1").drop("n")
        longer = materialize(longer.withColumn("new", F.monotonically_increasing_id()), "longer")
        moved = materialize(met.join(longer.drop("one"), ["c", "key", "r"], "left"), "moved")
        stay = moved.filter("real AND new IS NULL").select("c", "key").distinct()
        left = longer.select("one.*", "c", "key").unionByName(moved.filter("NOT real AND new IS NULL").select("f", "i", "k", "c", "key"))
        left = left.join(stay, ["c", "key"]).select("f", "i", "k", "c", "key", F.lit(False).alias("real"))
        moved = moved.filter("real OR new IS NOT NULL").select("f", "i", "k", F.when(F.col("new").isNotNull(), F.col("c") + (1 << j)).otherwise(F.col("c")).alias("c"), F.coalesce("new", "key").alias("key"), "real")
        old, here = [here, met, longer], materialize(moved.unionByName(left).unionByName(own), "lengths")
        for t in old:
            discard(t)
        release(here.sparkSession)
    return here.filter("real").groupBy("f", "i", "k").agg(F.max("c").alias("c"))


def later_copies(docs: DataFrame) -> DataFrame:
    """For each row with a line that repeats: f, i, gone (numbers, from 0, of the deleted lines among those with a word), runs, longest."""
    spark = docs.sparkSession
    lines = materialize(_line_table(docs), "lines")
    release(spark)
    place = F.struct(F.col("o").isNull().alias("u"), "o", "f", "i", "k")
    ranked = _ranked(lines, F.min(place).alias("first"))
    known = materialize(lines.join(ranked, ["a", "b"]).select("f", "i", "k", "r", (place != F.col("first")).alias("later")), "suffixes")
    discard(lines)
    release(spark)
    levels = suffix_levels(known.select("f", "i", "k", "r"))
    lengths = materialize(run_lengths(levels), "lengths")
    o = Window.partitionBy("f", "i").orderBy("k")
    longer_before = F.coalesce((F.lag("k").over(o) == F.col("k") - 1) & (F.lag("c").over(o) > F.col("c")), F.lit(False))
    marked = known.select("f", "i", "k", "later").join(lengths, ["f", "i", "k"]).withColumn("start", ~longer_before)
    gone = F.array_sort(F.collect_list(F.when(F.col("later"), F.col("k"))))
    out = materialize(marked.groupBy("f", "i").agg(gone.alias("gone"), F.count_if("start").alias("runs"), F.max("c").alias("longest")), "gone")
    for t in (known, lengths, *levels[1:]):
        discard(t)
    release(spark)
    return out


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with later copies of line runs cut from the text, and n_lines, n_removed, n_runs, longest_run."""
    own = ("n_lines", "n_removed", "n_runs", "longest_run", "_rid")
    rows = stable_rows(df.drop(*[c for c in own if c in df.columns]))
    gone = later_copies(rows.select("_rid", F.col(doc_id).alias("_id"), F.col(text).alias("text")))
    out = rows.join(gone.select(F.struct("f", "i").alias("_rid"), F.col("gone").alias("_gone"), F.col("runs").alias("_runs"), F.col("longest").alias("_longest")).hint("merge"), "_rid", "left").drop("_rid")
    out = out.withColumn("_lines", F.split(text, "\n")).withColumn("_with", F.expr("filter(transform(_lines, (l, j) -> IF(l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]', j, NULL)), j -> j IS NOT NULL)"))
    out = out.withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), transform(_gone, g -> element_at(_with, g + 1))), j -> element_at(_lines, j + 1)), '\\n')")
    return out.select(
        *[F.when(F.size("_gone") > 0, kept).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in df.columns if c not in own],
        F.coalesce(F.size("_with"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed"),
        F.coalesce("_runs", F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce("_longest", F.lit(0)).cast("long").alias("longest_run"),
    )


ORACLE = """
WITH RECURSIVE l AS (SELECT rid, doc_id, j, line, row_number() OVER (PARTITION BY rid ORDER BY j) - 1 AS k
  FROM (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j
    FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE text IS NOT NULL))
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, rid, k) AS g, min(rid * 1000000 + k) OVER (PARTITION BY line) AS id, count(*) OVER (PARTITION BY line) AS copies,
  row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, rid, k) > 1 AS later FROM l),
run AS (SELECT rid, k, g, 1 AS d, id AS same FROM n WHERE copies > 1
  UNION ALL SELECT rid, k, g, d, same FROM (
    SELECT run.rid, run.k, run.g, run.d + 1 AS d, min(run.g) OVER w AS same, count(*) OVER w AS copies
    FROM run JOIN n ON n.rid = run.rid AND n.k = run.k + run.d WINDOW w AS (PARTITION BY run.same, n.id)) WHERE copies > 1),
longest AS (SELECT rid, k, max(d) AS d FROM run GROUP BY rid, k),
s AS (SELECT a.rid, count(*) FILTER (WHERE b.d IS NULL OR b.d <= a.d) AS n_runs, max(a.d) AS longest_run FROM longest a LEFT JOIN longest b ON b.rid = a.rid AND b.k = a.k - 1 GROUP BY a.rid),
kept AS (SELECT a.rid, string_agg(line, chr(10) ORDER BY j) AS text
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j
    FROM (SELECT row_number() OVER () AS rid, text FROM documents WHERE text IS NOT NULL)) a
  LEFT JOIN (SELECT rid, j AS gj FROM n WHERE later) x ON x.rid = a.rid AND gj = j WHERE gj IS NULL GROUP BY a.rid),
c AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE later) AS n_removed FROM n GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  coalesce(longest_run, 0)::BIGINT AS longest_run, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents WHERE text IS NOT NULL UNION ALL SELECT NULL, doc_id FROM documents WHERE text IS NULL) d
LEFT JOIN c USING (rid) LEFT JOIN s USING (rid) LEFT JOIN kept USING (rid)
"""
