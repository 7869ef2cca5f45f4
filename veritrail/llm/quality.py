"""Quality rules: features of whole texts and a learned decision list, in DataFrame operations only.

``features`` counts what the rules look at. ``learn`` is sequential covering:
a rule is grown, condition by condition, by FOIL gain on two thirds of the
labelled rows, pruned to the prefix that does best on the other third, kept if
it is precise enough there, and the rows it covers leave before the next rule.
Every step is one aggregate of histograms (feature, bin) with a size that does
not depend on the number of rows. The result is an ordered list of threshold
conjunctions that becomes one Spark CASE expression.

Defined results: null, empty and word-free texts have zero counts and fail the
base rule; labels other than 0 and 1 and null ids teach nothing; of several
labels of one id the lowest counts; with no labelled row of either class the
list is empty and the base rule decides alone. Repeated rows are kept apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import WORD_SPACE, bucket_of_id
from veritrail.runtime import materialize

#: What the learned conditions compare with thresholds.
RATES = {
    "n_words": "cast(n_words AS double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
}
#: Candidate thresholds of a feature lie halfway between neighbours of this many quantiles of each class.
CUTS = 16
MAX_RULES = 8
MAX_CONDITIONS = 3
#: Share of low-quality rows that a rule must have on the pruning rows, and how many it must cover.
MIN_PRECISION = 0.9
MIN_COVER = 3
#: Rows of one id bucket out of this many are for pruning.
PRUNE_MOD = 3


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its counts; every count is over the whole text."""
    own = ("_w", "_l", "_h", "_s", "_p")
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "base_failed", "rule", "kept")
    docs = docs.drop(*[c for c in results if c in docs.columns])
    df = docs.withColumn("_w", F.coalesce(F.array_remove(F.split(F.col(text), WORD_SPACE), ""), F.array().cast("array<string>")))
    df = df.withColumn("_l", F.expr(f"filter(split(coalesce({text}, ''), '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"))
    df = df.withColumn("_h", F.expr("IF(size(_w) >= 3, transform(sequence(1, greatest(size(_w) - 2, 1)), i -> xxhash64(element_at(_w, i), element_at(_w, i + 1), element_at(_w, i + 2))), array())").cast("array<bigint>"))
    # Three-word windows in order of their hash, only where one occurs twice; then the places of those that do.
    kind = "array<struct<h:bigint,p:int>>"
    df = df.withColumn("_s", F.expr("IF(size(array_distinct(_h)) = size(_h), array(), sort_array(transform(_h, (h, p) -> struct(h, p))))").cast(kind))
    df = df.withColumn("_p", F.expr("IF(size(_s) = 0, array(), sort_array(transform(filter(sequence(0, greatest(size(_s) - 1, 0)), k -> get(_s, k).h <=> get(_s, k - 1).h OR get(_s, k).h <=> get(_s, k + 1).h), k -> get(_s, k).p)))").cast("array<int>"))
    repeat = "IF(size(_p) = 0, 0, aggregate(zip_with(slice(_p, 1, greatest(size(_p) - 1, 0)), slice(_p, 2, greatest(size(_p) - 1, 0)), (a, b) -> least(3, b - a)), 3, (s, x) -> s + x))"
    return df.select(
        *[c for c in docs.columns if c != text],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", "")), F.lit(0)).cast("long").alias("n_symbols"),
        F.expr("size(_l) - size(array_distinct(_l))").cast("long").alias("n_dup_lines"),
        F.expr(repeat).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    ).drop(*own)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{k}_r": F.expr(v) for k, v in RATES.items()}).drop(*RATES).withColumnsRenamed({f"{k}_r": k for k in RATES})


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 and p0 else 0.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule | None:
    chosen: list[Condition] = []
    while len(chosen) < MAX_CONDITIONS:
        part = rows.filter(" AND ".join(c.sql() for c in chosen)) if chosen else rows
        bins = F.array(*[F.struct(F.lit(i).alias("feature"), F.expr(" + ".join([f"CAST({f} > {c!r}D AS INT)" for c in cuts[f]] or ["0"])).alias("bin")) for i, f in enumerate(RATES)])
        counts = part.select("bad", F.explode(bins).alias("x")).groupBy("x.feature", "x.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        by = {(r.feature, r.bin): (r.p, r.n) for r in counts}
        p0, n0 = (sum(v[k] for (f, _), v in by.items() if f == 0) for k in (0, 1))
        if not p0 or not n0:
            break
        best: tuple[float, Condition] | None = None
        for i, f in enumerate(RATES):
            for j, cut in enumerate(cuts[f]):
                above = [sum(v[k] for (g, b), v in by.items() if g == i and b > j) for k in (0, 1)]
                for up, (p, n) in ((True, above), (False, (p0 - above[0], n0 - above[1]))):
                    if n < n0 and (g := _gain(p0, n0, p, n)) > (best[0] if best else 1e-9):
                        best = (g, Condition(f, up, cut))
        if best is None:
            break
        chosen.append(best[1])
    return Rule(tuple(chosen)) if chosen else None


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule with the best (p - n) / (p + n) on ``rows``, the shortest of equals."""
    prefixes = [Rule(rule.conditions[: k + 1]) for k in range(len(rule.conditions))]
    sums = [F.coalesce(F.sum(F.expr(f"CAST({r.sql()} AND bad = {v} AS LONG)")), F.lit(0)).alias(f"c{k}_{v}") for k, r in enumerate(prefixes) for v in (0, 1)]
    got = rows.agg(*sums).first()
    scored = [((got[f"c{k}_1"] - got[f"c{k}_0"]) / max(1, got[f"c{k}_1"] + got[f"c{k}_0"]), -k) for k in range(len(prefixes))]
    k = -max(scored)[1]
    return prefixes[k], got[f"c{k}_1"], got[f"c{k}_0"]


def learn(counted: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> list[Rule]:
    """The decision list; ``counted`` has the columns of :func:`features`, ``labels`` has doc_id and quality."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg((1 - F.min("quality")).cast("long").alias("bad"))
    rows = counted.filter(~base_failed()).join(known.withColumnRenamed("doc_id", "_label_id"), F.col(doc_id) == F.col("_label_id"))
    rows = materialize(_rates(rows).select("bad", (bucket_of_id(doc_id, PRUNE_MOD) == 0).alias("prune"), *RATES), "labelled")
    steps = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    at = rows.groupBy("bad").agg(*[F.percentile_approx(f, F.array(*map(F.lit, steps)), 2000).alias(f) for f in RATES]).collect()
    if len(at) < 2:
        return []
    marks = {f: sorted({float(x) for r in at for x in r[f] if math.isfinite(x)}) for f in RATES}
    cuts = {f: [(a + b) / 2 for a, b in zip(m, m[1:])] for f, m in marks.items()}  # the widest margin between quantiles
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = rows
        for r in rules:
            left = left.filter(f"NOT ({r.sql()})")
        grown = _grow(left.filter("NOT prune"), cuts)
        if grown is None:
            break
        rule, p, n = _prune(left.filter("prune"), grown)
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule that fires, as one CASE expression; null where none does."""
    if not rules:
        return F.lit(None).cast("string")
    out = None
    for r in rules:
        out = (F if out is None else out).when(F.expr(r.sql()), F.lit(r.sql()))
    return out


def judge(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add base_failed, rule (text of the rule that fired, or null) and kept."""
    helped = counted.select("*", F.struct(*[F.expr(v).alias(k) for k, v in RATES.items()]).alias("_r"))
    inner = verdict([Rule(tuple(Condition(f"_r.{c.feature}", c.above, c.cut) for c in r.conditions)) for r in rules])
    out = helped.withColumns({"base_failed": base_failed(), "rule": F.regexp_replace(inner, r"_r\.", "")})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop("_r")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdicts of all documents; features are computed once and written to the shared folder."""
    counted = materialize(features(docs), "features")
    return judge(counted, learn(counted, labels))
