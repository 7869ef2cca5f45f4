"""Toxic passages as maximal scoring segments of token log-odds, calibrated by extreme-value theory.

Training counts, for each token, the toxic and the clean labelled texts that have
it and takes the log-odds of the two classes under an informative Dirichlet
prior (pseudo-counts in proportion to the token's share of all counts). A token
is a candidate if half its likelihood ratio exceeds ln V, that of the largest of
V chance values, V being the number of tokens. Near copies of one document make
candidates of words that merely stand in it, so candidates are counted again,
once per token before them and class: copies repeat such pairs, a word that is
itself toxic occurs in many. Candidates that pass the same test again, and whose
log-odds less two standard errors reach ``MIN_ODDS``, keep a score of their own;
all others share one score, the log-odds of the pooled
rest. Scoring scans each whole
text once (Ruzzo and Tompa) and finds all maximal scoring segments in linear
time. A segment of score S in a text of n tokens is expected K*n*exp(-lambda*S)
times in clean text (Karlin and Altschul); lambda solves sum p*exp(lambda*s) = 1
over clean tokens, K is the rate of segments in clean training documents.
Segments expected less than ``MAX_EXPECTED`` times are significant, and their
sum statistic turns the prior odds of the class into the document's score.

Defined results: null, empty and token-free texts have no segments and score
the prior share of toxic documents scaled below ``THRESHOLD``; without labels
of both classes every score is 0; rows are scored one by one, so repeated rows
give repeated results. Of several labels of one id the highest counts.

The model is fitted on about ``MAX_LABELLED`` labelled rows at most (those with the
least hash of their id) and keeps at most ``MAX_TOKENS`` tokens, which bounds
what goes to the workers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import bucket_of_id, extended, hash_below, prepare, slices
from veritrail.runtime import materialize

MAX_LABELLED = 200_000
#: Pseudo-counts of the prior, as a share of all counted tokens.
PRIOR_SHARE = 0.1
MIN_ODDS = 1.0
MAX_EXPECTED = 0.05
THRESHOLD = 0.3
#: Remainder of the id hash whose rows are held out of training.
HELD_MOD, HELD = 4, 2

_TABLE = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case runs of letters (ASCII letters and all characters beyond ASCII)."""
    return (text or "").lower().encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Model:
    scores: dict[bytes, float]
    other: float
    rate: float  # lambda
    k: float
    prior: float


def segments(values: list[tuple[int, float]], n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as first token, token after the last, and score.

    ``values`` has place and score of the tokens with a score of their own, in
    order; the ``n - len(values)`` others count ``other`` (not above 0) each.
    """
    found: list[list[float]] = []  # first, end, sum before, sum through
    total, at = 0.0, 0
    for place, s in values:
        total += (place - at) * other
        at = place + 1
        before, total = total, total + s
        if s <= 0:
            continue
        new = [place, at, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in found]


def log_evidence(scores: list[float], n: int, rate: float, k: float) -> float:
    """-ln of the chance that a clean text of ``n`` tokens has so high a sum of its r best segments, for the best r."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        x = rate * s - math.log(k * n)
        if x <= 0:
            break
        total += x
        best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def assess(text: str | None, model: Model) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Score of a text and its significant segments with the number expected in clean text."""
    words = tokens(text)
    get = model.scores.get
    found = segments([(i, s) for i, w in enumerate(words) if (s := get(w)) is not None], len(words), model.other)
    n = max(1, len(words))
    marked = [(a, b, s, e) for a, b, s in found if (e := model.k * n * math.exp(-model.rate * s)) < MAX_EXPECTED]
    logit = math.log(model.prior / (1 - model.prior)) + log_evidence([s for _, _, s, _ in marked], n, model.rate, model.k)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, logit)))), marked


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *[pa.array([c[w] for w in words], pa.int64()) for c in counts]], names=["token", "clean", "toxic"])

    for part in slices(batches, "text"):
        for t, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
            counts[y].update(set(tokens(t)))
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield from out()
            counts = (Counter(), Counter())
    yield from out()


def _rate(weights: list[tuple[float, float]]) -> float:
    """The positive root of sum p * exp(x * s) = 1."""
    f = lambda x: sum(p * math.exp(min(700.0, x * s)) for p, s in weights) - 1
    lo, hi = 0.0, 0.01
    while f(hi) < 0 and hi < 100:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labelled rows of ``docs`` (doc_id, text) that are not held out."""
    prepare(docs.sparkSession)
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(bucket_of_id("doc_id", HELD_MOD) != HELD)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    if total > MAX_LABELLED:
        known = known.filter(hash_below("doc_id", MAX_LABELLED, total))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.select("text", "toxic")
    counts = rows.mapInArrow(_count, "token binary, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "token-counts")
    n_clean, n_toxic, distinct = counts.agg(F.sum("clean"), F.sum("toxic"), F.count("*")).first()
    by_class = dict(known.groupBy("toxic").count().collect())
    if not n_clean or not n_toxic:
        return None
    prior = PRIOR_SHARE * (n_clean + n_toxic)
    a = F.lit(PRIOR_SHARE) * (F.col("clean") + F.col("toxic"))
    odds = F.log((F.col("toxic") + a) / (n_toxic + prior)) - F.log((F.col("clean") + a) / (n_clean + prior))
    error = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    seen = F.col("toxic") + F.col("clean")
    half = lambda n, share: F.when(n > 0, n * F.log(n / (seen * share))).otherwise(0.0)
    ratio = half(F.col("toxic"), n_toxic / (n_toxic + n_clean)) + half(F.col("clean"), n_clean / (n_toxic + n_clean))
    chance = (ratio >= math.log(max(2, distinct))) & (odds > 0)
    sought = materialize(counts.filter(chance).select("token"), "sought")  # its size decides how the join is made

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            pairs = set()
            for t, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                words = tokens(t)
                pairs.update(zip(words, [b"", *words], repeat(y)))
            w, before, y = zip(*pairs) if pairs else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(before, pa.binary()), pa.array(y, pa.int32())], names=["token", "before", "toxic"])

    apart = rows.mapInArrow(contexts, "token binary, before binary, toxic int").join(sought, "token", "left_semi").distinct().groupBy("token").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    top = apart.filter(chance & (odds - 2 * error >= MIN_ODDS)).select("token", "clean", "toxic", odds.alias("odds")).orderBy("token").collect()
    share = PRIOR_SHARE
    rest_clean = max(1, n_clean - sum(r.clean for r in top))
    rest_toxic = max(1, n_toxic - sum(r.toxic for r in top))
    pool = share * (rest_clean + rest_toxic)
    other = min(-1e-6, math.log((rest_toxic + pool) / (n_toxic + prior)) - math.log((rest_clean + pool) / (n_clean + prior)))
    weights = [((r.clean + share * (r.clean + r.toxic)) / (n_clean + prior), r.odds) for r in top] + [((rest_clean + pool) / (n_clean + prior), other)]
    scores = {bytes(r.token): r.odds for r in top}
    rate = _rate(weights)

    def clean_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for part in slices(batches, "text"):
            for t in part.column("text").to_pylist():
                words = tokens(t)
                total += len(words)
                n += len(segments([(i, s) for i, w in enumerate(words) if (s := scores.get(w)) is not None], len(words), other))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    found, total = rows.filter("toxic = 0").mapInArrow(clean_segments, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    toxic, clean = by_class.get(1, 0), by_class.get(0, 0)
    return Model(scores, other, rate, (1 + found) / max(1, total), min(THRESHOLD * 0.9, max(1e-4, toxic / (toxic + clean))))


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score", spans: str = "segments") -> DataFrame:
    """Add ``out`` (0 to 1) and ``spans`` (significant passages by token: first, end, score, expected)."""
    prepare(df.sparkSession)
    df = df.drop(*[c for c in (out, spans) if c in df.columns])
    schema = extended(df, **{out: "double", spans: "array<struct<first:int,end:int,score:double,expected:double>>"})
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            got = [(0.0, []) if model is None else assess(t, model) for t in part.column(text).to_pylist()]
            found = [[{"first": a, "end": b, "score": s, "expected": e} for a, b, s, e in marked] for _, marked in got]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.float64()), pa.array(found, kind)], names=[*part.schema.names, out, spans])

    return df.mapInArrow(run, schema)
