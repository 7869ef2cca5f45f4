"""Learned scorers: held-out accuracy and defined results."""

import random

import public_tokenizers as P
import pytest

from veritrail.llm import langid, toxicity
from veritrail.llm.common import bucket_of_id_py

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


def brute_segments(scores):
    """Maximal scoring segments by their definition: split at the best segment, again and again."""
    best = None
    for i in range(len(scores)):
        s = 0
        for j in range(i, len(scores)):
            s += scores[j]
            if s > 1e-12 and (best is None or s > best[2] + 1e-9 or abs(s - best[2]) <= 1e-9 and j - i < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return brute_segments(scores[:i]) + [(i, j + 1, s)] + [(a + j + 1, b + j + 1, x) for a, b, x in brute_segments(scores[j + 1 :])]


def test_segments_like_the_definition():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 14)
        own = {i: rng.uniform(-3, 4) for i in range(n) if rng.random() < 0.5}
        got = toxicity.segments(sorted(own.items()), n, -0.4)
        want = brute_segments([own.get(i, -0.4) for i in range(n)])
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in want]


def test_toxic(corpus, odd, none):
    rng = random.Random(2)
    pool = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(800)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        t = rng.choices(pool, k=rng.randint(30, 80))
        for _ in range(rng.randint(1, 4) if bad else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["Vile!", "nasty", "awful"]))
        rows.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs, lab = corpus(rows), corpus([*labels, (None, 1, 1), (3, 1, None)], "labels", "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, lab)
    assert {b"vile", b"nasty", b"awful"} <= set(model.scores) and model.rate == pytest.approx(1, abs=0.05)
    out = toxicity.score(docs.withColumnRenamed("lang", "segments"), model).collect()
    held = [(r.score >= toxicity.THRESHOLD) == (r.doc_id % 6 == 0) for r in out if bucket_of_id_py(r.doc_id, 4) == 2]
    assert len(held) > 100 and sum(held) / len(held) > 0.98
    assert all(0 <= r.score < toxicity.THRESHOLD for r in toxicity.score(odd, model).collect())
    assert toxicity.learn(docs, lab.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_language(corpus, odd, none):
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "ou", "er", "st"], "bb": ["der", "sch", "ü", "ung", "ei"], "cc": ["ción", "ña", "los", "qu", "ar"]}
    rows = []
    for i in range(240):
        lang = sorted(parts)[i % 3]
        t = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(25))
        rows.append((i, t, lang if i % 7 else None, "s", 0))
    docs = corpus(rows)
    model = langid.learn(docs, VOCABULARY)
    out = langid.identify(docs, model, VOCABULARY).collect()
    assert all(r.lang_pred == sorted(parts)[r.doc_id % 3] and 0.5 < r.score <= 1 for r in out)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, model, VOCABULARY).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und")} <= got
    assert {r.lang_pred for r in langid.identify(odd, None, VOCABULARY).collect()} == {"und"}
    assert langid.learn(none, VOCABULARY) is None and langid.identify(none, model, VOCABULARY).count() == 0


def test_forward_sums_all_segmentations():
    import numpy as np

    lat = langid.lattice(open(VOCABULARY, "rb").read())
    probs = np.random.default_rng(0).random((lat.size, 2)) / lat.size
    batch = [b" the", b"ab", b"x"]
    w, a, b, p, lengths = lat.edges(batch)
    sums = lat.forward(batch, probs)
    for k, word in enumerate(batch):
        edges = [(int(i), int(j), int(q)) for ww, i, j, q in zip(w, a, b, p) if ww == k]

        def ways(at):
            return 1.0 if at == len(word) else sum(probs[q, 1] * ways(j) for i, j, q in edges if i == at)

        assert sums[k, lengths[k], 1] == pytest.approx(ways(0))


def test_errors_stay_what_they_are(spark):
    """Keys for rows of any table, and an error of analysis after it is still one."""
    from pyspark.errors import AnalysisException

    from veritrail.llm.common import stable_rows

    made = stable_rows(spark.range(5).selectExpr("id AS doc_id"))
    assert made.select("_rid").distinct().count() == 5
    with pytest.raises(AnalysisException):
        made.select("no_such_column").collect()


def test_text_ids(spark):
    from veritrail.llm import similar

    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([("b", text), ("a", text), ("c", "another text of its own with some more words"), (None, None)], "doc_id string, text string")
    got = {r._id: (r.class_id, r.n_links) for r in similar.similar_classes(rows).collect()}
    assert got["a"] == got["b"] == ("a", 1) and got["c"] == ("c", 0)
    assert sorted((r.doc_id or "") for r in similar.keep_one(rows).collect()) == ["", "a", "c"]
