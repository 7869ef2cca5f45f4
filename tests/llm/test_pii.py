import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrail.llm import pii, queries

from .conftest import ODD


def plain_base(text):
    """The contract's patterns as they are written."""

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] * (12 <= len(d) <= 19 and luhn(d))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aZ9012.@@+- ()_%\n٣é"), max_size=60))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.mark.parametrize("text", ["a@b.c.d@e.f", "x..y@a-b.c", "@@a@b", "a@b@c.d", "1.2.3.4.5.6.7.8", "001.02.3.255 1.2.3.256", "4111 1111-1111 1111", "41111111111111111", "+49 (30) 123456", "+1+22 333 4444", "+12345678901234567"])
def test_base_cases(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.mark.parametrize("unit", ["1", "1.", "a", "a@", "+1", "1 ", " at ", "a.", "f:", "(1) ", "@a."])
def test_long_texts_take_linear_time(unit):
    text = unit * (200_000 // len(unit))
    assert isinstance(pii.candidates(text), list)


def texts():
    """Base matches, hidden forms and look-alikes among words; (text, hidden spans)."""
    rng = np.random.default_rng(5)
    words = "the of and contact please write number order house river green".split()
    out = []
    for i in range(900):
        before, after = " ".join(rng.choice(words, 6)), " ".join(rng.choice(words, 6))
        d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
        what = i % 9
        span = [
            f"ann{d(2)}@mail{d(1)}.example.com", f"{rng.integers(20, 255)}.{rng.integers(20, 255)}.1.{rng.integers(20, 255)}", f"+1 ({rng.integers(200, 999)}) 555-{d(4)}",
            f"bob{d(2)} [at] host{d(1)}.example [dot] com", f"ISBN 978{d(10)}", f"version {d(1)}.{d(1)}.{d(1)}.{d(1)}", f"order {d(3)} {d(4)}", f"cat{d(1)}@2x.png", "",
        ][what]
        if what == 4:
            n = d(15)
            span = "4" + n[:14] + next(c for c in "0123456789" if pii.luhn("4" + n[:14] + c))
        out.append((f"{before} {span} {after}", span if what == 3 else None))
    return out


def test_learned_spans(spark, corpus):
    rows = texts()
    docs = corpus([(i, t, "en", "s", 0) for i, (t, _) in enumerate(rows)])
    model = pii.learn(docs)
    for kind, table in model.reliability.items():
        assert (table[1, :, 2] * table[0, :, 0] >= table[0, :, 2] * table[1, :, 0] - 1e-12).all() and np.allclose(table.sum(axis=2), 1)
    found = {r.doc_id: r for r in pii.find(docs, model).collect()}
    hidden = [i for i, (_, s) in enumerate(rows) if s]
    caught = [i for i in hidden if any(found[i].text[s.start : s.end] == rows[i][1] and not s.base for s in found[i].pii)]
    assert len(caught) >= 0.9 * len(hidden)
    others = [i for i in range(len(rows)) if i % 9 in (6, 8)]
    assert sum(any(not s.base for s in found[i].pii) for i in others) <= 0.05 * len(others)
    for i, (t, _) in enumerate(rows):
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in found[i].pii if s.base] == plain_base(t)
    clean = {r.doc_id: r.text for r in pii.redact(pii.find(docs, model)).collect()}
    assert "[EMAIL]" in clean[hidden[0]] and "[dot]" not in clean[hidden[0]] and clean[8] == rows[8][0]


def test_estimation_recovers_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.85])
    votes = np.where(rng.random((20000, 6)) < right, truth[:, None] * 2, 2 - truth[:, None] * 2)
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, table, p = pii.estimate(patterns, n.astype(float))
    assert abs(share - 0.3) < 0.03 and np.abs(table[1, :, 2] - right).max() < 0.05
    assert ((p[at.ravel()] > 0.5) == truth).mean() > 0.95


def test_frames(odd, none, spark):
    model = pii.learn(none)
    assert model.weights == {} and pii.find(none, model).count() == 0
    df = odd.withColumn("pii", F.lit(3)).withColumn("text", F.concat("text", F.lit(" a@b.cd b [at] c [dot] com")))
    rows = pii.find(df, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.pii] == plain_base(r.text or "")
    assert sorted((r.text or "") for r in pii.redact(pii.find(odd, model)).collect()) == sorted((t or "") for _, t, *_ in ODD)
    both = spark.createDataFrame([("😀 x a@b.cd 1.2.3.4@e.fg",)], "text string")
    assert pii.redact(pii.find(both, model)).first().text == "😀 x [EMAIL] [EMAIL]"


def test_query_base_columns(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_personal_data"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id])
        spelt = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(spelt).encode()).hexdigest()
        assert set(spelt) <= set(r.spans.split(",")) or not spelt
