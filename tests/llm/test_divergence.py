import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import divergence

from .conftest import ODD


def plain(rows, min_docs, top):
    """Whole-number sums over Python dictionaries; rows are (text, lang, source)."""
    lower = {i: i + 32 for i in range(65, 91)}
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = re.findall(divergence.TERM, (text or "").translate(lower))
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        size = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 2) // (size[s] + 2 * len(kept)) for t in kept} for s in sources}
        whole, total = Counter(), sum(size.values())
        for s in sources:
            whole.update(count[lang, s])
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            found = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, v, k) for k, (v, o) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1)]
            q = {t: 1 + 10**9 * (whole[t] + 2) // (total + 2 * len(kept)) for t in kept}
            found = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, v, k) for k, (v, t) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top], 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("block,chunk", [(2, 3), (32, 2048)])
def test_equals_plain_sums(spark, corpus, monkeypatch, block, chunk):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    words = "Ähre alpha Beta beta gamma ǅ x y z the and of o'clock".split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, 12)), rng.choice(["en", "de"]), f"s{rng.integers(7)}") for i in range(120)]
    rows += [(500, "only here", "fr", "a"), (501, None, "fr", None), (502, "", None, None), (503, "12 34", "en", "silent"), (503, "12 34", "en", "silent")]
    df = corpus([(*map(lambda v: v if v is None or isinstance(v, int) else str(v), r), 0) for r in rows])
    clash = df.withColumn("term", F.lit(1)).withColumn("count", F.lit("x")).withColumn("rank", F.lit(None).cast("int"))
    assert got(divergence.audit(clash, min_docs=4, top=3)) == plain([r[1:] for r in rows], 4, 3)


def test_odd_rows(odd, none):
    assert got(divergence.audit(odd, min_docs=2)) == plain([r[1:4] for r in ODD], 2, 10)
    assert got(divergence.audit(odd)) == plain([r[1:4] for r in ODD], 10, 10)
    assert divergence.audit(none).count() == 0


def test_shares_are_exact_beyond_64_bit_products():
    count, total = np.array([[9 * 10**14, 7, 0]]), np.array([10**15 - 3])
    assert divergence.shares(count, total, 3).tolist() == [[1 + 10**9 * (c + 2) // (10**15 - 3 + 6) for c in (9 * 10**14, 7, 0)]]
