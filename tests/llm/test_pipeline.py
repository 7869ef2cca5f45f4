"""Every stage of the corpus pipeline against a plain version of itself, each on its own input."""

import base64
import math
import re
from collections import Counter

import public_tokenizers as P
import pytest
import regex
import tiktoken

import corpus_pipeline as pipeline
from veritrail.llm import bpe, langid

from .test_exact import words

DATA = "/root/testdata/sf0.001"
RAW = open(P.path(pipeline.VOCABULARY), "rb").read()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and of what each stage returns, written and read again in between."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    assert all(list(rows[0].asDict()) == pipeline.COLUMNS for rows in out[:-1])
    return out


def kept(rows):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)


def test_language(spark, stages):
    model = langid.learn(spark.read.parquet(f"{DATA}/documents.parquet"), P.path(pipeline.VOCABULARY))
    number = {b: i for i, b in enumerate(sorted(bpe.read_ranks(RAW)))}
    known = {}

    def log_sums(w):
        if w not in known:
            up = [[1.0] * len(model.langs)] + [[0.0] * len(model.langs) for _ in w]
            for e in range(1, len(w) + 1):
                for a in range(max(0, e - 33), e):
                    if (p := number.get(w[a:e])) is not None:
                        up[e] = [x + y * q for x, y, q in zip(up[e], up[a], model.probs[p])]
            known[w] = [math.log(x) for x in up[-1]]
        return known[w]

    def stays(text):
        if not text or not regex.search(r"\p{L}", text):
            return False
        parts = re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())
        total = [sum(x) for x in zip(model.priors, *(log_sums(b" " + w) for w in parts))]
        return 1 / sum(math.exp(x - max(total)) for x in total) >= pipeline.MIN_SURE

    assert kept(stages[1]) == kept(r for r in stages[0] if stays(r.text))


def test_line_dedup(stages):
    seen, want = set(), Counter()
    for r in sorted(stages[1], key=lambda r: r.doc_id):
        out, n, gone = [], 0, 0
        for line in r.text.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                n += 1
                gone += line in seen
                if line in seen:
                    continue
                seen.add(line)
            out.append(line)
        if not n or gone < n:
            want[(r.doc_id, "\n".join(out), r.lang, r.source, len("\n".join(out)))] += 1
    assert kept(stages[2]) == want


def test_near_duplicates(stages):
    rows = stages[2]
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert kept(stages[3]) == kept(r for r, g in zip(rows, group) if least[g] == r.doc_id)


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    spans = {tuple(v[j : j + min(10, len(v))]) for _, t in items for v in [words(t)] if v for j in range(len(v) - min(10, len(v)) + 1)}
    sizes = set(map(len, spans))
    hit = lambda w: any(tuple(w[i : i + n]) in spans for n in sizes for i in range(len(w) - n + 1))
    assert kept(stages[4]) == kept(r for r in stages[3] if not hit(words(r.text)))


def test_encode(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in RAW.splitlines())}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: plain.encode_ordinary(r.text or "") for r in stages[4]}
    assert {r.doc_id: (r.n_tokens, r.token_ids, r.round_trip) for r in stages[5]} == {k: (len(v), v, True) for k, v in want.items()}


def test_empty_tables(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
