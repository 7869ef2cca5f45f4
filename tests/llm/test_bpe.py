import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrail.llm import bpe

from .conftest import ODD

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in RAW.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(reference, texts):
    ids, n, raw = bpe.coder(RAW, P.PATTERN).code(texts)
    for t, i, k, b in zip(texts, ids, n, raw):
        want = reference.encode_ordinary(t)
        assert (i, k, b.decode()) == (",".join(map(str, want)), len(want), t)


def test_edges(reference):
    same(reference, ["", " ", "  a  b", "a\n\n b \t", "it's we'll 'd", "1234 ½", "   ", "a  ", " x 　y", "é" * 700, "ab" * 3000, "<|endoftext|>", "日本語 text", "a " * 2000])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids, n, raw = bpe.coder(RAW, P.PATTERN).code([text])
    assert raw[0].decode() == text and n[0] == (len(ids[0].split(",")) if ids[0] else 0)


def test_frames(spark, odd, none, reference):
    rows = bpe.encode_decode(odd.withColumnRenamed("lang", "decoded"), PATH, P.PATTERN).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = reference.encode_ordinary(r.text or "")
        assert (r.token_ids, r.n_tokens, bytes(r.decoded)) == (",".join(map(str, want)), len(want), (r.text or "").encode())
    assert bpe.encode_decode(none, PATH, P.PATTERN).count() == 0
    ids = spark.createDataFrame([([220, 220],), ([],), (None,)], "ids array<int>")
    got = [bytes(r.decoded) for r in bpe.decode(ids, PATH).collect()]
    assert got == [reference.decode_bytes([220, 220]), b"", b""]


def test_decoding_lists_of_ids():
    """Empty lists, lists of nothing, and an id that is not in the vocabulary; no aggregate of texts is sorted."""
    c = bpe.coder(RAW, P.PATTERN)
    ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in RAW.splitlines())}
    lists = [[], [5, 300, 7], [], [1 << 30, 260], [0], []]
    flat = np.array([i for x in lists for i in x], "int32")
    assert c.decode_ids(flat, np.array([len(x) for x in lists])) == [b"".join(ranks.get(i, b"") for i in x) for x in lists]
    assert c.decode_ids(np.zeros(0, "int32"), np.array([0, 0])) == [b"", b""] and c.decode_ids(np.zeros(0, "int32"), np.zeros(0, "int64")) == []
    assert "agg" not in bpe.DECODE_SQL
