import hashlib
from collections import defaultdict

import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritrail.llm import align, queries

from .conftest import ODD

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(A_PATH)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
BYTES = {i: t for t, i in align.byte_level_tokens(open(A_PATH, "rb").read()).items()}


def piece_bytes(i):
    p = SP.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode()


def plain_groups(text):
    """Whole texts through the libraries, cut where ends of both sides meet."""
    if not text:
        return []
    a, b = TOK.encode(" " + text, add_special_tokens=False).ids, SP.encode(text)
    want = (" " + text).encode()
    if b"".join(map(BYTES.__getitem__, a)) != want or b"".join(map(piece_bytes, b)) != want:
        return []
    ends = []
    for ids, spelt in ((a, BYTES.__getitem__), (b, piece_bytes)):
        at, found = 0, []
        for i in ids:
            at += len(spelt(i))
            found.append(at)
        ends.append(found)
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        out.append((a[i:x], b[j:y]))
        i, j = x, y
    return out


def plain(texts):
    groups = [plain_groups(t) for t in texts]
    links = [[(x, y) for g in gs for x in g[0] for y in g[1]] for gs in groups]
    docs = defaultdict(int)
    for ls in links:
        for pair in set(ls):
            docs[pair] += 1
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for gs, ls in zip(groups, links):
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        sha = hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""
        out.append((sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(ls), sum(docs[p] == most[p[0]] for p in ls), sum(map(docs.__getitem__, ls)), sha))
    return out


TEXTS = ["a b", " a", "a ", "  a  b ", "a\n b", "a \nb", "a\n", "\na", "it's <|endoftext|> <s> </s> <0x41> x", "x▁y", "　日本語 テキスト x  y", "\x00 \x1c a\x1c b\x85 c", "🙂🙂 é é", "1234567 +1 (499) 555-6503", "ab" * 3000, "\t\t\tx  \t y", "Z" * 700, " ", "\n", "ﬁ ½ K"]


def test_edges_equal_the_libraries():
    aligner = align.Aligner(open(A_PATH, "rb").read(), open(B_PATH, "rb").read(), P.PATTERN)
    found = aligner.align(TEXTS)
    for t, spelt in zip(TEXTS, found["groups"].to_pylist()):
        assert spelt == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_groups(t)), repr(t)


ALIGNER = align.Aligner(open(A_PATH, "rb").read(), open(B_PATH, "rb").read(), P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tabt' .1é"), st.characters(blacklist_categories=("Cs",))), max_size=30), max_size=4))
def test_any_text_equals_the_libraries(texts):
    found = ALIGNER.align(texts)
    for t, spelt in zip(texts, found["groups"].to_pylist()):
        assert spelt == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain_groups(t)), repr(t)


def test_transducer_closes_groups_on_an_empty_residual(monkeypatch):
    t = align.Transducer({1: b"ab", 2: b"c", 3: b"abc"}, {7: b"a", 8: b"bc", 9: b"abc"})
    cases = [([1, 2, 3], [7, 8, 9]), ([1], [7]), ([1], [8]), ([], []), ([3], [9]), ([1, 2], [])]
    (a, start_a), (b, start_b) = (align.flat(list(x)) for x in zip(*cases))
    for long in (100, 0):  # side by side, and each alone
        monkeypatch.setattr(align, "LONG", long)
        group_a, group_b, closed = t.run((a, b), (start_a, start_b))
        assert closed.tolist() == [2, -1, -1, 0, 1, -1]
        assert group_a[:3].tolist() == [0, 0, 1] and group_b[:3].tolist() == [0, 0, 1]
    steps = len(t.step)
    t.run((a, b), (start_a, start_b))
    assert len(t.step) == steps


def test_wide_groups_count_ids_first(monkeypatch):
    texts = ["ababababab" * 30 + " xyxyxyxy", "aXbXaXbX" * 20, "日本" * 50]
    want = ALIGNER.align(texts)
    monkeypatch.setattr(align, "WIDE", 0)
    got = align.Aligner(open(A_PATH, "rb").read(), open(B_PATH, "rb").read(), P.PATTERN).align(texts)
    assert got["n_links"] == want["n_links"] and got["groups"] == want["groups"]
    assert sorted(got["_times"].flatten().to_pylist()) == sorted(want["_times"].flatten().to_pylist())


def test_frames(odd, none, spark):
    df = odd.withColumnRenamed("lang", "groups").withColumnRenamed("source", "n_best")
    rows = align.align(df, A_PATH, B_PATH, P.PATTERN).collect()
    want = sorted(zip([(t or "") for _, t, *_ in ODD], plain([t for _, t, *_ in ODD])))
    got = sorted(((r.text or ""), (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")) for r in rows)
    assert got == want
    assert align.align(none, A_PATH, B_PATH, P.PATTERN).count() == 0
    assert align.align_tokens(none, A_PATH, B_PATH, P.PATTERN).columns[-1] == "groups"


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    want = sorted((r.doc_id, *w) for r, w in zip(rows, plain([r.text for r in rows])))
    got = queries.QUERIES["op11_token_alignment"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
    many = align.align(docs, A_PATH, B_PATH, P.PATTERN, slice_bytes=1 << 14).collect()  # partial sums meet in the shuffle
    assert sorted((r.doc_id, r.n_best, r.count_sum) for r in many) == [(w[0], *w[5:7]) for w in want]
