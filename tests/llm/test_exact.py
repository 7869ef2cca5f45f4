"""Operators with exact results against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from veritrail.llm import ctw, lines, quality, repeats, similar, winnow

from .conftest import ODD


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_hits(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        if item is None or not n:
            continue
        for j in range(len(v) - n + 1):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit |= set(range(i, i + n))
                    ids.add(item)
    return len(w), len(hit), sorted(map(str, ids))


@pytest.mark.parametrize("broadcast", [True, False])
def test_winnowing(spark, corpus, odd, none, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _winnowing(corpus, odd, none)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _winnowing(corpus, odd, none):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(40)] + ["É", "ÉA", "Of"]
    items = [(1, " ".join(rng.choices(pool, k=25))), (2, "two words"), (3, "a " * 12), (4, None), (5, ""), (None, "x y"), (20, " ".join(rng.choices(pool, k=10)))]
    texts = []
    for i in range(40):
        t = rng.choices(pool, k=rng.randint(0, 60))
        src = (items[rng.choice([0, 1, 6])][1]).split()
        k = rng.randint(0, len(src))
        texts.append((100 + i, " ".join(t[:9] + src[k : k + rng.randint(1, 25)] + t[9:]).upper(), "en", "s", 0))
    docs = corpus(texts + [(1, "a " * 30, "", "", 0), (2, "Two, WORDS; two words", "", "", 0)] + ODD[:6])
    bench = corpus(items, "benchmark", "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in winnow.decontaminate(docs.withColumnRenamed("source", "win").withColumnRenamed("lang", "len"), bench).collect())
    want = Counter()
    for r in docs.collect():
        n, h, ids = brute_hits(r.text, items)
        want[(r.doc_id, n, h, tuple(ids), h > 0)] += 1
    assert got == want
    kept = winnow.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k: v for k, v in Counter(x[0] for x in want.elements() if not x[4]).items()})
    assert winnow.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in winnow.decontaminate(odd, bench.limit(0)).collect())


def brute_quality(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    ls = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(cover)


def test_quality(corpus, none):
    rng = random.Random(5)
    rows = list(ODD)
    for i in range(300):
        bad = i % 4 == 0
        ws = [f"w{rng.randint(0, 5000)}" + ("###" if bad and rng.random() < 0.7 else "") for _ in range(rng.randint(60, 90))]
        rows.append((100 + i, "\n".join(" ".join(ws[k : k + 9]) for k in range(0, len(ws), 9)), "en", "s", 0))
    docs = corpus(rows)
    labels = corpus([(100 + i, 0 if i % 4 == 0 else 1, 0) for i in range(300)] + [(100, 0, 0), (None, 0, 0), (1, None, 1)], "labels", "doc_id long, quality int, toxic int")
    out = quality.filter_quality(docs.withColumnRenamed("n_chars", "n_words"), labels).join(docs.select(F.col("doc_id").alias("d"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left").collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if (r.doc_id or 0) >= 100:
            assert r.kept == ((r.doc_id - 100) % 4 != 0)
    assert quality.learn(quality.features(docs), labels.limit(0)) == []
    assert quality.filter_quality(none, labels).count() == 0


@pytest.mark.parametrize("tile,group", [(1 << 20, 20_000), (512, 1)])
def test_repeated_windows(corpus, none, monkeypatch, tile, group):
    monkeypatch.setattr(repeats, "TILE", tile)
    monkeypatch.setattr(repeats, "GROUP_ROWS", group)
    repeats._rollers.clear()
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choices("abcdé \n", k=n))
    shared = [noise(rng.randint(300, 900)) for _ in range(6)]
    rows = [(i, noise(rng.randint(0, 600)) + rng.choice(shared) + noise(rng.randint(0, 300)) + rng.choice(shared)[:450] + noise(40), "", "", 0) for i in range(40)]
    rows += [(100, "ab" * 700, "", "", 0), (101, noise(399), "", "", 0), (102, rows[0][1], "", "", 0), (None, rows[1][1], "", "", 0), (103, None, "", "", 0), (104, "", "", "", 0)]
    df = corpus(rows)
    count = Counter(b[p : p + 400] for _, t, *_ in rows for b in [(t or "").encode()] for p in range(len(b) - 399))
    want = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        cover = {q for p in range(len(b) - 399) if count[b[p : p + 400]] > 1 for q in range(p, p + 400)}
        want[(i, len(b), len(cover), sum(q - 1 not in cover for q in cover), bytes(x for q, x in enumerate(b) if q not in cover))] += 1
    passage = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([50, 51, 60]))) for _ in range(6)]
    talk = [(i, " ".join([noise(60), rng.choice(passage), noise(50), rng.choice(passage)]), "", "", 0) for i in range(12)] + [(20, "so " * 70, "", "", 0), (21, "so " * 50, "", "", 0), (22, None, "", "", 0)]
    split = [[x for x in re.split("[\x20\x09-\x0d]+", t or "") if x] for _, t, *_ in talk]
    seen = Counter(tuple(w[k : k + 51]) for w in split for k in range(len(w) - 50))
    told = {i: len({q for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for q in range(k, k + 51)}) for (i, *_), w in zip(talk, split)}
    assert {r.doc_id: r.n_passage_words for r in repeats.remove_repeats(corpus(talk)).collect()} == told and len(set(told.values())) > 3
    got = repeats.remove_repeats(df.withColumnRenamed("lang", "kept"))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == want
    assert repeats.remove_repeats(none).count() == 0
    repeats._rollers.clear()


def test_lines_against_sql(corpus, odd, none):
    rng = random.Random(11)
    pool = [" ".join(rng.choices(["of", "the", "end", "it"], k=rng.randint(1, 7))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", " ", f"own line number {i} {k} of this text"]) for k in range(rng.randint(0, 14))), "", "", 0) for i in range(60)]
    df = corpus(rows)
    out = lines.dedup_lines(df.withColumnRenamed("source", "gone"))
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.longest_run, r.k) for r in out.withColumn("k", F.sha2(F.col("text").cast("binary"), 256)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert got == sorted(con.execute(lines.ORACLE).fetchall())
    by = defaultdict(list)
    for r in lines.dedup_lines(odd).collect():
        by[r.doc_id].append(r)
    assert by[1][0].text is None and by[2][0].text == "" and by[3][0].text == " \n\t "
    assert by[5][0].text == "same words here\nsame words here\nsame words here".rsplit("\n", 1)[0] or by[5][0].n_removed >= 1
    assert all(r.n_removed == 3 for r in by[6])
    # The suffix at each place, compared with all others.
    split = [[x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)] for _, t, *_ in rows]
    tails = [(d, k, ls[k:]) for d, ls in enumerate(split) for k in range(len(ls))]
    same = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    reach = {(d, k): max(same(t, u) for e, j, u in tails if (e, j) != (d, k)) for d, k, t in tails}
    want = {rows[d][0]: (sum(n > 0 and reach.get((d, k - 1), 0) <= n for (e, k), n in reach.items() if e == d), max([n for (e, _), n in reach.items() if e == d], default=0)) for d in range(len(rows))}
    assert {r[0]: (r[3], r[4]) for r in got} == want
    assert lines.dedup_lines(none).count() == 0


@pytest.mark.parametrize("texts", [1_000, 2])
def test_similar(corpus, odd, none, monkeypatch, texts):
    monkeypatch.setattr(similar, "BLOCK_TEXTS", texts)
    rng = random.Random(13)
    rows = []
    for g in range(8):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(t).title(), "", "", 0))
    df = corpus(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t, *_ in rows for w in [words(t)]}
    links, parent = Counter(), {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r._id: (r.class_id, r.n_links, r.n_grams) for r in similar.similar_classes(df).collect()}
    assert got == {i: (find(i), links[i], len(s)) for i, s in sets.items()}
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == sorted({find(i) for i in sets})
    rest = similar.keep_one(odd)
    assert rest.columns == odd.columns
    assert sorted(str(r.doc_id) for r in rest.collect()) == ["1", "2", "3", "4", "5", "7", "8", "None"]
    assert similar.similar_classes(none).count() == 0


def test_plan_reaches_its_recall():
    b, r = similar.plan()
    assert 1 - (1 - 0.8**r) ** b >= 0.99999


def test_context_tree(corpus, none):
    import math
    import zlib

    rng = random.Random(17)
    rows = [*ODD[:6], *[(100 + i, "".join(rng.choices("ab é\n", k=rng.randint(0, 120))), "", "", 0) for i in range(40)]]
    df = corpus(rows)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ctw.score(df.withColumnRenamed("lang", "chunk")).collect())
    D = ctw.DEPTH
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = lambda t: [*(x.lower() for x in (t or "").encode().split()), None]
    counts, nodes = Counter(), defaultdict(lambda: [0, 0])
    code = lambda t: b"\xfe" * D + (t or "").encode() + b"\xff"

    def steps(b):
        for k in range(D, len(b)):
            z = 1
            for j in range(7, -1, -1):
                bit = b[k] >> j & 1
                yield b[k - D : k], z, bit
                z = 2 * z + bit

    for i, t, *_ in rows:
        if not held(i):
            counts.update(toks(t))
            for c, z, bit in steps(code(t)):
                for d in range(D + 1):
                    nodes[(c[D - d :], z)][bit] += 1
    pe = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in nodes.items()}
    pw, below = {}, defaultdict(float)
    for d in range(D, -1, -1):
        for k in [k for k in nodes if len(k[0]) == d]:
            top = max(pe[k], below[k])
            pw[k] = pe[k] if d == D else top + math.log(math.exp(pe[k] - top) + math.exp(below[k] - top)) - math.log(2)
            if d:
                below[(k[0][1:], k[1])] += pw[k]
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in rows:
        s = 0.0
        for c, z, bit in steps(code(t)):
            q = 0.5
            for d in range(D, -1, -1):
                k = (c[D - d :], z)
                if k not in nodes:
                    q = 0.5
                    continue
                e = (nodes[k][bit] + 0.5) / (sum(nodes[k]) + 1)
                w = math.exp(pe[k] - pw[k] - math.log(2))
                q = e if d == D else w * e + (1 - w) * q
            s += math.log10(q)
        ts = toks(t)
        want[(i, held(i), len(ts), sum(counts[x] > 0 for x in ts), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts), 6), round(s, 6))] += 1
    assert got == want
    assert ctw.score(none).count() == 0


def test_context_tree_sees_two_words_of_two_byte_letters(corpus):
    rng = random.Random(18)
    rows = []
    for i in range(300):
        w = [rng.randrange(30), rng.randrange(30)]
        for _ in range(150):
            w.append((w[-1] + w[-2]) % 30 if rng.random() < 0.8 else rng.randrange(30))
        rows.append((i, " ".join(chr(0x430 + x) for x in w), "", "", 0))
    held = [r for r in ctw.score(corpus(rows)).collect() if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held)
