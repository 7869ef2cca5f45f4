import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veritrail.functions import canon, text
from veritrail.functions.times import instant, iso

TEXTS = ["", "   ", "hello  world", " café \t latte​ ", "Straße", "a b c\x1cd", "﻿x⁠y", "emoji \U0001f600 ok", "Åẛ̣", None]


def model(t, fold=False):
    if t is None:
        return None
    t = unicodedata.normalize("NFC", t)
    t = re.sub("[​‌‍⁠﻿]", "", t)
    t = t.casefold() if fold else t
    return re.sub(r"\s+", " ", t).strip()


def test_normalize_like_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", text.normalize(F.col("t")).alias("a"), text.normalize(F.col("t"), case_fold=True).alias("b")).collect()
    for r in rows:
        assert (r.a, r.b) == (model(TEXTS[r.i]), model(TEXTS[r.i], True))


def test_steps_are_those_enabled(spark):
    got = spark.range(1).select(text.applied_steps(case_fold=True, nfc=False).alias("s")).first().s
    assert got == ["zero_width", "case_fold", "whitespace"]


def test_windows(spark):
    df = spark.createDataFrame([("abcdefghij",), ("hi",), ("",), ("café latte",)], "t string")
    rows = df.withColumn("k", F.col("t")).transform(lambda d: text.windows(d, "t", 4, 2, keep=("k",))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.k, []).append((r.offset, r.length, r.fingerprint))
    assert [x[0] for x in sorted(by["abcdefghij"])] == [0, 2, 4, 6]
    assert [x[:2] for x in by["hi"]] == [(0, 2)]
    assert "" not in by
    for k, xs in by.items():
        for o, n, f in xs:
            assert f == "sha256:" + hashlib.sha256(k[o : o + n].encode()).hexdigest()


def test_rolling_hash(spark):
    words = ["the quick brown fox", "\U0001f600x", ""]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for r in df.select("t", text.rolling_hash(F.col("t")).alias("h")).collect():
        h = 0
        for c in r.t:
            h = (h * 1000003 + ord(c)) % ((1 << 61) - 1)
        assert r.h == h


def test_windows_carry_the_rolling_hash_of_the_whole_text(spark):
    texts = ["abcdefghij" * 40, "hi", "", "\U0001f600é漢" * 70, "\U0010ffff" * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {(r.k, r.offset): r.rolling_hash for r in text.windows(df.withColumn("k", F.col("t")), "t", keep=("k",)).collect()}
    want = {}
    for t in texts:
        for o in range(0, max(1, len(t) - text.WINDOW + 1) if t else 0, text.STRIDE):
            h = 0
            for c in t[o : o + text.WINDOW]:
                h = (h * 1000003 + ord(c)) % ((1 << 61) - 1)
            want[t, o] = h
    assert got == want


def test_hmac_and_canonical_json(spark):
    import hmac

    df = spark.createDataFrame([("a\nb",), ("ü",)], "t string")
    for key in (b"k", b"x" * 100):
        for r in df.select("t", canon.hmac_native(F.col("t"), key).alias("h")).collect():
            assert r.h == hmac.new(key, r.t.encode(), hashlib.sha256).hexdigest()
    one = spark.createDataFrame([('{"b":1e-05,"a":"\\u001f\\u00fc"}',)], "j string").select(canon.canonical(F.col("j")).alias("c")).first().c
    assert one == canon.canonical_json({"a": "\x1fü", "b": 1e-05})
    m = spark.range(1).select(canon.string_map_json(F.create_map(F.lit("z"), F.lit('q"\\'), F.lit("a"), F.lit("1"))).alias("m")).first().m
    assert m == canon.canonical_json({"z": 'q"\\', "a": "1"})


def test_instants_do_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame([("2024-01-01T00:00:00.250Z",), ("2024-01-01T02:00:00+02:00",), ("2024-01-01T00:00:00",), ("2024-01-01",), ("nope",), (None,)], "t string")
            assert [r[0] for r in df.select(F.unix_seconds(instant(F.col("t")))).collect()] == [1704067200] * 4 + [None, None]
            assert spark.range(1).select(iso(F.lit(1704067200250))).first()[0] == "2024-01-01T00:00:00.250Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("width, stride", [(128, 64), (128, 96), (700, 600), (3, 5)])
def test_windows_of_long_texts_cross_blocks(spark, width, stride):
    texts = ["", "aé", "日本" * 64, "x" * 512 + "é", "".join(map(chr, range(0x4E00, 0x4E00 + 17000))) + "ende" * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    places = lambda t: range(0, max(len(t) - width, 0) + 1, stride)
    for empty in (True, False):
        got = sorted((r.i, r.offset, r.part or "") for r in text.parts(df, "t", width, stride, ("i",), empty).collect())
        assert got == sorted((i, o, (t or "")[o : o + width]) for i, t in enumerate([*texts, None]) if t or empty for o in places(t or ""))
