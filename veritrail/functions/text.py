"""Text operators: normalization (P1-P5), windows (W2), fingerprints (P6-P8) and rolling hashes.

All are Column expressions. Only canonical composition and case folding have no
built-in; they run as Arrow functions on the few texts that can change.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType

WINDOW, STRIDE = 128, 64
#: Code points of the blocks that a text is cut into on the way to its windows.
BLOCKS = (16384, 512)
#: The characters removed as zero-width, the base and the modulus of the rolling hash.
ZERO_WIDTH = "​‌‍⁠﻿"
ROLLING_BASE, ROLLING_MODULUS = 1000003, (1 << 61) - 1
#: A run of white space, unless it is one plain space already.
SPACES = r"[[\s\x1c-\x1f\x85\p{Z}]&&[^ ]][\s\x1c-\x1f\x85\p{Z}]*| [\s\x1c-\x1f\x85\p{Z}]+"
#: Texts of characters below U+0300 only are in composed form already.
_MAY_COMPOSE = "[^\\x00-\\u02ff]"


@pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def nfc(text: Column) -> Column:
    return F.coalesce(_nfc(F.when(text.rlike(_MAY_COMPOSE), text)), text)


def casefold(text: Column) -> Column:
    """Full case folding; for ASCII texts lower case is the same."""
    wide = text.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_casefold(F.when(wide, text)), F.lower(text))


def strip_zero_width(text: Column) -> Column:
    return F.when(text.rlike(_MAY_COMPOSE), F.regexp_replace(text, f"[{ZERO_WIDTH}]", "")).otherwise(text)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


STEPS = (("nfc", nfc, True), ("zero_width", strip_zero_width, True), ("case_fold", casefold, False), ("whitespace", collapse_spaces, True))


def normalize(text: Column, **enabled: bool) -> Column:
    """Apply the enabled steps in their fixed order; null stays null."""
    for name, step, default in STEPS:
        if enabled.get(name, default):
            text = step(text)
    return text


def applied_steps(**enabled: bool) -> Column:
    """Names of enabled steps, whether or not they changed a text."""
    names = [n for n, _, default in STEPS if enabled.get(n, default)]
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


def digest(text: Column) -> Column:
    """The 32 bytes of a fingerprint, for tables of many."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def packed(fingerprint: Column) -> Column:
    """The bytes of a fingerprint that is given as text."""
    return F.unhex(F.substring_index(fingerprint, ":", -1))


def unpacked(digest: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.lower(F.hex(digest)))


def chunk_fingerprint(text: Column, **enabled: bool) -> Column:
    return fingerprint(normalize(text, **enabled))


def parts(df, normal: str, width: int = WINDOW, stride: int = STRIDE, keep: tuple[str, ...] = (), empty: bool = False):
    """One row per window of column ``normal``: the kept columns, offset and part; with ``empty``, one for an empty or null text too.

    A substring counts code points from the start of its text, so long texts are cut into blocks first, each with the
    rest of its last window, and windows are cut from blocks.
    """
    # A window leaves the generator as a row of its own, so no row beyond it carries the whole text.
    def explode(rows, offsets, size):
        cut = F.transform(offsets, lambda o: F.struct((F.col("_at") + o).alias("at"), F.substring("_text", o + 1, F.lit(size)).alias("part")))
        return rows.select(*keep, F.explode(cut).alias("_w")).select(*keep, F.col("_w.at").alias("_at"), F.col("_w.part").alias("_text"))

    rows, outer = df.select(*keep, F.lit(0).alias("_at"), F.col(normal).alias("_text")), None
    for size in BLOCKS:
        step = max(size // stride, 1) * stride
        if outer is not None and step >= outer:
            continue
        last = "length(_text) - 1" if outer is None else f"least(length(_text) - 1, {outer - 1})"
        rows, outer = explode(rows, F.expr(f"sequence(0, greatest(coalesce({last}, 0), 0), {step})"), step - stride + width), step
    whole = "array(0)" if empty else "IF(length(_text) > 0, array(0), array())"
    inner = F.expr(f"CASE WHEN coalesce(length(_text), 0) < {width} THEN IF(_at = 0, {whole}, array()) ELSE sequence(0, least(length(_text) - {width}, {outer - stride}), {stride}) END").cast("array<int>")
    return explode(rows, inner, width).withColumnsRenamed({"_at": "offset", "_text": "part"})


def windows(df, normal: str, width: int = WINDOW, stride: int = STRIDE, keep: tuple[str, ...] = ()):
    """One row per window of column ``normal``: the kept columns, offset, length, fingerprint, rolling_hash."""
    part = F.col("part")
    return parts(df, normal, width, stride, keep).select(*keep, "offset", F.length(part).alias("length"), fingerprint(part).alias("fingerprint"), _rolling_hash(part).alias("rolling_hash"))


@pandas_udf(LongType())
def _rolling_hash(s: pd.Series) -> pd.Series:
    """As ``rolling_hash``, for many short texts at once: one step per place takes it in all of them."""
    low41, low20, m = np.uint64((1 << 41) - 1), np.uint64((1 << 20) - 1), np.uint64(ROLLING_MODULUS)
    base, b41, b20 = np.uint64(ROLLING_BASE), np.uint64(41), np.uint64(20)
    points = np.frombuffer("".join(s).encode("utf-32-le"), "<u4").astype("uint64")
    size = s.str.len().to_numpy("int64")
    order = np.argsort(-size, kind="stable")  # texts that have a place j are the first ones
    first, size = (np.cumsum(size) - size)[order], size[order]
    h = np.zeros(len(s), "uint64")
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j))
        a = h[:n]
        x = (a >> b41) * base  # times 2**41, of which 2**61 is 1
        h[:n] = ((a & low41) * base + (x >> b20) + ((x & low20) << b41) + points[first[:n] + j]) % m
    out = np.empty(len(s), "int64")
    out[order] = h.astype("int64")
    return pd.Series(out)


def rolling_hash(text: Column) -> Column:
    """Polynomial hash over code points, modulo 2**61 - 1; null for null."""
    zero = F.lit(0).cast("decimal(38,0)")
    step = lambda a, c: ((a * F.lit(ROLLING_BASE).cast("decimal(7,0)") + F.ascii(c)) % F.lit(ROLLING_MODULUS).cast("decimal(19,0)")).cast("decimal(38,0)")
    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.aggregate(chars, zero, step).cast("long")
