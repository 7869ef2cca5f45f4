"""Canonical JSON and keyed hashes.

Hashing a document that somebody else will hash again needs one byte-exact
form, so canonical JSON is written by Python's json in Arrow functions. Keyed
hashes of index rows are native. A key that must stay secret never becomes a
plan literal: ``hmac_from_env`` reads it on the executor.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)
#: How JSON writes the characters that a string cannot hold as they are; the backslash comes first.
ESCAPES = {"\\": "\\\\", '"': '\\"'} | {chr(i): f"\\u{i:04x}" for i in range(32)} | {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def canonical_json(value) -> str:
    """Sorted keys, no white space, no escapes beyond JSON's own."""
    return _ENCODER.encode(value)


def sha256_text(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


@pandas_udf(StringType())
def canonical(s: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null for null, an error for text that is no JSON."""
    known: dict[str, str] = {}  # callers and other small objects come again and again

    def one(text):
        if (out := known.get(text)) is None:
            out = known[text] = canonical_json(json.loads(text))
        return out

    return s.map(one, na_action="ignore")


def quoted(text: Column) -> Column:
    """Canonical JSON of a text, natively; null for null."""
    out = text
    for plain, escaped in ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), out).otherwise(text), F.lit('"'))


def object_of(fields: dict[str, Column]) -> Column:
    """Canonical JSON of an object from the canonical JSON of its fields; a null one is left out."""
    named = [F.concat(F.lit(f"{canonical_json(k)}:"), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.array_join(F.array(*named), ","), F.lit("}"))


def json_hash(json_text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(canonical(json_text), "UTF-8"), 256))


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def string_map_json(pairs: Column) -> Column:
    """Canonical JSON of a map of plain strings, natively, where no value needs other escapes than quote and backslash."""
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
    entries = F.array_sort(F.map_entries(pairs))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(quoted(e["value"]), F.lit("null")))), ","), F.lit("}"))


def _pads(key: bytes) -> tuple[str, str]:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_native(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 as hex from built-ins. The key shows in plans: for test keys only."""
    inner, outer = (F.unhex(F.lit(p)) for p in _pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def hmac_from_env(message: Column, variable: str) -> Column:
    """HMAC-SHA256 as hex with a key that executors read from their environment."""

    @pandas_udf(StringType())
    def sign(s: pd.Series) -> pd.Series:
        key = Secret(variable).read()
        return s.map(lambda x: hmac.new(key, x.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    return sign(message)


def row_payload(*columns: str) -> Column:
    """Fields of a signed row, one a line; a null makes the payload null instead of shorter."""
    return F.concat(*[x for i, c in enumerate(columns) for x in ([F.lit("\n")] if i else []) + [F.col(c).cast("string")]])


def has_control(column: str) -> Column:
    """Whether a field could break the payload's lines (LF, CR or NUL)."""
    return F.col(column).rlike(r"[\n\r\x00]")


@dataclass(frozen=True)
class Secret:
    """A key in the environment of executors and driver; nothing falls back to a default."""

    variable: str

    def read(self) -> bytes:
        value = os.environ.get(self.variable)
        if not value:
            raise RuntimeError(f"{self.variable} must hold the key")
        return value.encode()


def key_bytes(key: bytes | Secret) -> bytes:
    return key.read() if isinstance(key, Secret) else key


def mac(message: Column, key: bytes | Secret) -> Column:
    """HMAC-SHA256 as hex: native for a key given as bytes (tests), read where it is used for a secret."""
    return hmac_from_env(message, key.variable) if isinstance(key, Secret) else hmac_native(message, key)


def caller_hash(caller_json: Column, salt: bytes | Secret | None = None) -> Column:
    """Hash of a caller's canonical JSON; with a salt it is keyed, and its prefix says so. Null for null."""
    body = canonical(caller_json)
    if salt is None:
        return F.concat(F.lit("sha256:"), F.sha2(F.encode(body, "UTF-8"), 256))
    return F.concat(F.lit("hmac-sha256:"), mac(body, salt))


def value_hash(value: Column, kind: str = "text") -> Column:
    """Hash of a ``text`` or ``binary`` value as it is, of ``json`` text in canonical form. Null for null."""
    if kind == "json":
        return json_hash(value)
    if kind not in ("text", "binary"):
        raise ValueError(f"no such kind of value: {kind}")
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(value, "UTF-8") if kind == "text" else value, 256))


def merged(first: Column, second: Column) -> Column:
    """One JSON object from the texts of two that share no key, as ``to_json`` writes them."""
    # bound as one element, so that neither side is written again for each place that names it
    a, b = (lambda x: x["a"]), (lambda x: x["b"])
    both = lambda x: F.concat(a(x).substr(F.lit(1), F.length(a(x)) - 1), F.lit(","), F.substring(b(x), 2, 2147483647))
    one = F.transform(F.array(F.struct(first.alias("a"), second.alias("b"))), lambda x: F.when(b(x) == "{}", a(x)).when(a(x) == "{}", b(x)).otherwise(both(x)))
    return F.get(one, F.lit(0))
