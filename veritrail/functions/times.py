"""Instants without a session time zone (P22-P24): text to epoch and back, always in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def iso(millis: Column) -> Column:
    """Epoch milliseconds as ISO-8601 text with three digits and Z."""
    return F.date_format(F.timestamp_add("MILLISECOND", millis, F.expr(_EPOCH)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def instant(text: Column) -> Column:
    """Timestamp of ISO-8601 text; text without a zone is UTC, unparseable text is null."""
    zoned = text.rlike(r"(?:[Zz]|[+-]\d\d:?\d\d)\s*\z")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.when(text.contains(":"), "Z").otherwise("T00:00:00Z"))))


def micros_of_local(ts: Column) -> Column:
    """Epoch microseconds of a timestamp without zone, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts.cast("timestamp_ntz"))


def day(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))
