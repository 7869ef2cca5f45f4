"""Streaming detectors over receipts: tumbling, sliding and session windows with late data, and deduplication.

``events`` is a stream with receipt_id, caller, step_kind and issued (timestamp).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 hour"


def once(events: DataFrame, late: str = LATE, at: str = "issued") -> DataFrame:
    """Each receipt once, however often it was sent within the time for late data."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(["receipt_id"])


def rates(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Receipts per caller and window; give ``slide`` for overlapping windows."""
    w = F.window("issued", width, slide) if slide else F.window("issued", width)
    return once(events).groupBy(w, "caller").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "caller", "n")


def kinds(events: DataFrame, width: str = "1 day") -> DataFrame:
    return once(events).groupBy(F.window("issued", width), "step_kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "step_kind", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each caller by gap, with their number of steps and kinds."""
    s = once(events).groupBy(F.session_window("issued", gap), "caller").agg(F.count("*").alias("steps"), F.approx_count_distinct("step_kind").alias("kinds"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "caller", "steps", "kinds")


def write_then_call(events: DataFrame, within_s: int = 600) -> DataFrame:
    """A tool call within some seconds after a memory write of the same caller: join of two streams with bounded state."""
    seen = once(events)
    writes = seen.filter("step_kind = 'memory_write'").select(F.col("caller").alias("w_caller"), F.col("issued").alias("w_issued"), F.col("receipt_id").alias("write_id"))
    calls = seen.filter("step_kind = 'tool_call'").select("caller", "issued", F.col("receipt_id").alias("call_id"))
    near = F.expr(f"caller = w_caller AND issued > w_issued AND issued <= w_issued + INTERVAL {within_s} SECONDS")
    return calls.join(writes, near).select("caller", "write_id", "call_id", "w_issued", "issued")
