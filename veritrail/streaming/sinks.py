"""Sinks (K1-K12): JSON lines, dated folders, fan-out, and message formats, in batch and in streams."""

from __future__ import annotations

import functools
import logging
import re
from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritrail.functions.times import instant
from veritrail.operators import events
from veritrail.runtime import discard, materialize

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame], None]


class SinkClosed(RuntimeError):
    """A batch was given to a sink that takes no more."""


def dated(df: DataFrame, issued_at: str = "issued_at") -> DataFrame:
    """Add year, month, day and hour of issue (UTC), which do not depend on when a job runs."""
    hours = F.floor(F.unix_seconds(instant(F.col(issued_at))) / 3600)
    at = F.timestamp_add("HOUR", hours, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return df.withColumns({k: F.date_format(at, p) for k, p in (("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH"))})


def jsonl(path: str, column: str = "receipt") -> Sink:
    """Append receipts as lines to ``path``, one folder per day of issue."""

    def write(df: DataFrame) -> None:
        dated(df).select(F.concat_ws("-", "year", "month", "day").alias("dt"), F.col(column).alias("value")).write.mode("append").partitionBy("dt").text(path)

    return write


def daily_lines(path: str, prefix: str = "receipts", column: str = "receipt") -> Sink:
    """Append lines under ``path``/``prefix``-YYYY-MM-DD, by the day of issue (UTC); the prefix must be a plain name."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", prefix):
        raise ValueError(f"not a plain name: {prefix!r}")

    def write(df: DataFrame) -> None:
        # The writer names folders of a partition column key=value; the name of the file goes into the value.
        day = F.concat_ws("-", F.lit(prefix), "year", "month", "day")
        dated(df).select(day.alias("file"), F.col(column).alias("value")).write.mode("append").partitionBy("file").text(path)

    return write


def hourly(path: str, column: str = "receipt") -> Sink:
    def write(df: DataFrame) -> None:
        dated(df).select("year", "month", "day", "hour", F.col(column).alias("value")).write.mode("append").partitionBy("year", "month", "day", "hour").text(path)

    return write


def console(column: str = "receipt") -> Sink:
    """Print every row as a line, a partition at a time, so that the driver never holds all of them."""

    def write(df: DataFrame) -> None:
        for row in df.select(column).toLocalIterator():
            print(row[0], flush=True)

    return write


def fan_out(sinks: Sequence[Sink]) -> Sink:
    """Write a batch to each sink in order; one that fails is reported by the kind of its error and does not stop the others.

    A sink that is closed is a fault of the caller, not of the sink, and is raised.
    """

    def write(df: DataFrame) -> None:
        kept = df.persist()
        try:
            for i, sink in enumerate(sinks):
                try:
                    sink(kept)
                except SinkClosed:
                    raise
                except Exception as e:  # noqa: BLE001
                    log.warning("sink %d failed: %s", i, type(e).__name__)
        finally:
            kept.unpersist()

    return write


def through(change: Callable[[DataFrame], DataFrame], sink: Sink) -> Sink:
    """A sink that changes each batch before it hands it on."""
    return lambda df: sink(change(df))


def forward_events(sink: Sink) -> Sink:
    """Write rows as :func:`veritrail.operators.events.skeleton` takes them as lines of security events, with all their parts."""

    def change(df: DataFrame) -> DataFrame:
        made = events.blocks(events.skeleton(df))
        parts = [c for c in made.columns if c not in {*df.columns, *events.READ}]
        return made.select("receipt_id", "issued_at", F.to_json(F.struct("receipt_id", "severity_id", *parts)).alias("receipt"))

    return through(change, sink)


class Retrying:
    """A sink that keeps failed batches and offers them again, oldest first, before the next one.

    A batch waits as rows in the shared folder, so it can be written whatever becomes of its source; ``hold`` and ``drop``
    put rows there and take them away. At most ``keep`` batches wait; beyond that the oldest is lost, which is logged once
    each time the queue becomes full. Where nothing may be lost, let the stream's checkpoint retry instead (``start``).
    For one caller at a time.
    """

    def __init__(self, sink: Sink, keep: int = 1000, hold: Callable[[DataFrame], DataFrame] = functools.partial(materialize, label="waiting"), drop: Callable[[DataFrame], None] = discard):
        self.sink, self.keep, self.hold, self.drop = sink, keep, hold, drop
        self.waiting, self.closed, self._told = deque(), False, False

    def _wait(self, df: DataFrame) -> None:
        self.waiting.append(self.hold(df))
        if len(self.waiting) > self.keep:
            self.drop(self.waiting.popleft())
            if not self._told:
                log.warning("queue of %d batches is full, the oldest are lost", self.keep)
                self._told = True

    def _drain(self) -> bool:
        while self.waiting:
            try:
                self.sink(self.waiting[0])
            except SinkClosed:
                raise
            except Exception as e:  # noqa: BLE001
                log.warning("%d batches wait: %s", len(self.waiting), type(e).__name__)
                return False
            self.drop(self.waiting.popleft())
            self._told = False
        return True

    def __call__(self, df: DataFrame) -> None:
        if self.closed:
            raise SinkClosed("the sink is closed")
        if self._drain():
            try:
                return self.sink(df)
            except SinkClosed:
                raise
            except Exception as e:  # noqa: BLE001
                log.warning("a batch waits: %s", type(e).__name__)
        self._wait(df)

    def close(self) -> int:
        """Offer what waits once more; the number of batches that are lost."""
        self.closed = True
        self._drain()
        for df in self.waiting:
            self.drop(df)
        return len(self.waiting)


def start(stream: DataFrame, sink: Sink, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run a sink on each batch of a stream; the checkpoint and task retries take the place of a retry queue."""
    return stream.writeStream.foreachBatch(lambda df, _: sink(df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def kafka_rows(df: DataFrame, key: str = "receipt_id", column: str = "receipt") -> DataFrame:
    """Key and value of one message per receipt, for the Kafka writer (its jar is not part of this package; untested here)."""
    return df.select(F.col(key).cast("string").alias("key"), F.col(column).alias("value"))


def attributes(df: DataFrame) -> DataFrame:
    """Text attributes that queue services carry beside the message, nulls left out."""
    names = [c for c in ("receipt_id", "caller_hash", "trajectory_id", "step_kind") if c in df.columns]
    pairs = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))])
    return df.withColumn("attributes", F.map_filter(pairs, lambda _, v: v.isNotNull()))
