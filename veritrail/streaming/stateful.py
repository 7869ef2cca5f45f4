"""Detectors over a stream with state of their own per caller: adjacent steps, and rates of the trailing hour.

Receipts may come late and out of order within the watermark. A receipt waits in the
state of its caller until the watermark, which goes by whole seconds, has reached its second;
a timer then takes all up to the watermark in order of time and identifier, so every receipt is
seen after all before it and none is taken again. None that is older than the watermark may
wait, as Spark refuses such rows when they leave. State of a caller: receipts within the time for
late data, the last step, and one count for each second of the trailing hour. These are
lists, read and written whole, and a caller has one timer, for its first receipt that waits:
a batch costs a few calls to the state for each caller, not for each receipt.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veritrail.runtime import ship
from veritrail.streaming.detectors import LATE, once

STEPS = "caller string, receipt_id string, issued timestamp, step_kind string, last_hour long, prev_id string, prev_kind string, gap_s long"
HOUR = 3600
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StepsInOrder(StatefulProcessor):
    """Each receipt of a caller with the step before it and the number of receipts in the hour up to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "issued long, receipt_id string, step_kind string")
        self.due = handle.getValueState("due", "ms long")
        self.last = handle.getValueState("last", "issued long, receipt_id string, step_kind string")
        self.hour = handle.getListState("hour", "second long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(issued), receipt, kind) for frame in rows for issued, receipt, kind in zip(frame["us"], frame["receipt_id"], frame["step_kind"])]
        if came:
            self.waiting.appendList(came)
            self._wake(min(r[0] for r in came))
        return iter(())

    def _wake(self, issued: int) -> None:
        """A timer for the second of a receipt, where none comes before."""
        ms, due = issued // 1_000_000 * 1000, self.due.get()
        if due is None or ms < due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = (max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // 1000 + 1) * 1_000_000
        ready, left = [], []
        for row in self.waiting.get():
            (ready if row[0] < end else left).append(tuple(row))
        self.due.clear()
        if left:
            self.waiting.put(left)
            self._wake(min(r[0] for r in left))
        else:
            self.waiting.clear()
        if not ready:
            return iter(())
        ready.sort(key=lambda r: r[:2])
        before = self.last.get()
        counts = dict(tuple(r) for r in self.hour.get())
        for issued, _, _ in ready:
            counts[issued // 1_000_000] = counts.get(issued // 1_000_000, 0) + 1
        at = np.array(sorted(counts))
        upto = np.concatenate([[0], np.cumsum([counts[s] for s in at.tolist()])])
        seconds = np.array([issued // 1_000_000 for issued, _, _ in ready])
        rates = upto[np.searchsorted(at, seconds, "right")] - upto[np.searchsorted(at, seconds - HOUR)]
        out = []
        for (issued, receipt, kind), n in zip(ready, rates.tolist()):
            s = issued // 1_000_000
            gap = None if before is None else s - before[0] // 1_000_000
            out.append((key[0], receipt, pd.Timestamp(issued, unit="us"), kind, n, before and before[1], before and before[2], gap))
            before = (issued, receipt, kind)
        self.last.update(before)
        now = ready[-1][0] // 1_000_000
        self.hour.put([(s, n) for s, n in counts.items() if s >= now - HOUR])
        frame = pd.DataFrame(out, columns=["caller", "receipt_id", "issued", "step_kind", "last_hour", "prev_id", "prev_kind", "gap_s"])
        return iter((frame.astype({"gap_s": "Int64"}),))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocks(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """State that is larger than memory and can hold timers, in ``parts`` parts, for queries that start inside; the session's settings come back after."""
    new = {PROVIDER: ROCKS} | ({"spark.sql.shuffle.partitions": str(parts)} if parts else {})
    before = {name: spark.conf.get(name, None) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def steps_in_order(events: DataFrame, late: str = LATE) -> DataFrame:
    """Stream of :data:`STEPS` from a stream with receipt_id, caller, step_kind and issued; receipts that come twice count once."""
    ship(events.sparkSession)
    seen = once(events.withColumn("second", F.date_trunc("second", "issued")), late, "second").select("caller", "receipt_id", "step_kind", "second", F.unix_micros("issued").alias("us"))
    return seen.groupBy("caller").transformWithStateInPandas(StepsInOrder(), STEPS, "append", "eventTime", eventTimeColumnName="issued")


def write_then_call(steps: DataFrame, within_s: int = 600) -> DataFrame:
    """A tool call right after a memory write of the same caller, within some seconds; over :func:`steps_in_order`."""
    near = (F.col("prev_kind") == "memory_write") & (F.col("step_kind") == "tool_call") & (F.col("gap_s") <= within_s)
    return steps.filter(near).select("caller", "prev_id", "receipt_id", "gap_s")


def busy(steps: DataFrame, least: int) -> DataFrame:
    """Receipts at which the caller had ``least`` or more in the hour up to it; over :func:`steps_in_order`."""
    return steps.filter(F.col("last_hour") >= least).select("caller", "receipt_id", "issued", "last_hour")
