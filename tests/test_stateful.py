"""The stateful detectors over late and repeated receipts equal a step-by-step model."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritrail.streaming import stateful

SCHEMA = "receipt_id string, caller string, step_kind string, issued timestamp"


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(stateful.PROVIDER, None)
    with stateful.rocks(spark):
        yield spark
    assert spark.conf.get(stateful.PROVIDER, None) == before


def test_out_of_order_and_repeated(rocks, tmp_path):
    rng = random.Random(6)
    rows = [(f"r{i:03d}", f"c{rng.randrange(3)}", rng.choice(["memory_write", "tool_call", "retrieval"]), 1_900_000_000 + rng.randrange(9000)) for i in range(120)]
    by_time = sorted(rows, key=lambda r: r[3])
    batches = [by_time[:50], by_time[50:90], by_time[90:]]
    batches[1] += batches[0][-5:]  # sent again
    batches[0], batches[1] = batches[0][:-8] + batches[1][:3], batches[0][-8:] + batches[1][3:]  # late, within the hour
    batches.append([("end", "end", "x", 4_000_000_000)])
    for b in batches:
        df = rocks.createDataFrame(b, "receipt_id string, caller string, step_kind string, s long")
        df.select("receipt_id", "caller", "step_kind", F.timestamp_seconds("s").alias("issued")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.steps_in_order(stream, "2 hours").writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.receipt_id: (r.caller, r.last_hour, r.prev_id, r.gap_s) for r in rocks.table("steps").filter("caller <> 'end'").collect()}
    want, last = {}, {}
    for rid, caller, kind, s in sorted(rows, key=lambda r: (r[3], r[0])):
        n = sum(1 for r in rows if r[1] == caller and s - 3600 <= r[3] <= s)
        p = last.get(caller)
        want[rid] = (caller, n, p and p[0], p and s - p[1])
        last[caller] = (rid, s)
    assert got == want
    pairs = {(r.prev_id, r.receipt_id) for r in stateful.write_then_call(rocks.table("steps"), 500).collect()}
    kinds = {r[0]: r[2] for r in rows}
    assert pairs == {(p, rid) for rid, (_, _, p, g) in want.items() if p and kinds[p] == "memory_write" and kinds[rid] == "tool_call" and g <= 500}
    assert stateful.busy(rocks.table("steps"), 3).count() == sum(n >= 3 for _, n, _, _ in want.values())


class _State:
    """A state that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattr__(self, name):
        def call(*value):
            self.calls.append(name)
            if name == "get":
                return self.held
            self.held = (self.held or []) + value[0] if name == "appendList" else (None if name == "clear" else value[0])

        return call


class _Rows(_State):
    def __getattr__(self, name):
        return (lambda: iter(super(_Rows, self).__getattr__("get")() or [])) if name == "get" else super().__getattr__(name)


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getListState(self, *_):
        return _Rows(self.calls)

    def getValueState(self, *_):
        return _State(self.calls)

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def test_a_batch_costs_few_calls_a_caller():
    """One timer and a dozen calls to the state, however many seconds a caller's receipts lie in."""
    step, handle, n = stateful.StepsInOrder(), _Handle(), 500
    step.init(handle)
    frame = pd.DataFrame({"us": [i * 90_000_000 for i in range(n)], "receipt_id": [f"r{i:03d}" for i in range(n)], "step_kind": "x"})
    assert not list(step.handleInputRows(("c",), iter([frame]), _Clock(0))) and handle.timers == {0}
    (first,) = step.handleExpiredTimer(("c",), _Clock(90_000 * (n - 100) - 1), _Clock(0))
    assert first["receipt_id"].tolist() == [f"r{i:03d}" for i in range(n - 100)] and len(handle.calls) < 16
    (rest,) = step.handleExpiredTimer(("c",), _Clock(10**12), _Clock(10**12))
    assert rest["receipt_id"].tolist() == [f"r{i:03d}" for i in range(n - 100, n)] and rest["prev_id"][0] == "r399" and set(rest["last_hour"]) == {41}


def test_receipts_just_before_the_watermark(rocks, tmp_path):
    """What comes shortly before a watermark must leave with it: Spark refuses rows older than the watermark of the batch before."""
    for start in (0, 4000):
        df = rocks.range(4000).select(F.concat(F.lit("r"), (F.col("id") + start).cast("string")).alias("receipt_id"), F.lit("c").alias("caller"), F.lit("x").alias("step_kind"), F.timestamp_millis((F.col("id") + start) * 1100 + 1_900_000_000_000).alias("issued"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rocks.sql("SELECT 'end' AS receipt_id, 'end' AS caller, 'x' AS step_kind, timestamp_seconds(4000000000) AS issued").write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.steps_in_order(stream).writeStream.format("memory").queryName("before").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = rocks.table("before").filter("caller = 'c'")
    assert got.count() == 8000 and got.filter("gap_s IS NULL OR NOT gap_s IN (1, 2)").count() == 1
