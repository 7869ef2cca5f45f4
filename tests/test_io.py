import json

import pytest
from pyspark.sql import functions as F

from veritrail.sources import readers
from veritrail.streaming import detectors, sinks


def test_chunk_inputs(spark):
    class Doc:
        page_content = "d"

    got = [r.text for r in readers.chunk_rows(spark, ["a", {"content": "b", "text": "x"}, Doc()]).orderBy("chunk_index").collect()]
    assert got == ["a", "b", "d"]
    assert readers.chunk_rows(spark, "one").count() == 1
    with pytest.raises(TypeError):
        readers.chunk_rows(spark, [3])


def test_files_and_receipts(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\nlines")
    (tmp_path / "a.txt").write_text("one")
    files = readers.text_files(spark, str(tmp_path / "*.txt"))
    assert readers.one_document(files, "doc").first().text == "one\ntwo\nlines"
    (tmp_path / "r1.json").write_text(json.dumps({"receipt_id": "p", "trajectory": {"trajectory_id": "t", "parent_step_ids": ["q"]}}, indent=1))
    (tmp_path / "r2.json").write_text("{bad")
    rows = {r.malformed: r for r in readers.trajectory_fields(readers.receipts(spark, str(tmp_path))).collect()}
    assert rows[False].parent_step_ids == ["q"] and rows[True].receipt_id is None


def test_mcp(spark):
    reqs = [{"id": 1, "method": "tools/call", "params": {"name": "f", "arguments": {"a": 1}}}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "g", "arguments": [1]}}]
    rows = readers.mcp_calls(spark.createDataFrame([(json.dumps(r),) for r in reqs], "request string"), "sys").collect()
    assert [(r.name, r.parameters, r.target_system) for r in rows] == [("f", '{"a":1}', "sys"), (None, None, "sys"), (None, None, "sys")]


def test_sinks_fan_out_and_stream(spark, tmp_path):
    src, out, out2 = (str(tmp_path / x) for x in ("in", "out", "hourly"))
    rows = [("r1", "2024-01-01T05:00:00.000Z", '{"a":1}'), ("r2", "2024-01-02T06:00:00.000Z", '{"a":2}')]
    df = spark.createDataFrame(rows, "receipt_id string, issued_at string, receipt string")
    df.write.json(src)

    def broken(_):
        raise ValueError

    stream = spark.readStream.schema(df.schema).json(src)
    q = sinks.start(stream, sinks.fan_out([broken, sinks.jsonl(out), sinks.hourly(out2)]), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    got = spark.read.text(out).select("value", F.col("dt").cast("string").alias("dt")).collect()
    assert sorted((r.value, r.dt) for r in got) == [('{"a":1}', "2024-01-01"), ('{"a":2}', "2024-01-02")]
    assert spark.read.text(out2).count() == 2
    assert sinks.attributes(df).first().attributes == {"receipt_id": "r1"}
    assert [r.key for r in sinks.kafka_rows(df).collect()] == ["r1", "r2"]


def test_streaming_rates_equal_batch(spark, tmp_path):
    rows = [("r1", "c", "tool_call", 0), ("r1", "c", "tool_call", 0), ("r2", "c", "memory_write", 1800), ("r3", "c", "tool_call", 2000), ("r4", "d", "tool_call", 9000)]
    df = spark.createDataFrame(rows, "receipt_id string, caller string, step_kind string, s long").withColumn("issued", F.timestamp_seconds(F.col("s") + 1704067200))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    for name, f, expect in (("rates", detectors.rates, {("c", 3), ("d", 1)}),):
        q = f(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert {(r.caller, r.n) for r in spark.table(name).collect()} == expect
    near = detectors.write_then_call(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("near").outputMode("append").trigger(availableNow=True).start()
    assert near.awaitTermination(120)
    assert [(r.write_id, r.call_id) for r in spark.table("near").collect()] == [("r2", "r3")]
