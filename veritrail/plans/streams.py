"""Queries that replay the events as a stream and must find what the batch finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.plans.catalog import ORACLES, query
from veritrail.runtime import scratch_dir
from veritrail.sources import derived
from veritrail.streaming import stateful

#: After the last event, so that the watermark passes all of them.
END = "2200-01-01 00:00:00"


#: Rows of a file of the stream.
FILE_ROWS = 2_000_000


def replayed(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """Steps in order from the calls as files of a stream, a time range after the other; its result as a table."""
    folder = scratch_dir(spark, "stream")
    calls = derived.calls(spark, sf_dir).select("receipt_id", "caller", "step_kind", F.col("ts").alias("issued"))
    at = f"percentile_approx(unix_micros(issued), array({', '.join(f'{k / batches}D' for k in range(1, batches))}))"
    total, cuts = calls.agg(F.count("*"), F.expr(at)).first()
    number = sum((F.when(F.unix_micros("issued") > c, 1).otherwise(0) for c in cuts or []), F.lit(0))
    files = max(1, round(total / batches / FILE_ROWS))
    for k in range(batches):
        calls.filter(number == k).repartition(files).write.mode("append").parquet(f"{folder}/in")
    if files > 1 and len(spark.read.schema(calls.schema).parquet(f"{folder}/in").inputFiles()) != files * batches:
        raise RuntimeError("a range of the stream has fewer files than the others")
    spark.createDataFrame([("end", "end", "end")], "receipt_id string, caller string, step_kind string").withColumn("issued", F.lit(END).cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    # each part of a state has a store that is written once a batch, so there are no more of them than tasks can run, or rows need
    parts = max(spark.sparkContext.defaultParallelism, total // FILE_ROWS)
    with stateful.rocks(spark, parts):
        out = stateful.steps_in_order(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        out.awaitTermination()
    return spark.read.schema(stateful.STEPS).parquet(f"{folder}/out")


@query(ORACLES["memwrite_then_external"])
def memwrite_then_external_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.write_then_call(replayed(spark, sf_dir), 36000)
