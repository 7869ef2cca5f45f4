"""Small helpers that several operators of this package use."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.runtime import materialize, ship

#: Rows of one Arrow batch between the JVM and Python; texts may be long.
BATCH_ROWS = 400
#: Bytes of text that Python code works on at once.
SLICE_BYTES = 4 << 20

#: White space of the word patterns: space and the ASCII controls from tab to carriage return.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers and bound the size of Arrow batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Add a key of each row, so that repeated or null ids never merge rows."""
    return df.withColumn(name, F.monotonically_increasing_id())


def stable_rows(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Add a key of each row that is the same whenever the rows are read again.

    Rows of files get the file's hash and their place in it, which do not
    depend on how files are split among tasks. Other tables are written to the
    shared folder once, with a key, and read from there.
    """
    # the plan says whether its rows come straight from files, without an error to provoke
    if "_metadata#" in df._jdf.queryExecution().analyzed().metadataOutput().mkString(","):
        return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias(name))
    keyed = df.withColumn(name, F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("i")))
    return materialize(keyed, "rows")


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that nothing uses back to the system, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_state: dict = {}


def worker_state(kind: str, key, build: Callable):
    """What ``build`` makes, kept in this process for the next task; a worker holds the state of one operator at a time."""
    if _state.get("key") != (kind, key):
        _state.clear()
        trim()
        _state.update(key=(kind, key), value=build())
    return _state["value"]


def bucket_of_id(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as empty text."""
    value = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.pmod(F.crc32(F.coalesce(value, F.lit("")).cast("binary")), F.lit(n))


def hash_below(col: str, part: int, whole: int) -> Column:
    """Whether a row is among the share ``part`` of ``whole`` with the least hashes of ``col``."""
    return F.pmod(F.xxhash64(col), F.lit(1 << 62)) < F.lit((1 << 62) * part // whole)


def bucket_of_id_py(value, n: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % n


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with about ``limit`` bytes of text each: small ones are joined, large ones cut; no row is cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield pa.concat_batches([*held, batch.slice(start, i - start)])
                held, start, size = [], i, 0
            size += n or 0
        held.append(batch.slice(start))
    if held:
        yield pa.concat_batches(held)


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with more columns, given as name and type."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in columns.items())).fields])
