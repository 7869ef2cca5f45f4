"""Readers (S1-S5, S8, S12): text files, receipts, policies, MCP requests and chunk inputs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: document_id (base name) and text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document_id"), F.col("value").alias("text"))
    return files


def one_document(files: DataFrame, document_id: str) -> DataFrame:
    """Files joined by newline, in order of their names, as one logical document."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document_id", "text"))), lambda x: x["text"]), "\n")
    return files.agg(joined.alias("text")).select(F.lit(document_id).alias("document_id"), "text")


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """Receipt files as raw JSON text by path; signatures must see the stored bytes, not a parsed form."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("receipt"))
    return raw.withColumn("malformed", F.expr("try_parse_json(receipt) IS NULL"))


def receipt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Receipts from JSON lines, one per line."""
    return spark.read.text(path).select(F.col("value").alias("receipt")).withColumn("malformed", F.expr("try_parse_json(receipt) IS NULL"))


def trajectory_fields(raw: DataFrame) -> DataFrame:
    """What trajectory audits read from raw receipts; parent_step_ids is null where there is no trajectory block."""
    field = lambda p, t: F.expr(f"try_variant_get(try_parse_json(receipt), '$.{p}', '{t}')")
    return raw.select(
        "*",
        field("receipt_id", "string").alias("receipt_id"),
        field("trajectory.trajectory_id", "string").alias("trajectory_id"),
        field("trajectory.step_index", "int").alias("step_index"),
        field("trajectory.step_kind", "string").alias("step_kind"),
        field("trajectory.parent_step_ids", "array<string>").alias("parent_step_ids"),
        field("summary.overall_status", "string").alias("overall_status"),
    )


def parquet_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc_index(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """An index in a database; the driver's jar must be on the class path. Not tested here: no database."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) t", **options).load()


def chunk_text(df: DataFrame) -> DataFrame:
    """Chunks from rows with any of page_content, content and text, in that order of preference."""
    have = [c for c in ("page_content", "content", "text") if c in df.columns]
    if not have:
        raise TypeError("chunks need page_content, content or text")
    return df.withColumn("text", F.coalesce(*have))


def _content(x):
    """Text of an object that says it by ``get_content()``; None where it has no such method, or one that needs arguments."""
    try:
        return x.get_content()
    except (AttributeError, TypeError):
        return None


def chunk_rows(spark: SparkSession, value) -> DataFrame:
    """Chunks from Python values: a text, a list of texts, or of dicts or objects with one of the known fields.

    What a scored hit holds under ``node`` is taken out first; ``get_content()`` comes before the fields.
    """
    items = [value] if isinstance(value, (str, dict)) or not isinstance(value, (list, tuple)) else list(value)
    texts = []
    for x in items:
        if not isinstance(x, (str, dict)):
            x = getattr(x, "node", x)
        if isinstance(x, str):
            texts.append(x)
            continue
        get = x.get if isinstance(x, dict) else lambda k, x=x: getattr(x, k, None)
        said = _content(x)
        found = said if isinstance(said, str) else next((t for k in ("page_content", "content", "text") if isinstance(t := get(k), str)), None)
        if found is None:
            raise TypeError(f"not a chunk: {type(x).__name__}")
        texts.append(found)
    return spark.createDataFrame(list(enumerate(texts)), "chunk_index int, text string")


def mcp_calls(raw: DataFrame, default_target: str | None = None) -> DataFrame:
    """Tool calls from JSON-RPC requests (column ``request``); other methods and arguments that are no object give null names."""
    get = lambda p, t="string": F.expr(f"try_variant_get(try_parse_json(request), '$.{p}', '{t}')")
    arguments = F.expr("to_json(try_variant_get(try_parse_json(request), '$.params.arguments', 'variant'))")
    usable = (get("method") == "tools/call") & F.coalesce(arguments.startswith("{"), F.lit(True))
    return raw.select(
        "*",
        F.when(usable, get("params.name")).alias("name"),
        F.when(usable, F.lit("invoke")).alias("operation"),
        F.when(usable, F.coalesce(arguments, F.lit("{}"))).alias("parameters"),
        F.coalesce(get("params._meta.target_system"), F.lit(default_target)).alias("target_system"),
        get("id").alias("invocation_id"),
    )
