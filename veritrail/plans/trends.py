"""Queries over a baseline that is kept by batch, and order statistics of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import detect
from veritrail.plans import oracle as sql
from veritrail.plans.catalog import _SPLIT, query
from veritrail.runtime import materialize
from veritrail.runtime import spread_table as table
from veritrail.sources import derived

_S = "(epoch_us(ts) // 1000000)"
#: Callers that come with the recent part or went before it, beside those of the events.
_MOVED = f"CASE WHEN user_id % 10 = 1 AND {_S} >= {_SPLIT} THEN 'joined-' || user_id WHEN user_id % 10 = 2 AND {_S} < {_SPLIT} THEN 'left-' || user_id ELSE 'user-' || user_id END"


def _with_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = derived.calls(spark, sf_dir)
    late = F.unix_seconds("ts") >= _SPLIT
    named = F.when((F.col("user_id") % 10 == 1) & late, F.concat(F.lit("joined-"), "user_id")).when((F.col("user_id") % 10 == 2) & ~late, F.concat(F.lit("left-"), "user_id"))
    return calls.withColumn("caller", F.coalesce(named, "caller"))


@query(
    f"""WITH c AS (SELECT {_MOVED} AS caller, ({_S} // 3600) % 24 AS hour, {_S} // 86400 AS day, {_S} >= {_SPLIT} AS late FROM events),
  d AS (SELECT coalesce(max(day) FILTER (WHERE NOT late) - min(day) FILTER (WHERE NOT late) + 1, 1) AS days, coalesce(max(day) FILTER (WHERE late) - min(day) FILTER (WHERE late) + 1, 1) AS recent_days FROM c),
  k AS (SELECT caller, hour, count(*) FILTER (WHERE NOT late) AS usual, count(*) FILTER (WHERE late) AS seen FROM c GROUP BY caller, hour),
  w AS (SELECT caller, bool_or(NOT late) AS known, bool_or(late) AS now FROM c GROUP BY caller)
  SELECT caller, hour::INT AS hour, usual, seen, days, recent_days, CASE WHEN NOT known THEN 'new' WHEN NOT now AND usual >= 2 THEN 'silent' WHEN seen >= 2 AND seen * days >= usual * recent_days * 2 THEN 'more'
    WHEN usual >= 2 AND seen * days * 2 <= usual * recent_days THEN 'less' ELSE 'usual' END AS state FROM k JOIN w USING (caller) CROSS JOIN d"""
)
def seasonal_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent calls against a baseline that was kept in two batches; some callers are new, some have fallen silent."""
    calls = _with_changes(spark, sf_dir)
    at = F.unix_seconds("ts")
    middle = F.lit(_SPLIT - 10 * 86400)
    first = materialize(detect.baseline(calls.filter(at < middle)), "baseline")
    second = detect.baseline(calls.filter((at >= middle) & (at < _SPLIT)))
    known = materialize(detect.merged_baseline(first.unionByName(second)), "baseline")
    recent = materialize(detect.baseline(calls.filter(at >= _SPLIT)), "baseline")
    return detect.seasonal_drift(known, recent, factor=2, least=2)


@query(
    f"""WITH {sql.CALLS}, c AS (SELECT 'agent-' || k AS agent, (({_S} // 3600) % 24)::INT AS hour, coalesce(CASE event_type WHEN 'view' THEN 'live_tool_output' WHEN 'error' THEN 'memory_store' END, 'user_input') AS source FROM calls),
  n AS (SELECT agent, hour, source, count(*) AS n FROM c GROUP BY ALL)
  SELECT agent, hour, source, n, round(n / sum(n) OVER (PARTITION BY agent, hour), 9) AS share, round(sum(n) OVER (PARTITION BY agent, source) / sum(n) OVER (PARTITION BY agent), 9) AS usual FROM n WHERE agent IS NOT NULL"""
)
def source_mix_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content sources of each agent by hour of day."""
    source = F.when(F.col("event_type") == "view", "live_tool_output").when(F.col("event_type") == "error", "memory_store").otherwise("user_input")
    calls = derived.calls(spark, sf_dir).withColumns({"agent_id": F.concat(F.lit("agent-"), "k"), "content_source": source}).filter("agent_id IS NOT NULL")
    return detect.source_mix(calls)


@query(
    """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL)
  SELECT l_returnflag, max(n) AS "count", min(v) AS min, max(v) AS max, max(v) FILTER (WHERE i = (n - 1) // 2) AS p50, max(v) FILTER (WHERE i = floor(0.95::DOUBLE * (n - 1))) AS p95,
    max(v) FILTER (WHERE i = floor(0.99::DOUBLE * (n - 1))) AS p99, max(v) FILTER (WHERE i = floor(0.999::DOUBLE * (n - 1))) AS p999 FROM r GROUP BY l_returnflag"""
)
def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys with very many rows and nearly as many different values."""
    return detect.sorted_percentiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice").drop("mean")
