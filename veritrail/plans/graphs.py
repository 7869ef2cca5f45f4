"""Queries over step graphs that fail every check somewhere: planted cycles, lost parents, missing blocks, mixed ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import trajectory
from veritrail.operators.scan import sliced
from veritrail.plans import oracle as sql
from veritrail.plans.catalog import query
from veritrail.runtime import materialize
from veritrail.sources import derived


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls of a caller as one dense graph in layers of three, each step below all of the layer before; some are spoilt.

    By the caller's first event: every fifth graph with a second layer gets a way back from its last step to its first;
    others have a step without a block, a step of another trajectory, or a parent that does not exist.
    """
    order = [F.col("ts"), F.col("receipt_id")]
    calls = derived.calls(spark, sf_dir)
    steps = sliced(calls, ["caller"], order).scan(["caller"], order, running={"_step": F.lit(1)}, first={"_first": F.col("event_id")}).rows
    steps = materialize(steps.select("caller", "receipt_id", (F.col("_step") - 1).alias("i"), F.floor((F.col("_step") - 1) / 3).alias("layer"), F.col("_first").alias("first")), "layered")
    ends = steps.groupBy("caller").agg(F.max("i").alias("last"), F.max_by("receipt_id", "i").alias("last_id"))
    above = steps.groupBy("caller", (F.col("layer") + 1).alias("layer")).agg(F.sort_array(F.collect_list("receipt_id")).alias("up"))  # three at most
    told = steps.join(ends, "caller").join(above, ["caller", "layer"], "left")
    back = (F.col("i") == 0) & (F.col("last") > 2) & (F.col("first") % 5 == 0)
    lost = (F.col("i") == F.col("last")) & (F.col("first") % 13 == 6)
    parents = F.concat(F.coalesce("up", F.array().cast("array<string>")), F.when(back, F.array("last_id")).otherwise(F.array().cast("array<string>")), F.when(lost, F.array(F.lit("lost"))).otherwise(F.array().cast("array<string>")))
    return told.select(
        F.concat(F.lit("trj-"), "caller").alias("audit"),
        "receipt_id",
        F.when((F.col("i") == F.col("last")) & (F.col("first") % 11 == 4), "another").otherwise(F.concat(F.lit("trj-"), "caller")).alias("trajectory_id"),
        F.when((F.col("i") == F.col("last")) & (F.col("first") % 7 == 3), F.lit(None)).otherwise(parents).alias("parent_step_ids"),
    )


_LAYERED_SQL = f"""{sql.CALLS}, k AS (SELECT caller, receipt_id, row_number() OVER w - 1 AS i, first_value(event_id) OVER w AS first FROM calls WINDOW w AS (PARTITION BY caller ORDER BY ts, receipt_id)),
g AS (SELECT caller, any_value(first) AS first, max(i) AS last FROM k GROUP BY caller),
state AS (SELECT 'trj-' || caller AS audit, NOT (first % 7 = 3) AS block, NOT (first % 11 = 4 AND last > 0) AS shared, NOT (first % 13 = 6 AND NOT first % 7 = 3) AS whole,
    NOT (first % 5 = 0 AND last > 2 AND NOT first % 7 = 3) AS acyclic, NOT (last = 0 AND first % 13 = 6) OR first % 7 = 3 AS root FROM g)"""


@query(
    f"""WITH {_LAYERED_SQL}, rows AS (SELECT audit, block, shared, unnest(range(5)) AS no, unnest(['has_trajectory_block', 'shared_trajectory_id', 'no_dangling_parents', 'dag_acyclic', 'has_root_step']) AS "check",
    unnest([block, shared, whole, acyclic, root]) AS ok FROM state)
  SELECT audit, "check", ok FROM rows WHERE no = 0 OR block AND (no = 1 OR shared)"""
)
def graph_checks_spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.dag_checks(materialize(_layered(spark, sf_dir), "steps"), "audit")


@query(f"WITH {_LAYERED_SQL} SELECT audit FROM state WHERE NOT acyclic")
def cyclic_graphs_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs with a cycle, all taken apart by joins as if they were too large for a task."""
    return trajectory.cyclic(_layered(spark, sf_dir), "audit", small=0)
