"""Trajectories: linking steps, checks of the step graph and roll-ups."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import text
from veritrail.operators.scan import sliced
from veritrail.runtime import discard, materialize, ship

SESSION_GAP_S = 1800
#: Edges of a group up to which its cycles are looked for in the memory of one task.
SMALL_GRAPH = 200_000
#: Layers of a large graph that go between two searches for chains.
LAYERS = 48
CHECKS = ("has_trajectory_block", "shared_trajectory_id", "no_dangling_parents", "dag_acyclic", "has_root_step")


def linked_sessions(calls: DataFrame, gap: int = SESSION_GAP_S) -> DataFrame:
    """Steps of sessions (a caller's calls without a gap): session_id, trajectory_id, step_index, parent_step_ids.

    Callers and sessions are scanned in slices, so one with most of the calls is spread over tasks.
    """
    order = [F.col("ts"), F.col("receipt_id")]
    rows = sliced(calls, ["caller"], order).scan(["caller"], order, previous={"_before": ["ts", "receipt_id"]}, running={"_row": F.lit(1)})
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros("_before.ts") > gap * 1_000_000).cast("int"), F.lit(1))
    rows = rows.add({"_new": new}).scan(["caller"], order, running={"_n": F.col("_new")}, latest={"_start": F.when(F.col("_new") == 1, F.col("_row"))}).rows
    session = F.concat_ws("/", "caller", F.col("_n").cast("string"))
    return rows.withColumn("session_id", session).withColumns(
        {
            "trajectory_id": F.concat(F.lit("trj_"), F.substring(F.sha2(F.col("session_id").cast("binary"), 256), 1, 32)),
            "step_index": (F.col("_row") - F.col("_start")).cast("int"),
            "parent_step_ids": F.when(F.col("_new") == 1, F.array().cast("array<string>")).otherwise(F.array("_before.receipt_id")),
        }
    ).drop("_new", "_n", "_before", "_row", "_start", "_slice")


def next_steps(calls: DataFrame) -> DataFrame:
    """Steps of given trajectories, each the successor of the one before.

    ``calls`` has trajectory_id, ts, receipt_id and optionally step_kind,
    agent_id, session_id (of the trajectory) and request_session_id. An agent or
    session holds until another is named; a request's session wins over the
    trajectory's for its step and after; a step's kind is its own. A row without
    receipt_id advances the number and leaves the parents as they were, so the
    rows that are returned, those with a receipt, may have gaps in step_index.
    A trajectory is scanned in slices.
    """
    have = lambda c: F.col(c) if c in calls.columns else F.lit(None).cast("string")
    order = [F.col("ts"), F.col("receipt_id").asc_nulls_last()]
    rows = calls.withColumns({"_agent": have("agent_id"), "_session": F.coalesce(have("request_session_id"), have("session_id"))}).drop("agent_id", "session_id")
    # rows of a time that have no receipt cannot be told apart; any number orders them
    ready = sliced(rows.withColumn("_tie", F.monotonically_increasing_id()), ["trajectory_id"], order)
    steps = ready.scan(
        ["trajectory_id"],
        [*order, F.col("_tie")],
        running={"_step": F.lit(1)},
        latest={"agent_id": F.col("_agent"), "session_id": F.col("_session")},
        before={"_parent": F.col("receipt_id")},
        first={"trajectory_started_at": F.col("ts")},
    ).rows
    steps = steps.withColumns({"step_index": (F.col("_step") - 1).cast("int"), "parent_step_ids": F.when(F.col("_parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("_parent"))})
    return steps.drop("_step", "_parent", "_agent", "_session", "_tie", "_slice").filter("receipt_id IS NOT NULL")


def edges(receipts: DataFrame, group: str = "trajectory_id") -> DataFrame:
    return receipts.select(group, "receipt_id", F.explode("parent_step_ids").alias("parent_id"))


def dangling(receipts: DataFrame, group: str = "trajectory_id") -> DataFrame:
    """Parent references without a receipt in the same group."""
    have = receipts.select(group, F.col("receipt_id").alias("parent_id"))
    return edges(receipts, group).join(have, [group, "parent_id"], "left_anti").select(group, "receipt_id", "parent_id")


def _looped(rows: list[tuple]) -> set:
    """Groups with a cycle among whole groups of edges (group, child, parent): vertices without parents left go until none is."""
    waits, below = Counter(), defaultdict(list)
    for g, child, parent in rows:
        waits[g, child] += 1
        below[g, parent].append((g, child))
    free = [p for p in below if p not in waits]
    while free:
        for child in below.pop(free.pop(), ()):
            waits[child] -= 1
            if not waits[child]:
                free.append(child)
    return {g for (g, _), n in waits.items() if n}


def _small_cyclic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups with a cycle, from edges in order of group; some ``SMALL_GRAPH`` edges are held at a time."""
    held, schema = [], None
    for batch in batches:
        schema = pa.schema([batch.schema.field(0)])
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) >= SMALL_GRAPH and row[0] != held[-1][0]:
                yield pa.RecordBatch.from_arrays([pa.array(_looped(held), schema.types[0])], schema=schema)
                held = []
            held.append(row)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(_looped(held), schema.types[0])], schema=schema)


def cyclic(receipts: DataFrame, group: str = "trajectory_id", small: int = SMALL_GRAPH) -> DataFrame:
    """Groups with a cycle. A parent without a receipt has no parents itself, so it is on no cycle.

    Groups of at most ``small`` parents are sorted topologically, each in memory of a task; larger ones by joins
    (:func:`_large_cyclic`). The larger ones are told by a broadcast, as they are at most one per ``small`` parents:
    after a join by the group Spark would leave out the exchange by the group and may then read its input in any order.
    """
    ship(receipts.sparkSession)
    child = receipts.filter(F.size(F.coalesce("parent_step_ids", F.array())) > 0).select(group, "receipt_id", "parent_step_ids")
    if small <= 0:
        return _large_cyclic(child, group)
    large = materialize(child.groupBy(group).agg(F.sum(F.size("parent_step_ids")).alias("_n")).filter(F.col("_n") > small).select(group), "large")
    schema = child.select(group).schema
    in_task = lambda rows: materialize(edges(rows, group).repartition(group).sortWithinPartitions(group).mapInArrow(_small_cyclic, schema), "cyclic")
    if large.isEmpty():
        return in_task(child)
    some = F.broadcast(large)
    return in_task(child.join(some, group, "left_anti")).unionByName(_large_cyclic(child.join(some, group, "left_semi"), group))


def _large_cyclic(child: DataFrame, group: str) -> DataFrame:
    """Groups with a cycle, by joins over numbers of sets of parents; ``child`` has the receipts with parents.

    Receipts of a group with the same parents are one vertex, their set of parents; it is below another set where it names
    a receipt that has that one. A cycle of receipts goes through their sets, and from one of sets to the next leads a
    receipt that is named, so no cycle is lost or made, also where a receipt comes twice. Sets with one parent are then
    followed upwards by doubling, so that chains of any length take log2(n) steps (:func:`_without_chains`), again while
    this takes half of the edges. Of what is left, layers go from the top, each by the edges of the layer before alone
    (:func:`_without_layers`), up to ``LAYERS`` before chains are looked for again. What never goes is on or below a cycle.
    """
    rows = materialize(child.select(group, "receipt_id", F.sort_array(F.array_distinct("parent_step_ids")).alias("_up")), "receipts")
    key = text.digest(F.to_json(F.struct(F.col(group), "_up"))).alias("_key")
    sets = materialize(rows.select(group, "_up").distinct().withColumn("_v", F.monotonically_increasing_id()), "sets")
    longest = sets.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    named = sets.select(group, F.col("_v").alias("child"), F.explode("_up").alias("receipt_id"))
    met = named.join(rows.select(group, "receipt_id", key), [group, "receipt_id"]).select("child", "_key").distinct()
    left = materialize(met.join(sets.select(key, F.col("_v").alias("parent")), "_key").select("child", "parent"), "edges")
    discard(rows)
    found, n, ended = [], left.count(), False
    while n and not ended:
        shorter, loops = _without_chains(left, longest)
        found += loops
        after, m = shorter, shorter.count()
        if 2 * m > n:
            after, ended = _without_layers(shorter)
            m = after.count()
        for old in {id(x): x for x in (left, shorter) if x is not after}.values():
            discard(old)
        left, n = after, m
    looped = reduce(DataFrame.unionByName, [left, *found]).select(F.col("child").alias("_v"))
    return materialize(sets.join(looped.distinct(), "_v", "left_semi").select(group).distinct(), "cyclic")


def _without_layers(graph: DataFrame) -> tuple[DataFrame, bool]:
    """Edges (child, parent) below what has no parents, without up to ``LAYERS`` layers; whether there is no further layer."""
    spark = graph.sparkSession
    waits = graph.groupBy("child").agg(F.count("*").alias("waits"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # kept by parent, so that a layer moves to its edges and they stay where they are
    by_parent = graph.join(waits, "child").repartition(parts, "parent").persist()
    tops = graph.select("parent").distinct().join(waits.select(F.col("child").alias("parent")), "parent", "left_anti")
    state = materialize(tops.select(F.col("parent").alias("child"), F.lit(0).cast("long").alias("waits"), F.lit(0).cast("long").alias("met")), "layer")
    went, ended = [], False
    for _ in range(LAYERS):
        layer = state.filter("met = waits").select(F.col("child").alias("parent"))
        if layer.isEmpty():
            ended = True
            break
        went.append(state)
        met = by_parent.join(layer.hint("shuffle_hash"), "parent").select("child", "waits", F.lit(1).cast("long").alias("met"))
        waiting = state.filter("met < waits")
        state = materialize(met.unionByName(waiting).groupBy("child").agg(F.max("waits").alias("waits"), F.sum("met").alias("met")), "layer")
    if not went:
        by_parent.unpersist()
        return graph, True
    gone = reduce(DataFrame.unionByName, [s.filter("met = waits").select(F.col("child").alias("parent")) for s in went])
    left = materialize(by_parent.join(gone.hint("shuffle_hash"), "parent", "left_anti").select("child", "parent"), "edges")
    by_parent.unpersist()
    for s in (*went, state):
        discard(s)
    return left, ended


def _without_chains(graph: DataFrame, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (child, parent) of vertices with several parents, led to the ends of the chains above; what is on or below a loop of single parents.

    No chain has more than ``longest`` vertices. Only those whose end is not found yet move up, each in a table of its step.
    """
    single = graph.groupBy("child").agg(F.count("*").alias("_n"), F.min("parent").alias("_end")).filter("_n = 1")
    steps = [materialize(single.select("child", "_end", F.lit(True).alias("_open")), "chains")]
    known = lambda: reduce(DataFrame.unionByName, [steps[-1], *[s.filter("NOT _open") for s in steps[:-1]]])
    members = steps[0].count()
    if not members:
        discard(steps[0])
        return graph, []
    for _ in range(min(members, longest).bit_length()):
        up = known().select(F.col("child").alias("_end"), F.col("_end").alias("_far"), F.col("_open").alias("_more"))
        higher = steps[-1].filter("_open").join(up, "_end", "left")
        steps.append(materialize(higher.select("child", F.coalesce("_far", "_end").alias("_end"), F.coalesce("_more", F.lit(False)).alias("_open")), "chains"))
        if steps[-1].filter("_open").isEmpty():
            break
    # what still goes on after more steps than a chain has members goes round; its group is known, so edges to it go
    loops = materialize(steps[-1].filter("_open").select("child", F.col("_end").alias("parent")), "loops")
    ends = known().select(F.col("child").alias("parent"), "_end", "_open")
    several = graph.join(steps[0].select("child"), "child", "left_anti")
    led = several.join(ends, "parent", "left").filter("NOT coalesce(_open, false)").select("child", F.coalesce("_end", "parent").alias("parent"))
    led = materialize(led.distinct(), "edges")
    for s in steps:
        discard(s)
    return led, [loops]


def graph_state(receipts: DataFrame, group: str = "trajectory_id", more: dict[str, Column] | None = None) -> DataFrame:
    """One row per group: ``checks``, an array of (check, ok) in order, and the aggregates ``more`` of its receipts."""
    base = receipts.groupBy(group).agg(
        F.count_if(F.col("parent_step_ids").isNull()).alias("missing"),
        (F.min("trajectory_id") == F.max("trajectory_id")).alias("one_id"),
        F.count_if(F.size(F.coalesce("parent_step_ids", F.array())) == 0).alias("roots"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )
    bad = dangling(receipts, group).select(group).distinct().withColumn("dangling", F.lit(True))
    looped = cyclic(receipts, group).withColumn("cyclic", F.lit(True))
    all_ = base.join(bad, group, "left").join(looped, group, "left")
    whole, one = F.col("missing") == 0, F.coalesce("one_id", F.lit(False))
    state = (whole, one, ~F.coalesce("dangling", F.lit(False)), ~F.coalesce("cyclic", F.lit(False)), F.col("roots") > 0)
    rows = [F.struct(F.lit(c).alias("check"), ok.alias("ok")) for c, ok in zip(CHECKS, state)]
    # The first two checks stop the audit where they fail.
    return all_.select(group, F.when(~whole, F.array(*rows[:1])).when(~one, F.array(*rows[:2])).otherwise(F.array(*rows)).alias("checks"), *(more or {}))


def dag_checks(receipts: DataFrame, group: str = "trajectory_id") -> DataFrame:
    """One row per group of receipts and check. ``receipts``: group, receipt_id, trajectory_id, parent_step_ids (null: no block)."""
    return graph_state(receipts, group).select(group, F.explode("checks").alias("x")).select(group, "x.*")


def rollup(receipts: DataFrame) -> DataFrame:
    """Sums over the receipts of each trajectory, histogram of step kinds, and worst status."""
    sums = [F.sum(c).alias(c) for c in ("total_chunks", "verified", "stale", "unauthorized", "unverified", "tampered", "total_actions", "actions_allowed", "actions_denied")]
    worst = F.max(F.when(F.col("overall_status") == "FAIL", 2).when(F.col("overall_status") == "PARTIAL", 1).otherwise(0))
    per = receipts.groupBy("trajectory_id", "step_kind").agg(F.count("*").alias("c")).groupBy("trajectory_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("step_kind").isNotNull(), F.struct("step_kind", "c"))))).alias("per_step_kind"))
    total = receipts.groupBy("trajectory_id").agg(F.count("*").alias("receipts"), *sums, worst.alias("w"))
    status = F.when(F.col("w") == 2, "FAIL").when(F.col("w") == 1, "PARTIAL").otherwise("PASS")
    return total.withColumn("overall_status", status).drop("w").join(per, "trajectory_id")
