"""Detection queries over receipts (A6-A14, J9, J10, W4-W6): grouped counts, neighbours and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions.times import day
from veritrail.operators.scan import sliced


def caller_activity(calls: DataFrame) -> DataFrame:
    return calls.groupBy("caller").agg(F.count_if(F.col("step_kind") == "tool_call").alias("actions"), F.count_if(F.col("step_kind") == "retrieval").alias("retrievals"), F.count("*").alias("receipts"))


def caller_denies(decided: DataFrame) -> DataFrame:
    return decided.groupBy("caller").agg(F.count_if(F.col("decision") == "deny").alias("denies")).filter("denies > 0")


def near_misses(decided: DataFrame, at_least: int = 1) -> DataFrame:
    """Allowed decisions by caller and rule that applied."""
    fired = decided.filter("decision = 'allow'").select("caller", F.explode("rules_fired").alias("rule"))
    return fired.groupBy("caller", "rule").agg(F.count("*").alias("hits")).filter(F.col("hits") >= at_least)


def session_shape(steps: DataFrame) -> DataFrame:
    kinds = steps.groupBy("session_id", "step_kind").agg(F.count("*").alias("c"))
    return kinds.groupBy("session_id").agg(F.sum("c").alias("steps"), F.count("*").alias("kinds"), (F.count("*") == 1).alias("single_shape"))


def rate_anomaly(calls: DataFrame, factor: float = 3.0, least: int = 5) -> DataFrame:
    """Hours in which a caller has ``factor`` times its mean over its active hours, and ``least`` calls or more."""
    hours = calls.groupBy("caller", F.floor(F.unix_seconds("ts") / 3600).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    mean = hours.groupBy("caller").agg(F.sum("n").alias("total"), F.count("*").alias("hours"))
    return hours.join(mean, "caller").filter((F.col("n") >= least) & (F.col("n") * F.col("hours") >= factor * F.col("total"))).select("caller", "hour", "n", "total", "hours")


def trailing_hour(calls: DataFrame) -> DataFrame:
    """Each call with the caller's number of calls in the hour up to it.

    Calls are counted per caller and second first. The number up to a second less the number up to an hour and a second
    before it is what is asked for; both are running sums of one scan, in which every second stands twice.
    """
    at = F.unix_seconds("ts")
    seconds = calls.groupBy("caller", at.alias("_for")).agg(F.count(F.lit(1)).alias("_c"))
    twice = seconds.select("caller", "_for", F.explode(F.array(F.struct(F.col("_for").alias("at"), F.lit(0).alias("past"), F.col("_c").alias("c")), F.struct((F.col("_for") - 3601).alias("at"), F.lit(1).alias("past"), F.lit(0).cast("long").alias("c")))).alias("x")).select("caller", "_for", "x.*")
    order = [F.col("at"), F.col("past")]
    summed = sliced(twice, ["caller"], order).scan(["caller"], order, running={"_upto": F.col("c")}).rows
    hour = summed.groupBy("caller", "_for").agg(F.sum(F.when(F.col("past") == 0, F.col("_upto")).otherwise(-F.col("_upto"))).alias("last_hour")).withColumnRenamed("caller", "_caller")
    same = F.col("caller").eqNullSafe(F.col("_caller")) & at.eqNullSafe(F.col("_for"))
    return calls.join(hour, same).select("event_id", "caller", "last_hour")


def baseline(calls: DataFrame, what: str = "step_kind") -> DataFrame:
    """Sums per caller, hour of day and ``what`` (caller, hour, what, n, first_day, last_day), from which a baseline is kept.

    Sums of batches are merged by :func:`merged_baseline`, so a baseline grows by batch and old calls are not read again.
    """
    day, hour = F.floor(F.unix_seconds("ts") / 86400), F.pmod(F.floor(F.unix_seconds("ts") / 3600), F.lit(24))
    return calls.groupBy("caller", hour.cast("int").alias("hour"), what).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def merged_baseline(parts: DataFrame, what: str = "step_kind") -> DataFrame:
    return parts.groupBy("caller", "hour", what).agg(F.sum("n").alias("n"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def seasonal_drift(known: DataFrame, recent: DataFrame, factor: int = 3, least: int = 5, what: str = "step_kind") -> DataFrame:
    """Recent calls against the baseline of the same caller and hour of day: caller, hour, usual, seen, days, recent_days, state.

    ``known`` and ``recent`` are sums from :func:`baseline`. A day of the recent part is held against a day of the baseline,
    in whole numbers: ``more`` where the rate is at least ``factor`` times the usual one with ``least`` calls or more, ``new``
    for a caller without a baseline, ``silent`` for one with ``least`` calls before and none now, ``less`` where the rate fell
    by the factor, ``usual`` otherwise. Days are counted over the whole of each part.
    """
    span = lambda df: df.agg((F.max("last_day") - F.min("first_day") + 1).cast("long")).first()[0] or 1
    days, recent_days = span(known), span(recent)
    per_hour = lambda df, n: df.groupBy("caller", "hour").agg(F.sum("n").alias(n))
    callers = known.select(F.col("caller").alias("_caller")).distinct()
    now = recent.select(F.col("caller").alias("_now")).distinct()
    both = per_hour(known, "usual").join(per_hour(recent, "seen"), ["caller", "hour"], "full").na.fill(0, ["usual", "seen"])
    both = both.join(callers, F.col("caller") == F.col("_caller"), "left").join(now, F.col("caller") == F.col("_now"), "left")
    rate, usual = F.col("seen") * days, F.col("usual") * recent_days
    state = (
        F.when(F.col("_caller").isNull(), "new")
        .when(F.col("_now").isNull() & (F.col("usual") >= least), "silent")
        .when((F.col("seen") >= least) & (rate >= usual * factor), "more")
        .when((F.col("usual") >= least) & (rate * factor <= usual), "less")
        .otherwise("usual")
    )
    return both.select("caller", "hour", "usual", "seen", F.lit(days).alias("days"), F.lit(recent_days).alias("recent_days"), state.alias("state"))


def source_mix(calls: DataFrame, agent: str = "agent_id", source: str = "content_source") -> DataFrame:
    """Share of each content source in what an agent read in an hour of day, and in all hours: agent, hour, source, n, share, usual."""
    hour = F.pmod(F.floor(F.unix_seconds("ts") / 3600), F.lit(24)).cast("int")
    cells = calls.groupBy(F.col(agent).alias("agent"), hour.alias("hour"), F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    in_hour = cells.groupBy("agent", "hour").agg(F.sum("n").alias("_hour"))
    of_source = cells.groupBy("agent", "source").agg(F.sum("n").alias("_source"))
    whole = cells.groupBy("agent").agg(F.sum("n").alias("_all"))
    joined = cells.join(in_hour, ["agent", "hour"]).join(of_source, ["agent", "source"]).join(whole, "agent")
    return joined.select("agent", "hour", "source", "n", F.round(F.col("n") / F.col("_hour"), 9).alias("share"), F.round(F.col("_source") / F.col("_all"), 9).alias("usual"))


def kind_drift(calls: DataFrame, split_s: int) -> DataFrame:
    """KL divergence of each caller's step kinds after ``split_s`` (epoch) from all callers' before it, kinds add-one smoothed."""
    late = F.unix_seconds("ts") >= split_s
    base = calls.groupBy("step_kind").agg((F.count_if(~late) + 1).alias("q")).withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy()))
    recent = calls.filter(late).groupBy("caller", "step_kind").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("caller"))
    return recent.withColumn("p", p).join(F.broadcast(base), "step_kind").groupBy("caller").agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 9).alias("kl"))


def write_then_call(steps: DataFrame, within_s: int = 600) -> DataFrame:
    """Adjacent steps of a caller where a memory write is followed by a tool call within some seconds."""
    order = [F.col("ts"), F.col("receipt_id")]
    before = sliced(steps, ["caller"], order).scan(["caller"], order, previous={"_before": ["step_kind", "receipt_id", "ts"]}).rows
    gap = F.unix_seconds("ts") - F.unix_seconds("_before.ts")
    return before.filter((F.col("_before.step_kind") == "memory_write") & (F.col("step_kind") == "tool_call") & (gap <= within_s)).select("caller", F.col("_before.receipt_id").alias("prev_id"), "receipt_id", gap.alias("gap_s"))


def kind_ratio(calls: DataFrame) -> DataFrame:
    """Share of each step kind in a caller's day."""
    per = calls.groupBy("caller", day(F.col("ts")).alias("day"), "step_kind").agg(F.count("*").alias("n"))
    return per.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("caller", "day")), 9))


def sorted_percentiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, min, max, mean and the p50, p95, p99, p999 of each key: the value at place floor(p * (n - 1)) of all in order.

    Equal values are counted before they are sorted, and the values of a key are numbered in slices where they are
    many, so neither a key with very many rows nor one with very many different values is sorted in one task. Nulls
    of ``value`` do not count.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    totals = counts.groupBy(key).agg(F.sum("c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(F.col(value) * F.col("c")).alias("_sum"))
    order = [F.col(value)]
    upto = sliced(counts, [key], order).scan([key], order, running={"upto": F.col("c")}).rows
    ranked = upto.withColumnRenamed(key, "_key").join(totals, F.col("_key").eqNullSafe(F.col(key)))
    places = {"p50": F.expr("(n - 1) div 2"), **{name: F.floor(F.lit(p) * (F.col("n") - 1)) for name, p in (("p95", 0.95), ("p99", 0.99), ("p999", 0.999))}}
    at = [F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in places.items()]
    return ranked.groupBy(key).agg(F.max("n").alias("count"), F.max("min").alias("min"), *at, F.max("max").alias("max"), (F.max("_sum") / F.max("n")).alias("mean"))


def labelled(rows: DataFrame, names: DataFrame, max_names: int = 100_000) -> DataFrame:
    """Left join with names of caller hashes (caller_hash, label); the first label of a hash in text order, the hash itself without one.

    The names are broadcast where there are at most ``max_names`` of them.
    """
    one = names.groupBy("caller_hash").agg(F.min("label").alias("label"))
    small = one.limit(max_names + 1).count() <= max_names
    return rows.join(F.broadcast(one) if small else one, "caller_hash", "left").withColumn("label", F.coalesce("label", "caller_hash"))
