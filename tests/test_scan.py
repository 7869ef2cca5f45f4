"""Scans in slices equal windows over the key; cycles equal a step-by-step model."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veritrail.operators import detect, index, scan, trajectory
from veritrail.operators.scan import sliced
from veritrail.runtime import materialize

from .test_kept import COLUMNS, events


@pytest.fixture()
def many_slices(spark, monkeypatch):
    """No coalescing and no key in one piece, so that a key lies in several slices."""
    monkeypatch.setattr(scan, "WHOLE_KEY", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows(df, *columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def test_scan_equals_windows(spark, many_slices):
    rng = random.Random(4)
    data = [(i, "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.randrange(50), rng.choice([None, None, f"v{i}"])) for i in range(400)]
    df = spark.createDataFrame(data, "i int, k string, t int, v string")
    order = [F.col("t"), F.col("i")]
    cut = sliced(df, ["k"], order)
    assert cut.split and cut.rows.filter("k = 'hot'").select("_slice").distinct().count() > 2
    got = cut.scan(["k"], order, previous={"p": ["i", "v"]}, running={"n": F.lit(1), "s": F.col("i")}, latest={"l": F.col("v")}, before={"b": F.col("v")}, first={"f": F.col("v")}).rows
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, behind = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "i", F.lag(F.struct("i", "v")).over(w).alias("p"), F.count("*").over(upto).alias("n"), F.sum("i").over(upto).alias("s"),
        F.last("v", ignorenulls=True).over(upto).alias("l"), F.last("v", ignorenulls=True).over(behind).alias("b"), F.first("v").over(upto).alias("f"),
    )
    assert rows(got, "i", "p", "n", "s", "l", "b", "f") == rows(want, "i", "p", "n", "s", "l", "b", "f")


def test_no_window_by_the_key_alone(spark, many_slices):
    calls = spark.createDataFrame([(1, "a", "r", "tool_call")], "event_id int, caller string, receipt_id string, step_kind string").withColumn("ts", F.current_timestamp())
    for df in (trajectory.linked_sessions(calls), trajectory.next_steps(calls.withColumnRenamed("caller", "trajectory_id")), detect.trailing_hour(calls), detect.write_then_call(calls)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if " Window " in line or line.strip().startswith("Window ")]
        big = [w for w in windows if "_slice" not in w]
        assert windows and all("_scan_" in w for w in big), big


def test_hot_caller(spark, many_slices):
    rng = random.Random(9)
    data = [(i, "hot" if rng.random() < 0.9 else f"c{i % 3}", rng.randrange(0, 40000), rng.choice(["memory_write", "tool_call", "retrieval"])) for i in range(500)]
    calls = spark.createDataFrame(data, "event_id int, caller string, s int, step_kind string").withColumn("ts", F.timestamp_seconds("s")).withColumn("receipt_id", F.format_string("r%05d", "event_id"))
    w = Window.partitionBy("caller").orderBy(F.unix_seconds("ts")).rangeBetween(-3600, 0)
    assert rows(detect.trailing_hour(calls), "event_id", "last_hour") == rows(calls.select("event_id", F.count("*").over(w).alias("last_hour")), "event_id", "last_hour")
    last, seen, want = {}, {}, []
    for i, caller, s, _ in sorted(data, key=lambda r: (r[2], r[0])):
        n = seen.get(caller, (0, 0, None))
        new = caller not in last or s - last[caller] > 100
        session, step, parent = (n[0] + 1, 0, None) if new else (n[0], n[1] + 1, n[2])
        last[caller], seen[caller] = s, (session, step, f"r{i:05d}")
        want.append((i, f"{caller}/{session}", step, [parent] if parent else []))
    got = [(r.event_id, r.session_id, r.step_index, r.parent_step_ids) for r in trajectory.linked_sessions(calls, 100).collect()]
    assert sorted(got) == sorted(want)


def test_small_keys_stay_whole(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "i int, k string")
    cut = sliced(df, ["k"], [F.col("i")])
    assert not cut.split and "_slice" not in cut.rows.columns
    assert rows(cut.scan(["k"], [F.col("i")], running={"n": F.lit(1)}).rows, "i", "n") == sorted(repr((i, i // 2 + 1)) for i in range(10))


def graph(spark, groups):
    return spark.createDataFrame([(g, v, list(ps)) for g, edges in groups.items() for v, ps in edges.items()], "trajectory_id string, receipt_id string, parent_step_ids array<string>")


def chain(n, close=False):
    return {f"n{i}": [f"n{i - 1}"] if i else ([f"n{n - 1}"] if close else []) for i in range(n)}


def layers(depth, width, back=False):
    out = {f"l{d}_{i}": [f"l{d - 1}_{j}" for j in range(width)] if d else [] for d in range(depth) for i in range(width)}
    if back:
        out["l0_0"] = [f"l{depth - 1}_0"]
    return out


GROUPS = {
    "chain": chain(50), "ring": chain(40, close=True), "self": {"a": ["a"]}, "dense": layers(6, 7), "dense_back": layers(6, 7, back=True),
    "diamond": {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}, "dangling": {"a": ["gone"], "b": ["a"]}, "tail_to_ring": chain(9, close=True) | {"x": ["n3"], "y": ["x", "z"], "z": []},
    "two": {"a": ["b"], "b": ["a"], "c": []}, "eight": {"a": ["b", "c"], "b": ["a"], "c": ["d"], "d": ["a"]}, "repeat": {"a": [], "b": ["a", "a"]}, "alone": {"a": []},
    "late_ring": layers(3, 2) | {"p": ["q", "l2_0"], "q": ["p", "l2_1"]},
}
LOOPED = {"ring", "self", "dense_back", "tail_to_ring", "two", "eight", "late_ring"}


@pytest.mark.parametrize("small", [0, 60, 10**6])
def test_cycles(spark, small):
    got = [r.trajectory_id for r in trajectory.cyclic(graph(spark, GROUPS), small=small).collect()]
    assert sorted(got) == sorted(LOOPED)


@pytest.mark.parametrize("small", [0, 10**6])
def test_random_graphs(spark, small):
    rng, groups, want = random.Random(11), {}, set()
    for g in range(40):
        n = rng.randrange(2, 9)
        edges = {f"v{i}": [f"v{j}" for j in range(n) if rng.random() < 0.22] for i in range(n)}
        groups[f"g{g}"] = edges
        reach = {v: set(ps) for v, ps in edges.items()}
        for _ in range(n):
            reach = {v: ps | {q for p in ps for q in reach.get(p, ())} for v, ps in reach.items()}
        want |= {f"g{g}"} if any(v in ps for v, ps in reach.items()) else set()
    got = {r.trajectory_id for r in trajectory.cyclic(graph(spark, groups), small=small).collect()}
    assert got == want and 5 < len(want) < 35


def test_no_receipts(spark):
    assert trajectory.cyclic(graph(spark, {"a": {"x": []}}).limit(0)).count() == 0


def test_order_statistics_of_large_keys(spark, many_slices):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float(rng.randrange(300))])) for _ in range(900)]
    got = {r.k: r for r in detect.sorted_percentiles(spark.createDataFrame(data, "k string, v double"), "k", "v").collect()}
    for k in ("a", "b", None):
        v = sorted(x for key, x in data if key == k and x is not None)
        n = len(v)
        want = (n, v[0], v[(n - 1) // 2], v[int(0.95 * (n - 1))], v[int(0.99 * (n - 1))], v[int(0.999 * (n - 1))], v[-1])
        assert tuple(got[k][:8][1:8]) == want


def test_seasonal_drift_states(spark):
    day = 86400
    rows = [("steady", 10, d) for d in range(10)] * 2 + [("gone", 3, d) for d in range(8)] + [("rising", 5, 1)] + [("rising", 5, 12)] * 6 + [("steady", 10, d) for d in (12, 13)] * 2 + [("fresh", 1, 12)] + [("falling", 7, d) for d in range(10)] * 3 + [("falling", 8, 13)]
    calls = spark.createDataFrame([(c, d * day + h * 3600, "tool_call") for c, h, d in rows], "caller string, s long, step_kind string").withColumn("ts", F.timestamp_seconds("s"))
    known, recent = detect.baseline(calls.filter(f"s < {10 * day}")), detect.baseline(calls.filter(f"s >= {10 * day}"))
    halves = detect.merged_baseline(detect.baseline(calls.filter(f"s < {4 * day}")).unionByName(detect.baseline(calls.filter(f"s >= {4 * day} AND s < {10 * day}"))))
    assert rows_of(halves) == rows_of(known)
    got = {(r.caller, r.hour): r.state for r in detect.seasonal_drift(known, recent, factor=3, least=5).collect()}
    assert got == {("steady", 10): "usual", ("gone", 3): "silent", ("rising", 5): "more", ("fresh", 1): "new", ("falling", 7): "less", ("falling", 8): "usual"}


def rows_of(df):
    return rows(df, *sorted(df.columns))


def test_superseded_counts_of_a_large_document(spark, many_slices, monkeypatch):
    log = spark.createDataFrame(events(250, seed=8, docs=2), COLUMNS)
    got = rows_of(index.superseded_counts(log))
    monkeypatch.setattr(scan, "WHOLE_KEY", 10**6)
    assert got == rows_of(index.superseded_counts(log)) and len(got) > 10


@pytest.mark.parametrize("layers_a_pass", [1, 48])
def test_layers_of_large_graphs_in_passes(spark, monkeypatch, layers_a_pass):
    monkeypatch.setattr(trajectory, "LAYERS", layers_a_pass)
    got = [r.trajectory_id for r in trajectory.cyclic(graph(spark, GROUPS), small=0).collect()]
    assert sorted(got) == sorted(LOOPED)


@pytest.fixture()
def tables(monkeypatch):
    """Labels of the tables that are written while cycles are looked for."""
    labels = []
    monkeypatch.setattr(trajectory, "materialize", lambda df, label: labels.append(label) or materialize(df, label))
    return labels


def test_tables_do_not_grow_with_layers_or_groups(spark, tables):
    """A layer of receipts with the same parents was a step of its own; loops went on for as long as all groups together."""

    def written(groups):
        tables.clear()
        assert {r.trajectory_id for r in trajectory.cyclic(graph(spark, groups), small=0).collect()} == {g for g in groups if g.startswith("back")}
        return len(tables)

    both = lambda depth: {"back": layers(depth, 3, back=True), "dag": layers(depth, 3)}
    assert written(both(64)) <= written(both(16)) + 2
    assert written({f"back{i}": chain(3, close=True) for i in range(40)}) == written({"back": chain(3, close=True)})


def test_receipts_that_come_twice(spark):
    rows = [
        ("split", "a", ["b"]), ("split", "a", ["c"]), ("split", "b", ["x"]), ("split", "c", ["d"]), ("split", "d", ["a"]),  # through the second a alone
        ("whole", "a", ["b", "c"]), ("whole", "a", ["c"]), ("whole", "b", ["c"]), ("whole", "c", ["x"]), ("whole", "c", ["y"]),
        ("nulls", "a", ["b", None]), ("nulls", "b", [None]), ("nulls", None, ["a"]), ("nulls", "c", None),
        ("order", "a", ["b", "c"]), ("order", "d", ["c", "b", "b"]), ("order", "c", ["d"]),
    ]
    df = spark.createDataFrame(rows, "trajectory_id string, receipt_id string, parent_step_ids array<string>")
    assert sorted(r.trajectory_id for r in trajectory.cyclic(df, small=0).collect()) == ["order", "split"]


@pytest.mark.parametrize("layers_a_pass", [1, 48])
def test_chains_between_joints(spark, monkeypatch, tables, layers_a_pass):
    """Joints with several chains between them are one chain once these are gone, here without any layer."""
    monkeypatch.setattr(trajectory, "LAYERS", layers_a_pass)

    def joints(n, back):
        out = {"j0": [f"j{n}"] if back else []}
        for j in range(n):
            for c in range(2):
                out |= {f"j{j}_{c}_{i}": [f"j{j}_{c}_{i - 1}" if i else f"j{j}"] for i in range(c, 4)} | {f"j{j}_{c}_{c}": [f"j{j}"]}
            out[f"j{j + 1}"] = [f"j{j}_0_3", f"j{j}_1_3"]
        return out

    got = [r.trajectory_id for r in trajectory.cyclic(graph(spark, {"back": joints(9, True), "dag": joints(9, False), "below": joints(3, False) | {"j0": ["r"], "r": ["r"]}}), small=0).collect()]
    assert sorted(got) == ["back", "below"] and "layer" not in tables


def test_random_graphs_with_receipts_twice(spark):
    rng, rows, want = random.Random(21), [], set()
    for g in range(60):
        n = rng.randrange(3, 14)
        data = [(f"g{g}", f"v{i}", [f"v{j}" for j in rng.sample(range(n + 1), min(n, rng.choice([1, 1, 1, 2, 3]))) if j > i or rng.random() < 0.1]) for i in [*range(n), rng.randrange(n)]]
        rows += data
        reach = {}
        for _, v, ps in data:
            reach.setdefault(v, set()).update(ps)
        for _ in range(n):
            reach = {v: ps | {q for p in ps for q in reach.get(p, ())} for v, ps in reach.items()}
        want |= {f"g{g}"} if any(v in ps for v, ps in reach.items()) else set()
    df = spark.createDataFrame(rows, "trajectory_id string, receipt_id string, parent_step_ids array<string>")
    assert {r.trajectory_id for r in trajectory.cyclic(df, small=0).collect()} == want and 10 < len(want) < 55


def test_edges_of_a_group_stay_in_one_task(spark):
    """Over more than a broadcast holds, the join by the group became a broadcast only as it ran, and groups were torn apart."""
    name = lambda i: F.sha2(F.concat_ws("-", "g", i.cast("string")), 256)
    steps = spark.range(2400 * 60).select((F.col("id") / 60).cast("long").cast("string").alias("g"), (F.col("id") % 60).cast("int").alias("i"))
    first = F.col("i") - F.col("i") % 3 - 3  # layers of three; every third group leads back to its start
    up = F.when(first >= 0, F.transform(F.sequence(first, first + 2), name)).when((F.col("i") == 0) & (F.col("g") % 3 == 0), F.array(name(F.lit(59)))).otherwise(F.array().cast("array<string>"))
    made = materialize(steps.select(F.col("g").alias("trajectory_id"), name(F.col("i")).alias("receipt_id"), up.alias("parent_step_ids")).repartition(16, "receipt_id"), "steps")
    got = {r.trajectory_id for r in trajectory.cyclic(made).collect()}
    assert got == {str(g) for g in range(0, 2400, 3)}
