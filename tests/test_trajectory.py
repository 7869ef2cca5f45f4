from veritrail.operators import trajectory

SCHEMA = "audit string, receipt_id string, trajectory_id string, parent_step_ids array<string>"


def checks(spark, rows):
    out = {}
    for r in trajectory.dag_checks(spark.createDataFrame(rows, SCHEMA), "audit").collect():
        out.setdefault(r.audit, {})[r.check] = r.ok
    return out


def test_shapes(spark):
    rows = [
        ("chain", "a", "t", []), ("chain", "b", "t", ["a"]), ("chain", "c", "t", ["b"]),
        ("diamond", "a", "t", []), ("diamond", "b", "t", ["a"]), ("diamond", "c", "t", ["a"]), ("diamond", "d", "t", ["b", "c"]),
        ("cycle", "r", "t", []), ("cycle", "a", "t", ["c"]), ("cycle", "b", "t", ["a"]), ("cycle", "c", "t", ["b"]),
        ("self", "a", "t", ["a"]),
        ("dangling", "a", "t", []), ("dangling", "b", "t", ["zz"]),
        ("noroot", "a", "t", ["zz"]),
        ("mixed", "a", "t", []), ("mixed", "b", "u", []),
        ("missing", "a", None, None), ("missing", "b", "t", []),
    ]
    got = checks(spark, rows)
    good = dict.fromkeys(trajectory.CHECKS, True)
    assert got["chain"] == got["diamond"] == good
    assert got["cycle"] == good | {"dag_acyclic": False}
    assert got["self"] == good | {"dag_acyclic": False, "has_root_step": False}
    assert got["dangling"] == good | {"no_dangling_parents": False}
    assert got["noroot"] == good | {"no_dangling_parents": False, "has_root_step": False}
    assert got["mixed"] == {"has_trajectory_block": True, "shared_trajectory_id": False}
    assert got["missing"] == {"has_trajectory_block": False}


def test_empty(spark):
    assert checks(spark, []) == {}
