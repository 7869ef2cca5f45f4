"""Every registered engine query against its SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from veritrail.plans import audits, catalog, graphs, stores, streams, trends  # noqa: F401

DATA = os.environ.get("VERITRAIL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_entry_registers_what_is_there():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_graph_checks_cover_every_trajectory(spark):
    every = {r.trajectory_id for r in catalog._steps(spark, DATA).select("trajectory_id").distinct().collect()}
    rows = catalog.QUERIES["dag_checks_all_steps"](spark, DATA).collect()
    assert {r.trajectory_id for r in rows} == every
    assert {(r.check, r.ok) for r in rows} >= {(c, x) for c in ("no_dangling_parents", "has_root_step") for x in (True, False)}
