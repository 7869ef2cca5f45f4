import duckdb
import pytest

from veritrail.llm import queries

DATA = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in cur.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    rows = pipeline.run(spark, DATA).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert 0.5 * len(docs) < len(rows) <= len(docs) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    assert [k for k, _ in pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "decontamination", "encode"]
