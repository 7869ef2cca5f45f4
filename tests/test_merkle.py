import hashlib

import pytest
from pyspark.sql import functions as F

from veritrail.operators import merkle


def leaf(b):
    return hashlib.sha256(b"\0" + b).digest()


def tree(hs):
    if len(hs) == 1:
        return hs[0]
    k = 1
    while k * 2 < len(hs):
        k *= 2
    return hashlib.sha256(b"\1" + tree(hs[:k]) + tree(hs[k:])).digest()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 257])
def test_root_and_every_proof(spark, n):
    rows = spark.createDataFrame([(i, f"leaf-{i}".encode()) for i in range(n)], "leaf_index long, payload binary")
    nodes = merkle.nodes(rows)
    top = merkle.root(nodes).first()
    assert (top.tree_size, top.tree_root) == (n, tree([leaf(f"leaf-{i}".encode()) for i in range(n)]).hex())
    proofs = merkle.proofs(nodes, rows).join(rows, "leaf_index").withColumns({"leaf": merkle.leaf_hash(F.col("payload")), "size": F.lit(n), "root": F.lit(top.tree_root)})
    ok = merkle.proof_holds("leaf", "leaf_index", "proof", "size", "root")
    assert all(r[0] for r in proofs.select(ok).collect())
    for change in ({"leaf": merkle.leaf_hash(F.lit(bytearray(b"no")))}, {"leaf_index": F.col("leaf_index") + 1}, {"root": F.lit("00" * 32)}, {"proof": F.concat("proof", F.array(F.lit("00" * 32)))}):
        assert not any(r[0] for r in proofs.withColumns(change).select(ok).collect())


def test_empty_log(spark):
    rows = spark.createDataFrame([], "leaf_index long, payload binary")
    assert tuple(merkle.root(merkle.nodes(rows)).first()) == (0, hashlib.sha256(b"").hexdigest())


def test_dense_numbers(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    assert sorted((r.leaf_index, r.k) for r in merkle.numbered(df, ["k"]).collect()) == [(i, i) for i in range(1000)]
