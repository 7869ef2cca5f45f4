"""An RFC 6962 Merkle log as a table of nodes.

Leaves get a dense number without passing through one task: rows are range
partitioned and sorted, each partition is counted, and a partition's rows are
numbered from the sum of the counts before it. Nodes of a level pair up by idx
div 2; an odd last node moves up unchanged.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.runtime import materialize

#: Levels of the tree made by one pass.
BLOCK_LEVELS = 8


def numbered(df: DataFrame, order: list[str], name: str = "leaf_index") -> DataFrame:
    """Dense numbers from 0 in the order of ``order``, which must be total."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    sorted_rows = materialize(sorted_rows.withColumn("_mono", F.monotonically_increasing_id()), "numbered")
    counts = {r["_part"]: r["count"] for r in sorted_rows.groupBy("_part").count().collect()}  # one row a partition
    base, starts = 0, []
    for part in sorted(counts):
        starts.append((part, base))
        base += counts[part]
    spark = df.sparkSession
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part int, _base long")
    return sorted_rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_base") + F.col("_mono").bitwiseAND((1 << 33) - 1)).drop("_part", "_mono", "_base")


def leaf_hash(payload: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(bytearray(b"\x00")), payload), 256))


def nodes(leaves: DataFrame) -> DataFrame:
    """All nodes (level, idx, hash) above and of ``leaves`` (leaf_index, payload binary).

    A pass gathers blocks of 2**BLOCK_LEVELS neighbours and makes all levels
    inside each block at once, so a log of n leaves takes log2(n) / BLOCK_LEVELS
    shuffles; a block has a fixed size, so nothing large is gathered.
    """
    level = materialize(leaves.select(F.lit(0).alias("level"), F.col("leaf_index").cast("long").alias("idx"), leaf_hash(F.col("payload")).alias("hash")), "merkle")
    out, base = level, 0
    height = max(0, level.count() - 1).bit_length()
    while base < height:
        h = min(BLOCK_LEVELS, height - base)
        blocks = level.groupBy(F.shiftright("idx", h).alias("b")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("x")).select("b", F.transform("x", lambda e: e["hash"]).alias("l0"))
        for j in range(1, h + 1):
            pair = f"unhex(sha2(concat(x'01', get(l{j - 1}, 2 * i), get(l{j - 1}, 2 * i + 1)), 256))"
            blocks = blocks.withColumn(f"l{j}", F.expr(f"transform(sequence(0, cast((size(l{j - 1}) - 1) div 2 AS int)), i -> IF(2 * i + 1 < size(l{j - 1}), {pair}, get(l{j - 1}, 2 * i)))"))
        made = blocks.select("b", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"l{j}").alias("hs")) for j in range(1, h + 1)])).alias("x")).select("b", "x.j", F.posexplode("x.hs").alias("at", "hash"))
        new = materialize(made.select((F.col("j") + base).alias("level"), F.expr(f"shiftleft(b, {h} - j) + at").alias("idx"), "hash"), "merkle")
        out = out.unionByName(new)
        base += h
        level = new.filter(F.col("level") == base)
    return out


def grown(entries: DataFrame, start: int, end: int, peaks: dict[int, bytes]) -> list[DataFrame]:
    """The nodes that become complete when a log grows from ``start`` to ``end`` entries, as written tables.

    ``entries`` has leaf_index (from ``start``) and payload; ``peaks`` are the roots of the full subtrees of the
    log before, by level. A new node's children are new nodes or the peak of their level, which is the last node
    there if the count is odd. As in :func:`nodes`, a pass makes BLOCK_LEVELS levels inside blocks of a fixed size.
    """
    level = materialize(entries.select(F.lit(0).alias("level"), F.col("leaf_index").cast("long").alias("idx"), leaf_hash(F.col("payload")).alias("hash")), "grown")
    out, base = [level], 0
    while end >> (base + 1) > start >> (base + 1):
        h = BLOCK_LEVELS
        first = start >> (base + h)
        blocks = level.groupBy(F.shiftright("idx", h).alias("b")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("x")).select("b", F.transform("x", lambda e: e["hash"]).alias("l0"))
        places = {}
        for j in range(1, h + 1):
            below = f"l{j - 1}"
            if (start >> (base + j - 1)) & 1:
                below = f"IF(b = {first}, concat(array(x'{peaks[base + j - 1].hex()}'), {below}), {below})"
            pair = "unhex(sha2(concat(x'01', get(l, 2 * i), get(l, 2 * i + 1)), 256))"
            pairs = f"IF(size(l) > 1, transform(sequence(0, cast(size(l) div 2 AS int) - 1), i -> {pair}), array())"
            blocks = blocks.withColumn(f"l{j}", F.expr(f"transform(array({below}), l -> {pairs})[0]"))
            places[j] = F.when(F.col("b") == first, F.lit(start >> (base + j))).otherwise(F.shiftleft("b", h - j))
        levels = F.array(*[F.struct(F.lit(j).alias("j"), places[j].alias("at0"), F.col(f"l{j}").alias("hs")) for j in range(1, h + 1)])
        made = blocks.select(F.explode(levels).alias("x")).select("x.j", "x.at0", F.posexplode("x.hs").alias("at", "hash"))
        new = materialize(made.select((F.col("j") + base).cast("int").alias("level"), (F.col("at0") + F.col("at")).cast("long").alias("idx"), "hash"), "grown")
        out.append(new)
        base += h
        level = new.filter(F.col("level") == base)
    return out


def _above(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def right_edge(size: int, peaks: dict[int, bytes]) -> list[tuple[int, int, bytes]]:
    """The last node (level, idx, hash) of each level whose subtree is not full, from the peaks; at most one a level."""
    out, last, level = [], None, 0
    while size > 1 and (size - 1) >> level:
        # the last node of this level is the one made in the round before, or the peak where the level ends even
        if last is not None:
            last = _above(peaks[level], last) if size >> level & 1 else last
        elif size >> level & 1:
            last = peaks[level]
        level += 1
        if last is not None:
            out.append((level, (size - 1) >> level, last))
    return out


def peaks_root(size: int, peaks: dict[int, bytes]) -> bytes:
    """Root of a log from its peaks; the empty log has the hash of nothing."""
    if size == 0:
        return hashlib.sha256(b"").digest()
    edge = right_edge(size, peaks)
    return edge[-1][2] if edge else peaks[size.bit_length() - 1]


def root(tree: DataFrame) -> DataFrame:
    """tree_size and tree_root (hex); the empty log has the hash of nothing."""
    top = tree.agg(F.max_by("hash", "level").alias("h"), F.count_if(F.col("level") == 0).alias("tree_size"))
    return top.select("tree_size", F.coalesce(F.lower(F.hex("h")), F.sha2(F.lit("").cast("binary"), 256)).alias("tree_root"))


def proofs(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Inclusion proof (array of hex, from the leaf up) of each leaf_index in ``wanted``.

    Paths are made a band of BLOCK_LEVELS levels at a time, from the top down. A
    band's nodes are gathered in blocks of a fixed size, one of which holds all
    siblings on a path through the band; so a leaf meets one row per band, and
    the path above a block is found once for all leaves below it.
    """
    height = tree.agg(F.max("level")).first()[0] or 0
    leaves = wanted.select("leaf_index").distinct()
    above = None
    for base in reversed(range(0, height, BLOCK_LEVELS)):
        h = min(BLOCK_LEVELS, height - base)
        band = tree.filter((F.col("level") >= base) & (F.col("level") < base + h)).withColumn("_j", F.col("level") - base)
        lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("_j") == j, F.struct("idx", F.lower(F.hex("hash")).alias("h"))))), lambda x: x["h"]).alias(f"_l{j}") for j in range(h)]
        blocks = band.groupBy(F.expr(f"shiftright(idx, {h} - _j)").alias("_b")).agg(*lists)
        at = leaves.select(F.expr(f"shiftright(leaf_index, {base})").alias("_w")).distinct().withColumn("_b", F.expr(f"shiftright(_w, {h})"))
        own = "array_compact(array(%s))" % ", ".join(f"get(_l{j}, cast((shiftright(_w, {j}) ^ 1) - shiftleft(_b, {h - j}) AS int))" for j in range(h))
        found = at.join(blocks, "_b").select("_w", "_b", F.expr(own).alias("_p"))
        if above is not None:
            found = found.join(above.select(F.col("_w").alias("_b"), F.col("proof").alias("_up")), "_b").withColumn("_p", F.concat("_p", "_up"))
        above = found.select("_w", F.col("_p").alias("proof"))
    if above is None:
        return leaves.withColumn("proof", F.array().cast("array<string>"))
    return above.withColumnRenamed("_w", "leaf_index")


def proof_holds(leaf: str, index: str, proof: str, size: str, expected: str) -> Column:
    """Whether a proof leads from a leaf hash (binary) to the expected root (hex): the check of RFC 6962, folded over the proof."""
    fold = (
        f"aggregate({proof}, struct(cast({index} AS bigint) AS fn, cast({size} AS bigint) - 1 AS sn, {leaf} AS r, true AS ok), (s, p) -> "
        "CASE WHEN s.sn = 0 THEN struct(s.fn AS fn, s.sn AS sn, s.r AS r, false AS ok) "
        "WHEN s.fn % 2 = 1 OR s.fn = s.sn THEN struct("
        # a right child takes its sibling from the left; then both numbers go up to where it is a right child no longer
        "shiftright(s.fn, 1 + cast(bit_count((s.fn & -s.fn) - 1) AS int)) AS fn, "
        "shiftright(s.sn, 1 + cast(bit_count((s.fn & -s.fn) - 1) AS int)) AS sn, "
        "unhex(sha2(concat(x'01', unhex(p), s.r), 256)) AS r, s.ok AS ok) "
        "ELSE struct(shiftright(s.fn, 1) AS fn, shiftright(s.sn, 1) AS sn, unhex(sha2(concat(x'01', s.r, unhex(p)), 256)) AS r, s.ok AS ok) END)"
    )
    done = f"({fold})"
    return F.expr(f"coalesce({index} >= 0 AND {index} < {size} AND {done}.ok AND {done}.sn = 0 AND lower(hex({done}.r)) = {expected}, false)")


def latest_leaf(leaves: DataFrame) -> DataFrame:
    """Last leaf_index of each fingerprint."""
    return leaves.groupBy("fingerprint").agg(F.max("leaf_index").alias("leaf_index"))


def per_key_numbers(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 within each key, for groups such as the chunks of one request."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
