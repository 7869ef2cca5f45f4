"""Connected components of a table of links by alternating stars, with nothing collected.

Every round replaces links so that nodes hang on smaller nodes: the large star
hangs a node's larger neighbours on its least neighbour, the small star its
smaller ones. Least neighbours come from a partial aggregate and a join, so a
node with very many links is not gathered in one task. Rounds end when the
links no longer change; then each node hangs on the least of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import release
from veritrail.runtime import discard, materialize


def _hung(pairs: DataFrame) -> DataFrame:
    """Join each (u, v) with m, the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("m", "u"))


def components(links: DataFrame) -> DataFrame:
    """Node and component (its least node) of all nodes of ``links`` (u, v) that have a link to another."""
    spark = links.sparkSession
    links = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hung(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = _hung(large)
        small = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = materialize(small, "links")
        after = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(links)
        links = new
        release(spark)
        if after == before:
            return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
