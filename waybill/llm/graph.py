"""Connected components by alternating large-star and small-star steps on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v; the result has the same form."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = both.join(least, "u")
    if large:
        new = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) but each component's smallest.

    Rounds end when the edge table stands still; each has one row a node at most after the first.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if row[0] == 0 or tuple(row) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(row)
        before, now = now, cut(_star(_star(now, large=True), large=False))
        drop_cut(before)
