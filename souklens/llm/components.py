"""Connected components of a link table, as joins and groupings of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.storage import materialise


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` links to ``(node, component)``: the smallest node that can be reached.

    Alternates the large-star and small-star steps. Each is a partial minimum per node and a join
    back, so a node with very many links is combined before the shuffle and its join can be split.
    Every round is written to shared storage; the rounds end when the links no longer change.
    Self links and nulls are left out; nodes without a link are not returned.
    """
    links = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
    mark = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").filter("v > u").select(F.col("low").alias("u"), "v").filter("u < v").distinct()
        # now each link is (smaller u, larger v); a node's smaller neighbours are under its v
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").select("u", "v", "low")
        small = small.filter("low < u").select(F.col("low").alias("u"), F.col("u").alias("v")).unionAll(low.select(F.col("low").alias("u"), "v"))
        links = materialise(small.filter("u < v").distinct())
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return links.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node").unionAll(
        links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]
