"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import dropped, written


def _mark(links: DataFrame) -> tuple:
    """Count and order-free checksum of the links, to see that a round changed nothing."""
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> ``(node, component)``; component is the least node reachable.

    Nodes without a link to another node are left out. Every round is two
    aggregations and two joins on the node, whose skew AQE splits; no neighbour list is
    collected, so a hub of any degree is only a long run of rows. The number of
    rounds grows with the logarithm of the longest path. An empty table gives none.
    """
    at = written(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(at)
    while mark[0]:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _mark(after)
        dropped(at)
        at = after
        if now == mark:
            break
        mark = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("component"))
