"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import drop_table
from webquarry.session import durable


def _least(links: DataFrame, keep_smaller: bool) -> DataFrame:
    """Tie neighbours of every node to the least node among it and them."""
    if keep_smaller:
        seen = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        seen = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = seen.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    moved = seen.join(least, "u")
    if keep_smaller:
        ties = moved.select(F.col("v").alias("a"), F.col("low").alias("b")).union(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
    else:
        ties = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
    return ties.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of links ``a, b`` that is not the least of its component.

    Alternating large-star and small-star rounds: each ties nodes to the least
    node around, until every node hangs on the least of its component.  A round
    reads and writes tables on shared storage; the driver sees two numbers.
    """
    current = durable(links.where("a <> b").distinct())
    before = None
    while True:
        large = _least(current, keep_smaller=False)
        after = durable(_least(large, keep_smaller=True))
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_table(current)
        current = after
        if tuple(state) == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(state)
