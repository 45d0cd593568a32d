"""Connected components by alternating large and small stars.

The smallest neighbours are a table of their own in every step, so that the join with all
neighbours has two plain shuffles and Spark can split the one that holds a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node gives its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node gives its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    low = saved(down.groupBy("a").agg(F.min("b").alias("m")))
    rest = down.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b``: every node that is not the smallest of its component, and that smallest node.

    ``edges`` has columns a and b of one comparable type.  Each round halves the depth at
    least; a round is a table in the shared folder, and only two numbers reach the driver.
    """
    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()

    current, before = saved(_small_star(edges.filter("a <> b"))), None
    now = mark(current)
    while now != before:
        before = now
        current = saved(_small_star(_large_star(current)))
        now = mark(current)
    return current
