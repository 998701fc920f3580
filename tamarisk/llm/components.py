"""Connected components of a link table, as joins and grouped minima.

Large-star and small-star steps alternate until the links no longer change; each
step is one grouped minimum (combined before the shuffle) and one join.  Every
round is written to the shared folder, so no round depends on what an executor
held, and nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.operators.lineage import written


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def _star(both: DataFrame, links: DataFrame, large: bool) -> DataFrame:
    """One star step: ``both`` holds (node, other); the node's smallest neighbour takes over."""
    least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    moved = both.join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"), "node")
    if large:
        moved = moved.where("a > node").select("a", "b")
    else:
        own = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        moved = moved.select("a", "b").unionByName(own)
    return moved.where("a <> b").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Links may repeat, run either way or join a node with itself; null ends are left
    out.  An empty table gives an empty result.
    """
    ends = links.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x <> y")
    now = written(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other"))
        both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
        big = _star(both, now, large=True)
        small = _star(big.select(F.col("a").alias("node"), F.col("b").alias("other")), big, large=False)
        now = written(small, "links")
        before, state = state, _state(now)
        if before == state:
            break
    ones = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ones.unionByName(heads)
