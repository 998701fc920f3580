"""Rows whose key may hold a large part of all: joins with statistics of the key, bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key is hot when it holds more than one row in HOT_SHARE, so there are fewer hot keys than that
HOT_SHARE = 500


def join_statistics(rows: DataFrame, stats: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` (each with a non-null key found in ``stats``) with the columns of ``stats``.

    ``stats`` has one row per key and the key's number of rows in ``count``; ``total`` is
    the number of rows.  Hot keys, fewer than HOT_SHARE by their definition, are
    broadcast; all other rows are joined by shuffle.  ``rows`` is read twice.
    """
    least = total // HOT_SHARE
    hot = F.broadcast(stats.where(F.col(count) > least))
    cold = stats.where(F.col(count) <= least)
    few = rows.join(hot, key)
    many = rows.join(F.broadcast(stats.where(F.col(count) > least).select(key)), key, "left_anti")
    return few.unionByName(many.join(cold.hint("merge"), key))


_PARTS, _LEVELS = 1024, 6


def hash_sample(rows: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by the hash of the columns; all of them where they are not more.

    Rows are counted per part of the hash (at most _PARTS counts reach the driver) and parts
    are taken in order as long as they fit; where none fits, the smallest is divided
    again.  So no task hands on more than its share of the sample, and it depends on the rows
    alone, not on their layout.  Equal rows stand in one part and are taken together; where
    even those of the smallest part are too many, one of each is taken.  ``rows`` is read
    once more for each count.
    """
    taken, hashed = F.lit(True), F.xxhash64(*columns)
    for level in range(_LEVELS):
        part = F.pmod(F.shiftrightunsigned(hashed, 10 * level), F.lit(_PARTS))
        counts = {r["part"]: r["n"] for r in rows.where(taken).groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        if sum(counts.values()) <= limit:
            return rows.where(taken)
        chosen, used = [], 0
        for name in sorted(counts):
            if used + counts[name] <= limit:
                chosen.append(name)
                used += counts[name]
        if chosen:
            return rows.where(taken & part.isin(chosen))
        taken = taken & (part == min(counts, key=lambda name: (counts[name], name)))
    return rows.where(taken).distinct()
