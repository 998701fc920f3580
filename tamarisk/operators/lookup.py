"""Left join of many rows with a keyed snapshot, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.text import any_true
from tamarisk.params import RiskParams


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the frame; None where it cannot be read."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def fits_broadcast(df: DataFrame) -> bool:
    """True when the planner itself would broadcast the frame."""
    size = estimated_bytes(df)
    if size is None:
        return False
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= size <= limit


def hot_keys(df: DataFrame, keys: list[str], params: RiskParams) -> DataFrame:
    """The keys with very many rows, at most ``hot_key_limit`` of them.

    Counting combines before the shuffle, so a hot key costs one row per task.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= params.hot_key_rows)
        .orderBy(F.col("_n").desc(), *keys)
        .limit(params.hot_key_limit)
        .select(*keys, F.lit(True).alias("_hot"))
    )


def lookup_join(
    left: DataFrame,
    snapshot: DataFrame,
    keys: list[str],
    spread_by: list[str | Column],
    params: RiskParams = RiskParams(),
) -> DataFrame:
    """``left LEFT JOIN snapshot USING (keys)``; every left row is kept.

    * A snapshot small enough for the planner's broadcast limit (its size is
      checked) joins without moving the left side at all.
    * A larger one is joined by a shuffle in which the rows of each hot key are
      spread over ``hot_key_slots`` tasks by the hash of ``spread_by``, and only
      the snapshot rows of hot keys are repeated that often.  Rows with a null
      key are spread too.  The list of hot keys is bounded by ``hot_key_limit``, so it is always safe to broadcast.

    The result does not depend on which way is taken.  On a stream the static
    snapshot is joined plainly, since rows per trigger are bounded already.
    """
    if left.isStreaming or fits_broadcast(snapshot):
        return left.join(snapshot, keys, "left")
    hot = F.broadcast(hot_keys(left, keys, params))
    slots = params.hot_key_slots
    slot_of = F.pmod(F.xxhash64(*spread_by), F.lit(slots)).cast("int")
    # a null key meets nothing, so its rows may go to any task
    blank = any_true(F.col(k).isNull() for k in keys)
    spread = left.join(hot, keys, "left").withColumn(
        "_slot", F.when(F.col("_hot") | blank, slot_of).otherwise(0)
    )
    repeated = snapshot.join(hot, keys, "left").select(
        *snapshot.columns,
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(slots - 1))).otherwise(
                F.array(F.lit(0))
            )
        ).alias("_slot"),
    )
    return spread.join(repeated, keys + ["_slot"], "left").drop("_slot", "_hot")
