"""The last value before a row, per key, without a theta join.

Rows of a key are cut into time slices.  Inside a slice a window looks back; what a slice
does not know comes from the last slice that does, one row per (key, slice).  So a key that
holds a large part of all rows is spread over its slices, and no task sees more of it than
one slice and one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def last_before(
    rows: DataFrame, keys: list[str], order: list[str], values: list[str], slice_seconds: int = DAY
) -> DataFrame:
    """``rows`` with every column of ``values`` replaced by its last non-null value in the
    rows of the same key that come strictly before.

    ``order``: a timestamp column, then columns that settle ties.  Null keys are a key of
    their own.  ``rows`` is read twice; of the second reading only keys, order and values
    are kept, so give a plan that is cheap to repeat or a written table.
    """
    at = order[0]
    part = F.floor(F.unix_micros(at) / F.lit(slice_seconds * 1_000_000)).cast("long")
    sliced = rows.withColumn("_slice", part)
    moment = F.struct(*order)
    # the last of each slice: a count that combines before its shuffle
    ends = sliced.groupBy(*keys, "_slice").agg(
        *[F.max_by(F.struct(v), F.when(F.col(v).isNotNull(), moment)).alias(f"_{v}") for v in values]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_at"),
        *[F.last(f"_{v}", ignorenulls=True).over(earlier).alias(f"_{v}") for v in values],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = sliced.withColumns({f"_near_{v}": F.last(v, ignorenulls=True).over(inside) for v in values})
    same = F.col("_slice") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    kept = [F.col(c) for c in rows.columns if c not in values]
    return near.join(carried, same, "left").select(
        *kept, *[F.coalesce(F.col(f"_near_{v}"), F.col(f"_{v}")[v]).alias(v) for v in values]
    )


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str,
    sides: dict[str, Column], slice_seconds: int = DAY,
) -> DataFrame:
    """Every row of ``left`` with, per name in ``sides``, the last non-null value of that column
    of ``right`` at or before ``left_at`` (null where there is none).

    Of several values at one moment the greatest by its JSON text is taken, so the result
    does not depend on the order of rows.  Left rows without a time match nothing.
    """
    names = list(sides)
    plain = [c for c in left.columns if c not in keys]
    asked = left.select(
        *keys, F.col(left_at).alias("_when"), F.lit(1).alias("_turn"), F.lit("").alias("_tie"),
        F.struct(*plain).alias("_row"),
    )
    known = right.select(
        *keys, F.col(right_at).alias("_when"), F.lit(0).alias("_turn"),
        F.to_json(F.struct(*[c.alias(n) for n, c in sides.items()])).alias("_tie"),
        *[c.alias(n) for n, c in sides.items()],
    ).where(F.col("_when").isNotNull())
    both = asked.unionByName(known, allowMissingColumns=True)
    found = last_before(both, keys, ["_when", "_turn", "_tie"], names, slice_seconds)
    return found.where(F.col("_turn") == 1).select(
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in left.columns], *names
    )


def one_per_key(rows: DataFrame, keys: list[str], at: str | None = None) -> DataFrame:
    """One row per key: the latest by ``at``, of equal or undated ones the greatest by JSON text."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    rank = [F.col(at)] if at else []
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), F.struct(*rank, F.to_json(F.struct(*others)))).alias("_row"))
        .select(*keys, "_row.*")
        .select(*rows.columns)
    )
