"""Physical layout of inputs for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tamarisk.functions.redact import redact
from tamarisk.operators.lookup import estimated_bytes


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out over all cores.

    A small table often sits in one file that one task would scan alone.  The
    number of splits is judged by the planner's size estimate, nothing is run.
    Inputs whose splits can keep a quarter of the cores busy pass unchanged, so
    no text is shuffled where there is much of it.
    """
    size = None if df.isStreaming else estimated_bytes(df)
    if size is None:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    splits = -(-size // split)
    return df.repartition(cores * 2) if splits * 4 <= cores else df


def redact_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Redact the named text columns of a table."""
    return spread(df).withColumns({c: redact(df[c]) for c in columns})
