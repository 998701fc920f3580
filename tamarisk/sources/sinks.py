"""Output tables: verdicts, layer scores, signals, alerts, notices, actions, prompts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.asof import one_per_key
from tamarisk.operators.keys import message_key
from tamarisk.operators.lineage import written

VERDICT_COLUMNS = [
    "mailbox_id", "message_id", "received_at", "score", "risk_level", "alert", "threshold",
    "threat_category", "reasons", "signals", "actions", "user_explanation",
    "layer_scores", "evidence", "quarantine_action",
]


def verdict_rows(scored: DataFrame, *extra: str) -> DataFrame:
    """One record per message."""
    return scored.select(*[c for c in VERDICT_COLUMNS if c in scored.columns], *extra)


def layer_score_rows(scored: DataFrame) -> DataFrame:
    """One row per message and layer."""
    return scored.select(
        "message_id", F.posexplode("layer_scores").alias("pos", "layer")
    ).select("message_id", "pos", "layer.*")


def signal_rows(scored: DataFrame) -> DataFrame:
    """One row per message and raised signal."""
    return scored.select("message_id", F.posexplode("signals").alias("pos", "signal")).select(
        "message_id", "pos", "signal.*"
    )


def write_by_day(df: DataFrame, path: str, time_column: str = "received_at", mode: str = "overwrite") -> None:
    """Parquet partitioned by the day of ``time_column``; overwriting replaces the days of ``df`` alone.

    The rows are rebalanced on the day before the write, so a day gives a few
    large files rather than one per task, and a heavy day is split.
    """
    dated = df.withColumn("day", F.to_date(time_column)).hint("rebalance", "day")
    if mode == "overwrite" and _stored(df.sparkSession, path) is None:
        # where no table stands nothing is replaced, and a day is moved once, not twice
        mode = "append"
    dated.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_by_day(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_by_day``.

    Its folders are listed by a few tasks for each core, not by one task for each day.
    """
    old = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(old), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(_LISTING, old)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table there, None where there is none."""
    try:
        return read_by_day(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _on_days(days: list[date | None]) -> Column:
    """True for a ``day`` of the list: days that follow each other are one range, so the
    condition, by which a scan is cut to its partitions, stays short."""
    known = sorted(d for d in days if d is not None)
    starts = [d for i, d in enumerate(known) if not i or d - known[i - 1] > timedelta(days=1)]
    ends = [d for i, d in enumerate(known) if i + 1 == len(known) or known[i + 1] - d > timedelta(days=1)]
    ranges = [f"day BETWEEN DATE'{a}' AND DATE'{b}'" for a, b in zip(starts, ends, strict=True)]
    return F.expr(" OR ".join(ranges + ["day IS NULL"] * (None in days)))


def merge_by_day(
    df: DataFrame, path: str, time_column: str = "received_at", scored_column: str | None = None
) -> None:
    """Put the rows of ``df`` into a table of ``write_by_day``: those of known messages replace the
    old ones, those of new messages are added, all other rows stay.

    Only the days that ``df`` holds are read and rewritten, in one commit; a failure before it
    leaves the table as it was.  A message keeps its day, since ``time_column`` says when it was
    received.  Of several rows of a message the latest by ``scored_column`` counts, without
    that column the greatest by JSON text.  Columns that either side lacks are null there.
    """
    spark = df.sparkSession
    dated = df.withColumn("day", F.to_date(time_column))
    # rows and days are needed apart from each other, and the rows come from a long plan
    new = written(one_per_key(dated, message_key(dated), scored_column), "merge")
    days = [r.day for r in new.select("day").distinct().collect()]
    if not days:
        return
    table = _stored(spark, path)
    merged = new
    if table is not None:
        key = message_key(table, new)
        replaced = new.select(*[F.col(k).alias(f"_new_{k}") for k in key], F.col("day").alias("_new_day"))
        same = F.col("day").eqNullSafe(F.col("_new_day"))
        for k in key:
            same = same & F.col(k).eqNullSafe(F.col(f"_new_{k}"))
        merged = table.filter(_on_days(days)).join(replaced, same, "left_anti").unionByName(new, allowMissingColumns=True)
    merged.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "day"
    ).parquet(path)


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Plain parquet, JSON lines or ORC."""
    df.write.mode(mode).format(fmt).save(path)
