"""Streams of messages, mail and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.answers import parse_answers, unavailable
from tamarisk.operators.keys import MESSAGE_KEY, message_key
from tamarisk.operators.lineage import new_folder

ANSWER_BOUND = "15 seconds"
#: files of a micro-batch, if nothing else is asked for
FILES_PER_TRIGGER = 256


def read_stream(
    spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = FILES_PER_TRIGGER,
    glob: str | None = None, fmt: str = "parquet",
) -> DataFrame:
    """File stream with a declared schema; ``files_per_trigger`` bounds a batch (None: no bound)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append to parquet; ``once`` takes what is there and stops."""
    writer = df.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Run the stream over all available input and read its output back."""
    folder = new_folder(df.sparkSession, name)
    write_stream(df, f"{folder}/out", f"{folder}/state").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def write_batches(
    stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True,
    held: bool = True,
):
    """Run a batch plan on every micro-batch.

    Each batch writes its own ``batch=<id>`` folder and overwrites it when it is
    repeated after a failure, so every message gets one verdict.

    A plan may read its batch several times, and each time keyed state would be loaded and
    written anew, two readings at once even waiting for each other's store until Spark gives
    up.  So a batch is ``held``: its rows are written beside the checkpoint, where the next
    batch overwrites them, and the plan reads those.  A stream without state need not be.
    """
    rows = f"{checkpoint.rstrip('/')}-rows"

    def step(batch: DataFrame, batch_id: int) -> None:
        if held:
            batch.write.mode("overwrite").parquet(rows)
            batch = stream.sparkSession.read.schema(batch.schema).parquet(rows)
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_batches_to_table(
    stream: DataFrame, plan: Callable[[DataFrame], DataFrame], name: str, held: bool = True
) -> DataFrame:
    """Run a batch plan over all available input and read its output back."""
    spark, folder, ran = stream.sparkSession, new_folder(stream.sparkSession, name), []

    def noted(batch: DataFrame) -> DataFrame:
        ran.append(True)
        return plan(batch)

    write_batches(stream, noted, f"{folder}/out", f"{folder}/state", held=held).awaitTermination()
    if not ran:  # a stream without a file has no batch, its result is an empty table
        plan(spark.createDataFrame([], stream.schema)).write.parquet(f"{folder}/out/batch=0")
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _timed(rows: DataFrame) -> list[str]:
    """Columns that carry event time already."""
    return [f.name for f in rows.schema if f.metadata.get("spark.watermarkDelayMs") is not None]


def with_timely_answers(
    messages: DataFrame, raw_answers: DataFrame, bound: str = ANSWER_BOUND, delay: str = "1 minute"
) -> DataFrame:
    """Add ``analysis`` from a stream of answers.

    ``raw_answers``: key of the message, ``raw_text, answered_at``.  An answer counts if
    it is the first and comes within ``bound`` after the message; a message that gets none is
    released with the unavailable record once the watermark has passed.
    """
    right = raw_answers.withWatermark("answered_at", delay)
    key = message_key(messages, raw_answers)
    # the first answer counts, what comes again is not waited for
    first = right.dropDuplicatesWithinWatermark(key)
    parsed = parse_answers(first, "answered_at").withColumnsRenamed({k: f"_{k}" for k in key})
    left = messages if "received_at" in _timed(messages) else messages.withWatermark("received_at", delay)
    timely = F.expr(
        " AND ".join(f"{k} = _{k}" for k in key)
        + f" AND answered_at >= received_at AND answered_at <= received_at + INTERVAL {bound}"
    )
    joined = left.join(parsed, timely, "leftOuter").drop(*[f"_{k}" for k in MESSAGE_KEY], "answered_at")
    return joined.withColumn("analysis", F.coalesce("analysis", unavailable()))
