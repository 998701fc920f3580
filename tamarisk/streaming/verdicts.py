"""The full verdict on a stream: history, then answers, then reputation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk import schemas
from tamarisk.operators.intel import Snapshots
from tamarisk.params import RiskParams
from tamarisk.plans.verdicts import flagged_messages, judged
from tamarisk.streaming.history import history_events, running_history
from tamarisk.streaming.jobs import ANSWER_BOUND, with_timely_answers


def with_running_history(
    rows: DataFrame, messages: DataFrame, mailbox: DataFrame, delay: str, params: RiskParams = RiskParams()
) -> DataFrame:
    """Add ``sender_history`` to a stream of messages, from a stream of the mailbox's rows.

    Keyed state per (mailbox, sender) gives the history of each message; a stream-stream join on
    message and arrival brings it back to the rows, which do not pass through the state.
    """
    known = running_history(history_events(mailbox, messages), params, delay)
    names = schemas.fields_of(schemas.SENDER_HISTORY)
    history = F.struct(
        *[(F.lit(True) if n == "available" else F.col(n)).alias(n) for n in names]
    ).cast(schemas.SENDER_HISTORY)
    right = known.select(
        F.col("mailbox_id").alias("_box"), F.col("message_id").alias("_message"), F.col("received_at").alias("_at"),
        history.alias("sender_history"),
    )
    same = (F.col("mailbox_id") == F.col("_box")) & (F.col("message_id") == F.col("_message")) & (F.col("received_at") == F.col("_at"))
    left = rows.drop("sender_history").withWatermark("received_at", delay)
    return left.join(right, same, "leftOuter").drop("_box", "_message", "_at")


def full_rows(
    messages: DataFrame, mailbox: DataFrame, raw_answers: DataFrame, bound: str = ANSWER_BOUND,
    delay: str = "1 minute", params: RiskParams = RiskParams(),
) -> DataFrame:
    """Flagged messages with ``sender_history`` and ``analysis``, all from streams.

    Stateful steps in a chain under one watermark: history by sender, the join back to the
    message, the answer that came within ``bound``.  A message goes on once its answer is
    there or the watermark has passed the time it may take.
    """
    rows = with_running_history(flagged_messages(messages, params), messages, mailbox, delay, params)
    return with_timely_answers(rows, raw_answers, bound, delay)


def verdict_plan(
    snapshots: Callable[[], Snapshots], params: RiskParams = RiskParams()
) -> Callable[[DataFrame], DataFrame]:
    """The batch plan for ``write_batches`` over ``full_rows``.

    ``snapshots`` is asked anew for every micro-batch, so a verdict sees the version of the
    reputation tables that is there when it is made.
    """
    return lambda batch: judged(batch, snapshots(), params)
