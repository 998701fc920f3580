"""Mailbox actions and notices that follow from a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.operators.asof import last_before
from tamarisk.operators.lineage import written

#: places that a thread is taken to and, but for sent mail, back from
QUARANTINE = ("spam", "trash")
THREAD = ["mailbox_id", "thread"]


def routed_actions(scored: DataFrame) -> DataFrame:
    """What to do with a message, by its level alone.

    Safe: nothing; Suspicious: alert; Malicious: trash, alert and notice.
    """
    level = F.col("risk_level")
    malicious = level == "Malicious"
    return scored.withColumns(
        {
            "move_to_trash": malicious,
            "send_alert": level != "Safe",
            "send_notice": malicious,
        }
    )


def thread_of(rows: DataFrame) -> Column:
    """The thread a row belongs to; mail without one is a thread of its own."""
    alone = F.concat(F.lit("m:"), F.coalesce(_held(rows, "message_id", "string"), F.lit("")))
    return F.when(rows["thread_id"].isNull(), alone).otherwise(F.concat(F.lit("t:"), rows["thread_id"]))


def _held(rows: DataFrame, name: str, kind: str) -> Column:
    return rows[name] if name in rows.columns else F.lit(None).cast(kind)


def _last() -> Column:
    return F.lit("9999-01-01").cast("timestamp")


def message_events(scored: DataFrame, untimed: Column | None = None) -> list[Column]:
    """``mailbox_id, thread, at, turn, tie, quarantined, suspicious, malicious`` of scored messages.

    A malicious message takes its thread to trash; the others leave it where it is.
    Messages without a time come at ``untimed``, by default last.
    """
    level = F.col("risk_level")
    return [
        F.col("mailbox_id"), thread_of(scored).alias("thread"),
        F.coalesce(_held(scored, "received_at", "timestamp"), _last() if untimed is None else untimed).alias("at"),
        F.lit(1).alias("turn"), F.coalesce("message_id", F.lit("")).alias("tie"),
        F.when(level == "Malicious", F.lit(True)).alias("quarantined"),
        F.when(level == "Suspicious", F.lit(True)).alias("suspicious"),
        F.when(level == "Malicious", F.lit(True)).alias("malicious"),
    ]


def mailbox_events(mailbox: DataFrame, untimed: Column | None = None) -> DataFrame:
    """``mailbox_id, thread, at, turn, tie, quarantined``: where the mailbox had a thread, and since when.

    Sent mail says nothing about it.  What the mailbox says of a moment (turn 0) counts
    before mail of that moment (turn 1); rows without a time come at ``untimed``, by default
    at the beginning.
    """
    begin = F.timestamp_seconds(F.lit(0)) if untimed is None else untimed
    folder = F.lower(F.coalesce("folder", F.lit("inbox")))
    return mailbox.where(folder != "sent").select(
        "mailbox_id", thread_of(mailbox).alias("thread"),
        F.coalesce(_held(mailbox, "received_at", "timestamp"), begin).alias("at"),
        F.lit(0).alias("turn"), F.coalesce(_held(mailbox, "message_id", "string"), F.lit("")).alias("tie"),
        folder.isin(*QUARANTINE).alias("quarantined"),
    )


def pending_actions(scored: DataFrame, mailbox: DataFrame) -> DataFrame:
    """Actions to take, with the thread's state moving as they are taken.

    Every message that is not Safe is acted on, unless its thread stands in spam or trash at
    that moment: because the mailbox had it there last, or because an earlier Malicious
    message of the thread sent it there and the mailbox did not take it back since.
    ``scored``: a verdict with ``mailbox_id, thread_id, message_id, received_at, risk_level``;
    ``mailbox``: ``mailbox_id, thread_id, message_id, folder, received_at``.  Adds the actions
    and ``worst_before``, the worst level of the thread's earlier messages.

    Only a malicious message changes a thread's place, and it does so whatever the place was,
    so the state before a message is the last change before it: a look back, no fold.
    """
    due = scored.select(F.struct(*scored.columns).alias("row"), *message_events(scored))
    # the verdicts are a long plan and what follows reads the events twice
    events = written(due, "thread-events").unionByName(mailbox_events(mailbox), allowMissingColumns=True)
    state = last_before(events, THREAD, ["at", "turn", "tie"], ["quarantined", "suspicious", "malicious"])
    worst = F.when(F.col("malicious"), "Malicious").when(F.col("suspicious"), "Suspicious").otherwise("Safe")
    open_ = state.where((F.col("turn") == 1) & ~F.coalesce("quarantined", F.lit(False)))
    return routed_actions(open_.select("row.*", worst.alias("worst_before"))).where(F.col("risk_level") != "Safe")
