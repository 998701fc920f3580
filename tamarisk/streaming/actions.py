"""Acting once per thread on a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tamarisk.operators.actions import THREAD, mailbox_events, message_events, routed_actions

_STATE = "mailbox array<string>, thread array<string>, quarantined array<boolean>, worst array<int>, last_at array<bigint>"
_LEVELS = ("Safe", "Suspicious", "Malicious")
_RESULT = "message_id string, at bigint, risk_level string, worst_before string"
_EVENT = [*THREAD, "micros", "turn", "tie", "place", "level"]
#: groups that threads are dealt to by their hash
SLOTS = 4096


class ThreadActions(StatefulProcessor):
    """State of the threads of one slot: whether each stands in spam or trash, its worst level so far.

    A call of the processor and of its state costs far more than a row does, so it is made for a slot
    of threads and not for each.  A thread is dropped when ``keep_seconds`` of event time have
    passed since its last event; before that, one that is as a new one would be is dropped once no row
    earlier than its last can come.
    """

    def __init__(self, keep_seconds: int):
        self.keep_ms = keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("threads", _STATE)

    def _threads(self) -> dict:
        """(mailbox, thread): (stands in spam or trash, worst level, last event)."""
        if not self.state.exists():
            return {}
        mailbox, thread, *held = self.state.get()
        return dict(zip(zip(mailbox, thread), zip(*held)))

    def _keep(self, threads: dict) -> None:
        """Store the threads, with a timer at the time the first of them is over."""
        if not threads:
            self.state.clear()
            return
        mailbox, thread = zip(*threads)
        quarantined, worst, last_at = zip(*threads.values())
        self.state.update((list(mailbox), list(thread), list(quarantined), list(worst), list(last_at)))
        self.handle.registerTimer(self._over(min(last_at)))

    def _over(self, last_at: int) -> int:
        return last_at // 1000 + self.keep_ms

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        threads, events = self._threads(), []
        for frame in rows:
            events.extend(zip(*(frame[name].tolist() for name in _EVENT)))
        events.sort(key=lambda e: e[2:])
        out = []
        for mailbox, thread, at, turn, message, place, level in events:
            quarantined, worst, last_at = threads.get((mailbox, thread), (False, 0, 0))
            if turn:
                if level > 0 and not quarantined:
                    out.append((mailbox, thread, message, at, _LEVELS[level], _LEVELS[worst]))
                worst = max(worst, level)
            if place >= 0:
                quarantined = place > 0
            threads[mailbox, thread] = (quarantined, worst, max(last_at, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        settled = timerValues.getCurrentWatermarkInMs()
        self._keep({k: t for k, t in threads.items() if t[0] or t[1] or t[2] // 1000 >= settled})
        yield pd.DataFrame(out, columns=[*THREAD, "message_id", "at", "risk_level", "worst_before"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        # all that are over by now, as if each had a timer of its own
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self._keep({k: t for k, t in self._threads().items() if self._over(t[2]) > now})
        return iter(())

    def close(self) -> None:
        pass


def act_once(
    scored: DataFrame, mailbox: DataFrame, delay: str = "1 hour", keep_seconds: int = 90 * 86_400, slots: int = SLOTS
) -> DataFrame:
    """Actions of a stream of verdicts, with a stream of the mailbox's rows as what moves threads.

    The streaming form of ``pending_actions``: every message that is not Safe is acted on unless
    its thread stands in spam or trash at that moment.  Equal to it for input that arrives in
    order; within a micro-batch rows are taken in time order.  Rows more than ``delay`` behind
    the latest one are left out, rows without a time count as of now, and a thread that rests
    for ``keep_seconds`` starts anew.  Only what places an event enters the shuffle; join the
    rest of a verdict to the result by message.  Threads are dealt to ``slots`` groups of keyed state; a
    batch reads and writes the groups it has rows of.  More threads than some thousands a group call for
    more of them, and the number holds for the life of a checkpoint.  The session must use the RocksDB state store.
    """
    now = F.current_timestamp()
    level = F.when(F.col("malicious"), 2).when(F.col("suspicious"), 1).otherwise(0)
    mail = scored.select(*message_events(scored, now)).withColumn("level", level).drop("suspicious", "malicious")
    events = mail.unionByName(mailbox_events(mailbox, now).withColumn("level", F.lit(0)))
    narrow = events.withWatermark("at", delay).select(
        F.pmod(F.xxhash64(*THREAD), F.lit(slots)).alias("slot"), *THREAD, "at", F.unix_micros("at").alias("micros"), "turn", "tie", "level",
        F.coalesce(F.col("quarantined").cast("int"), F.lit(-1)).alias("place"),
    )
    out = narrow.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=ThreadActions(keep_seconds), outputStructType=f"mailbox_id string, thread string, {_RESULT}",
        outputMode="Append", timeMode="EventTime",
    )
    thread_id = F.when(F.col("thread").startswith("t:"), F.substr("thread", F.lit(3)))
    return routed_actions(
        out.select(
            "mailbox_id", thread_id.alias("thread_id"), "message_id", F.timestamp_micros("at").alias("received_at"),
            "risk_level", "worst_before",
        )
    )
