"""Sender history kept as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tamarisk import fixed_values as fv
from tamarisk.functions.text import has_text, text_or_empty
from tamarisk.operators.history import correspondence, iso_utc
from tamarisk.operators.recent_threads import RecentThreads
from tamarisk.params import RiskParams

_SEEN = "inbox array<string>, spam array<string>, trash array<string>, replied boolean"
_RECENT = (
    "thread_id string, at bigint, subject string, body_snippet string,"
    "has_attachments boolean, url_count int"
)
_MAIL = ["subject", "body_snippet", "has_attachments", "url_count"]
RESULT = (
    "mailbox_id string, sender string, message_id string, received_at timestamp, total_threads int, is_first_time_sender boolean,"
    "has_user_replied boolean, spam_count int, trash_count int, oldest_at bigint,"
    "recent array<struct<at:bigint,subject:string,body_snippet:string,"
    "has_attachments:boolean,url_count:int>>"
)
PLACES = ("inbox", "spam", "trash")
_RESULT_NAMES = [
    "mailbox_id", "sender", "message_id", "received_at", "total_threads", "is_first_time_sender",
    "has_user_replied", "spam_count", "trash_count", "oldest_at", "recent",
]
_COLUMNS = ["place", "thread_id", "message_id", "at", "is_mail", *_MAIL]


class SenderHistory(StatefulProcessor):
    """State of one (mailbox, sender): 51 first threads per place, whether the
    owner has replied, and the 51 most recent threads.  It never grows further."""

    def __init__(self, params: RiskParams):
        self.cap = params.max_history_threads
        self.with_current = params.include_current_thread

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _SEEN)
        self.recent = handle.getListState("recent", _RECENT)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        cap = self.cap
        seen = self.seen.get() if self.seen.exists() else None
        threads = {p: list(seen[i] or []) if seen else [] for i, p in enumerate(PLACES)}
        replied = bool(seen[3]) if seen else False
        stored = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        recent = RecentThreads(cap + 1, ((r[0], (r[1], r[1:])) for r in stored))
        # frames are reduced as they come: of sent mail the first moment is kept, of other mail the
        # first of each thread and place; whole rows only of received mail and of what asks
        firsts: dict = {}
        events, replied_at = [], None
        for frame in rows:
            for place, thread, message, at, is_mail, *mail in frame[_COLUMNS].itertuples(index=False, name=None):
                if not is_mail:
                    events.append((at, 0, message, thread, None))
                elif place == "sent":
                    replied_at = at if replied_at is None else min(replied_at, at)
                else:
                    first = (at, message)
                    if firsts.get((place, thread), (at + 1,)) > first:
                        firsts[place, thread] = first
                    if place == "inbox":
                        events.append((at, 1, message, thread, (int(at), *mail)))
        events += [(at, 1, message, thread, place) for (place, thread), (at, message) in firsts.items()]
        events.sort(key=lambda e: e[:3])
        out = []
        for at, is_mail, message, thread, what in events:
            if is_mail:
                if not isinstance(what, str):
                    recent.note(thread, int(at), what)
                elif len(threads[what]) <= cap and thread not in threads[what]:
                    threads[what].append(thread)
                continue
            others = {p: min(cap, sum(t != thread for t in threads[p])) for p in PLACES}
            total = min(cap, others["inbox"] + 1) if self.with_current else others["inbox"]
            mails = [dict(zip(["at", *_MAIL], m)) for m in recent.recent(fv.MAX_RECENT_EMAILS)]
            oldest = recent.oldest_of(cap - (1 if self.with_current else 0), thread)
            answered = replied or (replied_at is not None and replied_at < at)
            out.append((*key, message, pd.Timestamp(at, unit="us", tz="UTC"), total, total == 0, answered,
                        others["spam"], others["trash"], oldest, mails))
        self.seen.update((threads["inbox"], threads["spam"], threads["trash"], replied or replied_at is not None))
        kept = [
            (t, int(m[0]), m[1], m[2], bool(m[3]), int(m[4])) for t, (_at, m) in recent.threads.items()
        ]
        if kept:
            self.recent.put(kept)
        done = pd.DataFrame(out, columns=_RESULT_NAMES)
        done["oldest_at"] = done["oldest_at"].astype("Int64")
        yield done

    def close(self) -> None:
        pass


def history_events(mailbox: DataFrame, messages: DataFrame) -> DataFrame:
    """One stream of mail and of messages that ask for their sender's history."""
    snippet = F.substring(text_or_empty(F.col("body")), 1, fv.RECENT_BODY_CHARS)
    urls = F.regexp_extract_all(snippet, F.lit(fv.CLIENT_URL_PATTERN), F.lit(0))
    mail = correspondence(mailbox).select(
        "mailbox_id", "sender", "place", "thread_id", "message_id",
        F.unix_micros("received_at").alias("at"), F.lit(True).alias("is_mail"), "subject",
        snippet.alias("body_snippet"),
        (F.coalesce("n_attachments", F.lit(0)) > 0).alias("has_attachments"),
        F.size(F.array_distinct(urls)).alias("url_count"),
    )
    nothing = F.lit(None)
    asked = messages.filter(has_text(F.col("sender"))).select(
        "mailbox_id", "sender", F.lit("inbox").alias("place"), "thread_id", "message_id",
        F.unix_micros("received_at").alias("at"), F.lit(False).alias("is_mail"),
        nothing.cast("string").alias("subject"), nothing.cast("string").alias("body_snippet"),
        F.lit(False).alias("has_attachments"), F.lit(0).alias("url_count"),
    )
    return mail.filter(F.col("sender").isNotNull()).unionByName(asked)


def running_history(
    events: DataFrame, params: RiskParams = RiskParams(), delay: str | None = None
) -> DataFrame:
    """History of every asking message as of its place in the stream.

    Within a micro-batch rows are taken in time order; for input that arrives in
    order the result equals the batch one.  With ``delay`` the rows carry event time
    (``received_at``) on, so that joins may follow, and rows later than it are left out.
    The session must use the RocksDB state store (``use_state_store``).
    """
    timed = delay is not None
    if timed:
        events = events.withColumn("received_at", F.timestamp_micros("at")).withWatermark("received_at", delay)
    out = events.groupBy("mailbox_id", "sender").transformWithStateInPandas(
        statefulProcessor=SenderHistory(params),
        outputStructType=RESULT,
        outputMode="Append",
        timeMode="EventTime" if timed else "None",
        eventTimeColumnName="received_at" if timed else "",
    )
    return out.withColumn(
        "oldest_thread_iso_date", iso_utc(F.timestamp_micros("oldest_at"))
    ).drop("oldest_at")


def use_state_store(spark) -> None:
    """Switch the session to the state store that keyed state needs."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
