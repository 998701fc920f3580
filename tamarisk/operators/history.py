"""Sender history: what the mailbox knew of a sender when a message arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk import schemas
from tamarisk.functions.text import has_text, text_or_empty
from tamarisk.operators.asof import DAY, asof_join, one_per_key
from tamarisk.operators.keys import MESSAGE_KEY, join_on_message, message_key
from tamarisk.operators.lookup import lookup_join
from tamarisk.params import RiskParams

SENDER_KEY = ["mailbox_id", "sender"]


def iso_utc(ts: Column) -> Column:
    """``2024-01-31T08:15:00.000Z`` in UTC whatever the session zone is."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _place(folder: Column) -> Column:
    lowered = F.lower(text_or_empty(folder))
    return F.when(lowered.isin("spam", "trash", "sent"), lowered).otherwise("inbox")


def correspondence(mailbox: DataFrame) -> DataFrame:
    """Mailbox rows seen from the correspondent: sent mail belongs to its recipient."""
    place = _place(F.col("folder"))
    other = F.when(place == "sent", F.col("recipient")).otherwise(F.col("sender"))
    return mailbox.withColumns({"place": place, "sender": other})


# --- thread counts ---------------------------------------------------------


def thread_openings(mailbox: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Per (mailbox, sender): the earliest threads of each place.

    A count that stops at 50 and leaves out one thread needs the 51 earliest
    threads and nothing else, so a sender's history shrinks to four short
    arrays that answer "how many before t" for every t.  The first step
    combines before its shuffle, and the rank filter cuts every map task's rows
    to 51 per sender before the second.
    """
    keep = params.max_history_threads + 1
    first = (
        correspondence(mailbox)
        .groupBy(*SENDER_KEY, "place", "thread_id")
        .agg(F.min("received_at").alias("first_at"))
    )
    by_time = Window.partitionBy(*SENDER_KEY, "place").orderBy("first_at", "thread_id")
    early = first.withColumn("_rank", F.row_number().over(by_time)).filter(F.col("_rank") <= keep)
    pick = lambda place: F.collect_list(
        F.when(F.col("place") == place, F.struct("first_at", "thread_id"))
    ).alias(place)
    return early.groupBy(*SENDER_KEY).agg(
        *[pick(p) for p in ("inbox", "spam", "trash")],
        F.min(F.when(F.col("place") == "sent", F.col("first_at"))).alias("replied_at"),
    )


def thread_counts(
    messages: DataFrame, mailbox: DataFrame, params: RiskParams = RiskParams()
) -> DataFrame:
    """``mailbox_id, message_id`` with thread counts and flags as of ``received_at``.

    ``messages``: ``message_id, mailbox_id, sender, thread_id, received_at``.
    """
    keyed = messages.select("message_id", *SENDER_KEY, "thread_id", "received_at")
    joined = lookup_join(keyed, thread_openings(mailbox, params), SENDER_KEY, ["message_id"], params)
    cap = params.max_history_threads

    def before(place: str) -> Column:
        earlier = F.filter(
            F.coalesce(place, F.array().cast("array<struct<first_at:timestamp,thread_id:string>>")),
            lambda t: (t["first_at"] < F.col("received_at"))
            & ~t["thread_id"].eqNullSafe(F.col("thread_id")),
        )
        return F.least(F.lit(cap), F.size(earlier))

    total = before("inbox")
    if params.include_current_thread:
        total = F.least(F.lit(cap), total + 1)
    known = has_text(F.col("sender"))
    none = F.lit(0)
    return joined.select(
        "mailbox_id", "message_id",
        F.when(known, total).otherwise(none).alias("total_threads"),
        (known & (total == 0)).alias("is_first_time_sender"),
        (known & F.coalesce(F.col("replied_at") < F.col("received_at"), F.lit(False))).alias(
            "has_user_replied"
        ),
        F.when(known, before("spam")).otherwise(none).alias("spam_count"),
        F.when(known, before("trash")).otherwise(none).alias("trash_count"),
        known.alias("available"),
    )


# --- recent mail and oldest thread -----------------------------------------
#
# A mail is the latest of its thread from its arrival to the thread's next mail.  So what a
# sender's latest threads are at a moment is a question of which of these intervals hold the
# moment: a join on time bins, of ids alone.  An interval also ends once more threads than can
# matter have newer mail, so a moment meets few of them however long a history is.

_HOUR = 3_600_000_000
_FACTOR = 8
_LEVELS = 8
_EVER = 253_402_300_799_000_000  # the last second of the year 9999


def _bin(micros: Column, level: int) -> Column:
    return F.floor(micros / F.lit(_HOUR * _FACTOR**level)).cast("long")


def _received(mailbox: DataFrame) -> DataFrame:
    """Received mail outside spam and trash, ids only."""
    return (
        correspondence(mailbox)
        .filter((F.col("place") == "inbox") & F.col("sender").isNotNull() & F.col("received_at").isNotNull())
        .select(*SENDER_KEY, "thread_id", F.unix_micros("received_at").alias("at"), F.col("message_id").alias("mail_id"))
    )


def _asked(messages: DataFrame) -> DataFrame:
    return messages.filter(has_text(F.col("sender")) & F.col("received_at").isNotNull()).select(
        *SENDER_KEY, F.col("thread_id").alias("asked_thread"), "message_id",
        F.unix_micros("received_at").alias("asked_at"),
    ).distinct()


def _crowded_bins(mails: DataFrame, cap: int) -> DataFrame:
    """Time bins in which a sender has mail of more than ``cap`` threads: ``start, crowded_by``.

    ``crowded_by`` is the first end of a crowded bin that starts no earlier.
    """
    levels = F.array(*[
        F.struct(F.lit(k).alias("level"), _bin(F.col("at"), k).alias("bin")) for k in range(_LEVELS)
    ])
    threads = mails.select(*SENDER_KEY, "thread_id", F.inline(levels)).distinct()
    width = F.lit(_HOUR) * F.pow(F.lit(_FACTOR), "level").cast("long")
    bins = (
        threads.groupBy(*SENDER_KEY, "level", "bin").agg(F.count("*").alias("n")).filter(F.col("n") > cap)
        .select(*SENDER_KEY, (F.col("bin") * width).alias("start"), ((F.col("bin") + 1) * width).alias("end"))
    )
    # bins of one start are peers, so each knows the ends of all
    onward = Window.partitionBy(*SENDER_KEY).orderBy(F.col("start").desc())
    return bins.select(*SENDER_KEY, "start", F.min("end").over(onward).alias("crowded_by"))


def _backwards(micros: Column) -> Column:
    return F.timestamp_micros(-micros)


def latest_intervals(mailbox: DataFrame, asked: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """``mailbox_id, sender, thread_id, at, mail_id, until``: when a mail is the latest of its thread
    and not behind more than ``max_history_threads`` others; senders nobody asks about are left out."""
    mails = _received(mailbox).join(asked.select(*SENDER_KEY).distinct(), SENDER_KEY, "left_semi")
    # of mails of one moment all but the last end where they begin
    later = Window.partitionBy(*SENDER_KEY, "thread_id").orderBy("at", "mail_id")
    ended = mails.withColumn("until", F.coalesce(F.lead("at").over(later), F.lit(_EVER))).filter("at < until")
    crowded = _crowded_bins(mails, params.max_history_threads)
    # the next crowded bin after a mail is the last one before it when time runs backwards
    left = ended.withColumn("_when", _backwards(F.col("at") + 1))
    right = crowded.withColumn("_when", _backwards(F.col("start")))
    cut = asof_join(left, right, SENDER_KEY, "_when", "_when", {"crowded_by": F.col("crowded_by")}, 64 * DAY)
    return cut.select(
        *SENDER_KEY, "thread_id", "at", "mail_id", F.least("until", F.coalesce("crowded_by", F.lit(_EVER))).alias("until")
    )


def _level_of(length: Column) -> Column:
    """The finest level at which an interval touches few bins."""
    level = F.lit(_LEVELS - 1)
    for k in reversed(range(_LEVELS - 1)):
        level = F.when(length <= F.lit(_HOUR * _FACTOR ** (k + 1)), k).otherwise(level)
    return level


def threads_before(messages: DataFrame, mailbox: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """``mailbox_id, message_id, thread_id, threads``: per asking message the latest threads of its sender
    before it, newest first, as ``(at, mail_id, thread_id)``; messages with none are left out.

    The list holds at least the ``max_history_threads + 1`` latest threads, or all.
    """
    asked = _asked(messages)
    mails = latest_intervals(mailbox, asked, params).withColumn("level", _level_of(F.col("until") - F.col("at")))
    width = F.lit(_HOUR) * F.pow(F.lit(_FACTOR), "level").cast("long")
    bins = F.sequence(F.floor(F.col("at") / width).cast("long"), F.floor(F.col("until") / width).cast("long"))
    held = mails.withColumn("bin", F.explode(bins))
    levels = F.array(*[
        F.struct(F.lit(k).alias("level"), _bin(F.col("asked_at"), k).alias("bin")) for k in range(_LEVELS)
    ])
    probes = asked.select("*", F.inline(levels))
    met = probes.join(held, [*SENDER_KEY, "level", "bin"]).filter("at < asked_at AND asked_at <= until")
    return met.groupBy("mailbox_id", "message_id", "asked_thread", "asked_at").agg(
        F.sort_array(F.collect_list(F.struct("at", "mail_id", "thread_id")), asc=False).alias("threads")
    ).select("mailbox_id", "message_id", F.col("asked_thread").alias("thread_id"), "threads")


def oldest_threads(messages: DataFrame, mailbox: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """``mailbox_id, message_id, oldest_thread_at``: the last mail of the oldest of the latest
    threads besides the message's own."""
    return _with_oldest(threads_before(messages, mailbox, params), params).drop("threads")


def _with_oldest(found: DataFrame, params: RiskParams) -> DataFrame:
    others = params.max_history_threads - (1 if params.include_current_thread else 0)
    kept = F.slice(
        F.filter("threads", lambda t: ~t["thread_id"].eqNullSafe(F.col("thread_id"))), 1, others
    )
    oldest = F.timestamp_micros(F.try_element_at(kept, F.lit(-1))["at"])
    return found.select("mailbox_id", "message_id", "threads", oldest.alias("oldest_thread_at"))


def _excerpts(mailbox: DataFrame) -> DataFrame:
    """What is shown of a mail, by its key."""
    snippet = F.substring(text_or_empty(F.col("body")), 1, fv.RECENT_BODY_CHARS)
    urls = F.regexp_extract_all(snippet, F.lit(fv.CLIENT_URL_PATTERN), F.lit(0))
    return mailbox.select(
        "mailbox_id", F.col("message_id").alias("mail_id"), F.unix_micros("received_at").alias("at"),
        F.struct(
            "subject", snippet.alias("body_snippet"), iso_utc(F.col("received_at")).alias("received_iso_date"),
            (F.coalesce("n_attachments", F.lit(0)) > 0).alias("has_attachments"),
            F.size(F.array_distinct(urls)).alias("url_count"),
        ).cast(schemas.RECENT_EMAIL).alias("mail"),
    )


def recent_mail(
    messages: DataFrame, mailbox: DataFrame, params: RiskParams = RiskParams()
) -> DataFrame:
    """``mailbox_id, message_id, oldest_thread_at, recent`` as of each message's arrival.

    Ids are joined first; only the few mails that are shown are joined to their bodies.
    Messages of senders without earlier mail are left out.
    """
    found = _with_oldest(threads_before(messages, mailbox, params), params)
    first = F.slice("threads", 1, fv.MAX_RECENT_EMAILS)
    shown = found.select("mailbox_id", "message_id", "oldest_thread_at", F.posexplode(first).alias("pos", "t")).select(
        "mailbox_id", "message_id", "oldest_thread_at", "pos", "t.at", "t.mail_id"
    )
    bodies = shown.join(_excerpts(mailbox), ["mailbox_id", "mail_id", "at"])
    listed = bodies.groupBy("mailbox_id", "message_id").agg(
        F.max("oldest_thread_at").alias("oldest_thread_at"),
        F.sort_array(F.collect_set(F.struct("pos", "mail"))).alias("r"),
    )
    # a mail that the mailbox holds twice is shown once
    once = F.filter("r", lambda x, i: (i == 0) | (F.get(F.col("r"), i - 1)["pos"] != x["pos"]))
    return listed.select("mailbox_id", "message_id", "oldest_thread_at", F.transform(once, lambda x: x["mail"]).alias("recent"))


# --- compositions ----------------------------------------------------------


def with_sender_history(
    rows: DataFrame,
    mailbox: DataFrame,
    params: RiskParams = RiskParams(),
    recent: bool = True,
    messages: DataFrame | None = None,
) -> DataFrame:
    """Add ``sender_history`` and, with ``recent``, ``recent_emails_from_sender``.

    Scoring needs the counts only; leave ``recent`` off for it and the whole
    history stays in built-in functions.  Give the plain ``messages`` where
    ``rows`` is a longer plan.
    """
    messages = rows if messages is None else messages
    counts = thread_counts(messages, mailbox, params)
    history = F.struct(
        *[
            (F.lit(None) if n == "oldest_thread_iso_date" else F.col(n)).alias(n)
            for n in schemas.fields_of(schemas.SENDER_HISTORY)
        ]
    ).cast(schemas.SENDER_HISTORY)
    # a message that is given twice has one history; settled before the wide mails come to it
    mine = one_per_key(counts.select(*MESSAGE_KEY, history.alias("sender_history")), MESSAGE_KEY)
    if recent:
        nothing = F.array().cast(f"array<{schemas.RECENT_EMAIL}>")
        oldest = iso_utc(F.col("oldest_thread_at"))
        mine = join_on_message(mine, recent_mail(messages, mailbox, params)).select(
            *MESSAGE_KEY,
            F.col("sender_history").withField("oldest_thread_iso_date", oldest).alias("sender_history"),
            F.coalesce("recent", nothing).alias("recent_emails_from_sender"),
        )
    stale = [c for c in ("sender_history", "recent_emails_from_sender") if c in mine.columns]
    named = message_key(rows, mine)
    return join_on_message(rows.drop(*stale), mine if named == MESSAGE_KEY else one_per_key(mine, named))


def latest_per_thread(mailbox: DataFrame, except_ids: DataFrame | None = None) -> DataFrame:
    """Latest message of every (mailbox, sender, thread), some messages left out."""
    rows = mailbox
    if except_ids is not None:
        rows = join_on_message(rows, except_ids, "left_anti")
    order = F.struct("received_at", "message_id")
    kept = [c for c in mailbox.columns if c not in (*SENDER_KEY, "thread_id")]
    return (
        rows.groupBy(*SENDER_KEY, "thread_id")
        .agg(F.max_by(F.struct(*kept), order).alias("m"))
        .select(*SENDER_KEY, "thread_id", "m.*")
    )


def replied_senders(mailbox: DataFrame) -> DataFrame:
    """The (mailbox, sender) pairs the owner has written to."""
    sent = correspondence(mailbox).filter(F.col("place") == "sent")
    return sent.select(*SENDER_KEY).distinct()


def from_replied_senders(mailbox: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Received mail of the senders the owner has written to at any time.

    A semi join; written as a lookup so that a sender with very many mails is
    spread over tasks.
    """
    received = mailbox.filter(_place(F.col("folder")) != "sent")
    known = replied_senders(mailbox).withColumn("_replied", F.lit(True))
    return (
        lookup_join(received, known, SENDER_KEY, ["message_id"], params)
        .filter("_replied")
        .drop("_replied")
    )
