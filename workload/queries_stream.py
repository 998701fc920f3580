"""Streaming queries; each runs over all available input and reads its output."""

from __future__ import annotations

import os
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import functions as F

from tamarisk.operators.features import HISTORY_FLAGS, INTEL_FLAGS, without_flags
from tamarisk.operators.scoring import score
from tamarisk.plans.verdicts import flagged_messages, offline_verdicts, verdicts
from tamarisk.streaming import history as sh
from tamarisk.streaming import jobs
from tamarisk.streaming.actions import act_once
from tamarisk.streaming.verdicts import full_rows, verdict_plan
from workload import duck, mail
from workload import duck_intel as di
from workload.queries_core import _OFFLINE
from workload.queries_intel import _INTEL_ONLY, _VERDICT, FULL, snapshots
from workload.registry import query

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENTS = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)


@contextmanager
def stream_settings(spark):
    """Settings of one run, put back afterwards.  On a local session state is
    kept in as many stores as there are cores; a cluster keeps its own number."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass"]
    old = {n: spark.conf.get(n) for n in names}
    if spark.sparkContext.master.startswith("local"):
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set(names[0], str(min(cores, int(old[names[0]]))))
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def with_stream_settings(run):
    @wraps(run)
    def inside(spark, sf):
        with stream_settings(spark):
            return run(spark, sf)

    return inside


def table_stream(spark, sf, name, schema):
    """The files of a table, which is one file or a folder of them.

    A plain path would have to be a folder; a pattern that fits this name alone may be either.
    """
    return jobs.read_stream(spark, os.path.join(sf, f"{name}.parque[t]"), schema)


def document_stream(spark, sf):
    return table_stream(spark, sf, "documents", DOCUMENTS)


def message_stream(spark, sf):
    return mail.messages_from(document_stream(spark, sf))


def _verdict_columns(df):
    return df.select(
        "message_id", "score", "risk_level", "threat_category", "action_taken",
        F.array_join("triggered_by", ";").alias("triggered_by"),
    )


@query("stream_verdicts_offline", _OFFLINE + _VERDICT)
@with_stream_settings
def stream_verdicts_offline(spark, sf):
    """Stateless scoring of a stream."""
    return jobs.run_to_table(_verdict_columns(offline_verdicts(message_stream(spark, sf))), "offline")


@query("stream_verdicts_intel", _INTEL_ONLY + _VERDICT)
@with_stream_settings
def stream_verdicts_intel(spark, sf):
    """The whole batch plan with reputation, per micro-batch."""
    known = snapshots(spark, sf)
    return jobs.run_batches_to_table(
        message_stream(spark, sf), lambda batch: _verdict_columns(verdicts(batch, known)), "intel", held=False
    )


def _history_stream(spark, sf):
    sh.use_state_store(spark)
    box = mail.mailbox_from(table_stream(spark, sf, "events", EVENTS))
    return sh.running_history(sh.history_events(box, message_stream(spark, sf)))


@query(
    "stream_sender_history",
    duck.with_mail(di.HISTORY, "tl AS (SELECT d, th, max(bt) AS last_at FROM hc WHERE folder = 'inbox' AND th <> own GROUP BY ALL)",
        "ot AS (SELECT d, strftime(min(last_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM"
        " (SELECT *, row_number() OVER (PARTITION BY d ORDER BY last_at DESC) AS rn FROM tl) WHERE rn <= 50 GROUP BY d)",
        "rc AS (SELECT d, least(5, count(DISTINCT th)) AS n FROM hc WHERE folder = 'inbox' GROUP BY d)")
    + "SELECT message_id, CAST(total_threads AS INT) AS total_threads, total_threads = 0 AS is_first_time_sender,"
    " has_user_replied, CAST(spam_count AS INT) AS spam_count, CAST(trash_count AS INT) AS trash_count,"
    " ot.iso AS oldest_thread_iso_date, CAST(coalesce(rc.n, 0) AS INT) AS n_recent"
    " FROM hs LEFT JOIN ot ON ot.d = hs.d LEFT JOIN rc ON rc.d = hs.d",
)
@with_stream_settings
def stream_sender_history(spark, sf):
    out = _history_stream(spark, sf).withColumn("n_recent", F.size("recent")).drop(
        "recent", "mailbox_id", "sender", "received_at"
    )
    return jobs.run_to_table(out, "history")


@query(
    "stream_act_once",
    _OFFLINE.rstrip() + ", " + di.ACTIONS
    + "SELECT mailbox_id, thread_id, message_id, risk_level, worst_before, risk_level = 'Malicious' AS move_to_trash FROM act",
)
@with_stream_settings
def stream_act_once(spark, sf):
    sh.use_state_store(spark)
    box = mail.mailbox_from(table_stream(spark, sf, "events", EVENTS))
    due = act_once(offline_verdicts(message_stream(spark, sf)), box)
    return jobs.run_to_table(due, "actions").drop("received_at", "send_alert", "send_notice")


_TIMELY_G = """
g AS (SELECT f.*, false AS is_first_time_sender, false AS has_user_replied_to_sender,
  false AS sender_has_spam_history, false AS domain_recently_registered,
  false AS recently_seen_attachment, 0 AS max_url_engines, 0 AS max_file_engines,
  0 AS abuse_confidence, 0 AS max_domain_engines, 0 AS max_ip_engines, 0 AS gsb_threats,
  0 AS feed_hits, CAST([] AS VARCHAR[]) AS proven, an.ok AND an.d % 3 < 2 AS ai_ok, an.ai_score,
  an.ai_category, 0.7 AS tc FROM f JOIN an ON an.d = f.d)"""


@query(
    "stream_timely_answers",
    duck.with_mail(duck.FEATURES, di.ANSWERS, _TIMELY_G, duck.SCORED) + _VERDICT,
)
@with_stream_settings
def stream_timely_answers(spark, sf):
    """Answers come 0, 10 or 20 seconds late; 15 seconds are waited for.

    A row in the far future closes either stream, else the last messages would
    wait for an answer for ever.
    """
    later = "CASE WHEN doc_id < 0 THEN TIMESTAMP '2100-01-01 00:00:00' ELSE received_at END"
    docs = document_stream(spark, sf)
    close = document_stream(spark, sf).filter("doc_id = 0")
    closed = docs.unionByName(close.withColumn("doc_id", F.lit(-1).cast("long")))
    m = mail.messages_from(closed).withColumn("received_at", F.expr(later.replace("doc_id", "d")))
    again = document_stream(spark, sf).unionByName(
        document_stream(spark, sf).filter("doc_id = 0").withColumn("doc_id", F.lit(-1).cast("long"))
    )
    answered = mail.messages_from(again).filter("d % 8 <> 7").selectExpr(
        "message_id", f"{mail.ANSWER_TEXT} AS raw_text",
        "CASE WHEN d < 0 THEN TIMESTAMP '2100-01-01 00:00:00' ELSE"
        " received_at + make_interval(0, 0, 0, 0, 0, 0, (d % 3) * 10) END AS answered_at",
    )
    rows = without_flags(flagged_messages(m), INTEL_FLAGS + HISTORY_FLAGS).drop(
        "prompt_body", "alert_snippet"
    )
    judged = score(jobs.with_timely_answers(rows, answered), intel=None)
    # filtered after the stream: before, the closing rows would not be seen
    return jobs.run_to_table(_verdict_columns(judged), "answers").filter("message_id <> '-1'")


@query("stream_verdicts_full", FULL + _VERDICT)
@with_stream_settings
def stream_verdicts_full(spark, sf):
    """History, answers and reputation of a stream; answers come 0, 5 or 10 seconds late.

    A message and an answer in the far future close the streams, else the last messages would
    wait for ever.
    """
    sh.use_state_store(spark)
    closing = "CASE WHEN d < 0 THEN TIMESTAMP '2100-01-01 00:00:00' ELSE received_at END"

    def closed():
        last = document_stream(spark, sf).filter("doc_id = 0").withColumn("doc_id", F.lit(-1).cast("long"))
        return mail.messages_from(document_stream(spark, sf).unionByName(last))

    m = closed().withColumn("received_at", F.expr(closing))
    answers = closed().filter("d % 8 <> 7").selectExpr(
        "mailbox_id", "message_id", f"{mail.ANSWER_TEXT} AS raw_text",
        f"{closing} + make_interval(0, 0, 0, 0, 0, 0, (abs(d) % 3) * 5) AS answered_at",
    )
    box = mail.mailbox_from(table_stream(spark, sf, "events", EVENTS))
    rows = full_rows(m, box, answers)
    plan = verdict_plan(lambda: snapshots(spark, sf))
    out = jobs.run_batches_to_table(rows, lambda batch: _verdict_columns(plan(batch)), "full")
    return out.filter("message_id <> '-1'")
