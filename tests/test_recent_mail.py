"""Latest threads of a sender by intervals: long histories, odd rows, and the plan."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tamarisk.operators import history as hist
from tamarisk.params import RiskParams
from tests.conftest import SF
from tests.test_joins import ASKED, BOX, brute, history_of
from workload import mail
from workload.queries_intel import _asked

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_many_threads_over_years(spark):
    """New threads every few hours and some that come back after years; ties in time."""
    rnd = random.Random(12)
    box, hours = [], 0
    for i in range(1500):
        hours += rnd.choice([0, 1, 1, 30, 200])
        thread = rnd.choice([f"t{i}", f"t{i}", f"old{rnd.randrange(20)}"])
        box.append(("b", thread, f"m{i:05d}", "s", "me", "inbox", T0 + dt.timedelta(hours=hours), f"subject {i}", None, 0))
    asked = [(f"q{i:03d}", "b", "s", rnd.choice([f"t{i * 10}", "old3"]), T0 + dt.timedelta(hours=rnd.randrange(hours + 500)))
             for i in range(120)]
    assert history_of(spark, box, asked, RiskParams()) == brute(box, asked)
    small = RiskParams(max_history_threads=7)
    assert history_of(spark, box, asked, small) == brute(box, asked, cap=7)
    # a moment meets few intervals, whatever the length of the history
    m, b = spark.createDataFrame(asked, ASKED), spark.createDataFrame(box, BOX)
    longest = hist.threads_before(m, b, RiskParams(max_history_threads=7)).agg(F.max(F.size("threads"))).head()[0]
    assert longest < 100


def test_odd_rows(spark):
    box = [("b", "t", "m1", "s", "me", "inbox", T0, "one", "x", 1), ("b", "t", "m1", "s", "me", "inbox", T0, "one", "x", 1),
           ("b", None, "m2", "s", "me", "inbox", T0, "two", None, None), ("b", "u", "m3", "s", "me", "inbox", None, "three", "x", 1),
           ("b", "v", "m4", None, "me", "inbox", T0, "four", "x", 1), ("c", "t", "m1", "s", "me", "inbox", T0, "other box", "x", 1)]
    later = T0 + dt.timedelta(days=40_000)
    asked = [("q1", "b", "s", "t", later), ("q1", "c", "s", None, later), ("q2", "b", "s", None, T0), ("q3", "b", "s", None, None),
             ("q4", "b", "", None, later), ("q5", None, "s", None, later), ("q1", "b", "s", "t", later)]
    m, b = spark.createDataFrame(asked, ASKED), spark.createDataFrame(box, BOX)
    got = hist.recent_mail(m, b).collect()
    assert {(r.mailbox_id, r.message_id): [x.subject for x in r.recent] for r in got} == {
        ("b", "q1"): ["two", "one"], ("c", "q1"): ["other box"]}
    assert len(got) == 2
    whole = hist.with_sender_history(m, b)
    assert whole.count() == len(asked)
    counts = {(r.mailbox_id, r.message_id): r.sender_history.total_threads for r in whole.collect()}
    # one id in two mailboxes has two histories
    assert (counts["b", "q1"], counts["c", "q1"], counts[None, "q5"]) == (1, 1, 0)
    assert hist.recent_mail(m.limit(0), b).count() == hist.recent_mail(m, b.limit(0)).count() == 0


def test_wide_mails_are_not_written_as_json(spark):
    """Which of a message's histories counts is settled on the counts, before the mails come to them."""
    m, box = _asked(mail.messages(spark, SF)), mail.mailbox(spark, SF)
    whole = hist.with_sender_history(m, box)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" in whole or "StructsToJson" in whole
    assert not any("json" in line.lower() and "recent" in line for line in whole.split("\n"))


def test_a_message_given_twice_with_two_moments(spark):
    """The greatest history by its JSON text counts, with the mails of both moments."""
    day = dt.timedelta(days=1)
    box = [("b", f"t{i}", f"m{i}", "s", "me", "inbox", T0 + i * day, f"subject {i}", None, 0) for i in range(3)]
    asked = [("q", "b", "s", "own", T0 + day / 2), ("q", "b", "s", "own", T0 + 9 * day)]
    got = hist.with_sender_history(spark.createDataFrame(asked, ASKED), spark.createDataFrame(box, BOX)).collect()
    assert [r.sender_history.total_threads for r in got] == [3, 3]
    assert {r.sender_history.oldest_thread_iso_date for r in got} == {"2024-01-01T00:00:00.000Z"}
    assert got[0].recent_emails_from_sender == got[1].recent_emails_from_sender


def test_plan_has_no_python_and_reads_bodies_for_excerpts_only(spark):
    m, box = _asked(mail.messages(spark, SF)), mail.mailbox(spark, SF)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    oldest, recent = plan(hist.oldest_threads(m, box)), plan(hist.recent_mail(m, box))
    for text in (oldest, recent):
        assert not any(w in text for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
    assert "props" not in oldest and "props" in recent
