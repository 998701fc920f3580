"""Acting once per thread, in batch and on a stream, and the look back that it rests on."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tamarisk.operators.actions import pending_actions
from tamarisk.operators.asof import asof_join, last_before, one_per_key
from tamarisk.streaming import history as sh
from tamarisk.streaming import jobs
from tamarisk.streaming.actions import act_once
from tests.conftest import rows

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCORED = "message_id string, mailbox_id string, thread_id string, received_at timestamp, risk_level string, score int"
BOX = "message_id string, mailbox_id string, thread_id string, received_at timestamp, folder string"
LEVELS = ["Safe", "Suspicious", "Malicious"]


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def made(seed, n=400):
    """Threads that turn worse, are binned, taken back and binned again; one holds a third of the rows."""
    rnd = random.Random(seed)
    thread = lambda: "hot" if rnd.random() < 0.35 else rnd.choice([None, "t1", "t2", "t3", "t4"])
    when = lambda: rnd.randrange(0, 9000, 15)
    scored = [(f"q{i:03d}", rnd.choice("ab"), thread(), when(), rnd.choices(LEVELS, [3, 4, 2])[0], i) for i in range(n)]
    box = [(f"m{i:03d}", rnd.choice("ab"), thread(), when(), rnd.choice(["Inbox", "inbox", None, "SPAM", "trash", "sent"]))
           for i in range(n // 2)]
    return scored, box


def brute(scored, box):
    """{message: (level, worst before)} of the messages acted on, by a walk through time."""
    key = lambda b, t, m: (b, "t:" + t if t is not None else "m:" + m)
    events = [(-1 if w is None else w, 0, m, key(b, t, m), (f or "inbox").lower()) for m, b, t, w, f in box]
    events += [(10**9 if w is None else w, 1, m, key(b, t, m), level) for m, b, t, w, level, _ in scored]
    binned, worst, out = set(), {}, {}
    for _, turn, m, thread, what in sorted(events):
        if not turn:
            if what != "sent":
                (binned.add if what in ("spam", "trash") else binned.discard)(thread)
            continue
        if what != "Safe" and thread not in binned:
            out[m] = (what, worst.get(thread, "Safe"))
        worst[thread] = max(worst.get(thread, "Safe"), what, key=LEVELS.index)
        if what == "Malicious":
            binned.add(thread)
    return out


def frames(spark, scored, box):
    return (spark.createDataFrame([(m, b, t, at(w), lv, s) for m, b, t, w, lv, s in scored], SCORED),
            spark.createDataFrame([(m, b, t, at(w), f) for m, b, t, w, f in box], BOX))


def acted(df):
    out = {r.message_id: (r.risk_level, r.worst_before) for r in df.collect()}
    assert len(out) == df.count()
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_against_a_walk(spark, seed):
    scored, box = made(seed)
    df = pending_actions(*frames(spark, scored, box))
    want = brute(scored, box)
    assert acted(df) == want
    pairs = set(want.values())
    assert {("Malicious", "Suspicious"), ("Suspicious", "Malicious"), ("Suspicious", "Suspicious")} <= pairs
    assert all((r.move_to_trash, r.send_alert, r.send_notice) == (r.risk_level == "Malicious", True, r.risk_level == "Malicious")
               and r.score is not None for r in df.collect())


def test_untimed_and_empty(spark):
    scored = [("1", "b", "x", None, "Suspicious", 1), ("2", "b", "x", 5, "Malicious", 2), ("3", "b", None, None, "Malicious", 3),
              ("4", "b", None, None, "Malicious", 4), ("5", None, "y", 1, "Suspicious", 5), ("6", None, "y", 2, "Suspicious", 6)]
    box = [("m", "b", "x", None, "trash"), ("n", "b", "x", 3, "inbox")]
    assert acted(pending_actions(*frames(spark, scored, box))) == brute(scored, box)
    assert acted(pending_actions(*frames(spark, scored, []))) == brute(scored, [])
    assert acted(pending_actions(*frames(spark, [], box))) == {}


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    sh.use_state_store(spark)
    scored, box = made(7, 150)
    s, b = frames(spark, scored, box)
    for i in range(5):
        lo, hi = F.lit(at(i * 1800)), F.lit(at(i * 1800 + 1800))
        for df, name in ((s, "s"), (b, "b")):
            df.where((F.col("received_at") >= lo) & (F.col("received_at") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, schema: jobs.read_stream(spark, str(tmp_path / name), schema, 1)
    got = jobs.run_to_table(act_once(read("s", SCORED), read("b", BOX), "10 days"), "acts")
    assert acted(got) == brute(scored, box)
    names = ["message_id", "mailbox_id", "thread_id", "received_at", "risk_level", "send_notice"]
    assert rows(got.select(*names)) == rows(pending_actions(s, b).select(*names))


def test_a_resting_thread_starts_anew(spark, tmp_path):
    sh.use_state_store(spark)
    scored = [("1", "b", "x", 0, "Malicious", 1), ("2", "b", "other", 3000, "Suspicious", 1),
              ("3", "b", "other", 6000, "Safe", 1), ("4", "b", "x", 9000, "Suspicious", 1)]
    for row in scored:
        frames(spark, [row], [])[0].coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    frames(spark, [], [("m", "b", "z", 0, "inbox")])[1].coalesce(1).write.parquet(str(tmp_path / "b"))
    run = lambda keep: acted(jobs.run_to_table(act_once(
        jobs.read_stream(spark, str(tmp_path / "s"), SCORED, 1), jobs.read_stream(spark, str(tmp_path / "b"), BOX, 1),
        "1 minute", keep), "acts"))
    assert set(run(3600)) == {"1", "2", "4"}
    assert set(run(10**7)) == {"1", "2"}


def test_threads_share_a_slot_of_state(spark, tmp_path):
    """Many threads are one call of the processor; in one slot they stay apart, and each rests for itself."""
    sh.use_state_store(spark)
    scored, box = made(9, 150)
    scored += [("z1", None, "t1", 100, "Suspicious", 1), ("z2", None, "t1", 5000, "Malicious", 1), ("z3", None, "t1", 8000, "Suspicious", 1)]
    s, b = frames(spark, scored, box)
    for i in range(3):
        lo, hi = F.lit(at(i * 3000)), F.lit(at(i * 3000 + 3000))
        for df, name in ((s, "s"), (b, "b")):
            df.where((F.col("received_at") >= lo) & (F.col("received_at") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, schema: jobs.read_stream(spark, str(tmp_path / name), schema, 1)
    run = lambda **o: act_once(read("s", SCORED), read("b", BOX), "10 days", **o)
    assert acted(jobs.run_to_table(run(slots=1), "acts")) == brute(scored, box)
    query = run().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    stored = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    # a value, a timer and its second index for each slot, not for each thread
    few = run(slots=2).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "f")).trigger(availableNow=True).start()
    few.awaitTermination()
    held = [o["numRowsTotal"] for p in few.recentProgress for o in p["stateOperators"]]
    assert max(held) < max(stored) and max(held) <= 2 * 3


def test_threads_of_a_slot_rest_one_by_one(spark, tmp_path):
    sh.use_state_store(spark)
    safe = lambda name, minutes: [(name, "b", "z", minutes, "Safe", 1)]
    scored = [[("1", "b", "x", 0, "Malicious", 1), ("2", "b", "y", 100, "Malicious", 1)], safe("3", 130), safe("4", 131),
              [("5", "b", "x", 132, "Suspicious", 1), ("6", "b", "y", 132, "Suspicious", 1)], safe("7", 300), safe("8", 301),
              [("9", "b", "y", 302, "Suspicious", 1)]]
    for part in scored:
        frames(spark, part, [])[0].coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    frames(spark, [], [("m", "b", "w", 0, "inbox")])[1].coalesce(1).write.parquet(str(tmp_path / "b"))
    got = acted(jobs.run_to_table(act_once(
        jobs.read_stream(spark, str(tmp_path / "s"), SCORED, 1), jobs.read_stream(spark, str(tmp_path / "b"), BOX, 1),
        "1 minute", 7200, slots=1), "acts"))
    # x is over at 120 and starts anew; y, which has mail again at 132, only at 252
    assert got == {"1": ("Malicious", "Safe"), "2": ("Malicious", "Safe"), "5": ("Suspicious", "Safe"), "9": ("Suspicious", "Safe")}


def test_last_before_does_not_depend_on_slices(spark):
    rnd = random.Random(4)
    data = [(rnd.choice(["a", "a", "b", None]), at(rnd.randrange(5000)), i, rnd.choice([None, None, rnd.randrange(9)]),
             rnd.choice([None, "x", "y"])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, w timestamp, i int, v int, s string")
    want = {}
    for k, w, i, _, _ in data:
        before = sorted((r for r in data if r[0] == k and (r[1], r[2]) < (w, i)), key=lambda r: r[1:3])
        pick = lambda c: next((r[c] for r in reversed(before) if r[c] is not None), None)
        want[i] = (pick(3), pick(4))
    for seconds in (60, 86_400, 10**9):
        got = last_before(df, ["k"], ["w", "i"], ["v", "s"], seconds)
        assert got.columns == df.columns
        assert {r.i: (r.v, r.s) for r in got.collect()} == want


def test_asof_join(spark):
    left = spark.createDataFrame([("a", at(10), 1), ("a", at(5), 2), ("a", at(4), 3), ("b", at(9), 4), (None, at(9), 5), ("a", None, 6),
                                  ("a", at(5), 2)], "k string, t timestamp, id int")
    right = spark.createDataFrame([("a", at(5), 50), ("a", at(5), 51), ("a", at(9), None), ("a", at(20), 99), ("c", at(1), 1),
                                   ("b", None, 7)], "k string, t timestamp, v int")
    got = asof_join(left, right, ["k"], "t", "t", {"v": F.col("v")}, 60)
    want = [(1, 51), (2, 51), (2, 51), (3, None), (4, None), (5, None), (6, None)]
    assert sorted(((r.id, r.v) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_one_per_key(spark):
    df = spark.createDataFrame([("a", 1, at(1)), ("a", 9, at(2)), ("a", 9, at(2)), ("b", 3, None), ("b", 4, None)], "k string, v int, t timestamp")
    assert sorted((r.k, r.v) for r in one_per_key(df, ["k"], "t").collect()) == [("a", 9), ("b", 4)]
    assert sorted((r.k, r.v) for r in one_per_key(df.drop("t"), ["k"]).collect()) == [("a", 9), ("b", 4)]
