"""One id in several mailboxes, inputs given twice, and records of several times."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from tamarisk.operators import intel as ti
from tamarisk.operators.answers import parse_answers, with_analysis
from tamarisk.operators.history import latest_per_thread
from tamarisk.plans.verdicts import offline_verdicts, verdicts
from tamarisk.sources import sinks
from tests.conftest import SF, rows
from workload import mail
from workload.queries_intel import dated_snapshots, snapshots

T0 = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def doubled(df):
    return df.unionByName(df)


def test_answers_by_mailbox_and_time(spark):
    answer = '{"claude_score": %d, "threat_category": "PHISHING"}'
    raw = spark.createDataFrame(
        [("a", "1", answer % 10, at(0)), ("a", "1", answer % 20, at(2)), ("a", "1", answer % 30, at(1)),
         ("b", "1", answer % 40, at(0)), ("b", "1", answer % 40, at(0)), (None, "1", answer % 50, None)],
        "mailbox_id string, message_id string, raw_text string, answered_at timestamp")
    messages = spark.createDataFrame([("a", "1"), ("b", "1"), (None, "1"), ("c", "1")], "mailbox_id string, message_id string")
    got = with_analysis(messages, parse_answers(raw, "answered_at")).select("mailbox_id", "analysis.score", "analysis.available")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 20, True), ("b", 40, True), ("c", 0, False), (None, 50, True)]
    # tables of one mailbox need not name it; undated answers: one of them, always the same
    plain = with_analysis(messages.select("message_id").distinct(), parse_answers(raw.drop("mailbox_id", "answered_at")))
    assert plain.select("analysis.score").collect() == [(50,)]


@pytest.mark.parametrize("value, shown", [
    ('"false"', "false"), ('"0"', "0"), ("false", ""), ("0", ""), ("null", ""), ('""', ""), ("[]", ""), ("{}", ""),
    ("true", "True"), ("12", "12"), ('"loss"', "loss")])
def test_damage_text(spark, value, shown):
    raw = spark.createDataFrame([("1", '{"claude_score": 1, "potential_damage": %s}' % value)], "message_id string, raw_text string")
    assert parse_answers(raw).select("analysis.potential_damage").head()[0] == shown


def test_the_record_valid_at_the_time(spark):
    left = spark.createDataFrame([("m1", at(0), "u"), ("m2", at(5), "u"), ("m3", at(10), "u"), ("m4", at(10), "none"), ("m5", None, "u"),
                                  ("m6", at(7), None)], "message_id string, received_at timestamp, url string")
    vt = spark.createDataFrame(
        [("url", "u", 1, at(1)), ("url", "u", 2, at(5)), ("url", "u", 2, at(5)), ("url", "u", 3, at(99)), ("file", "u", 9, at(0)),
         ("url", None, 8, at(0))], "kind string, target string, malicious_count int, fetched_at timestamp")
    got = {r[0]: r[1] for r in ti.with_engines(left, vt, "url", "url").select("message_id", "vt.malicious_count").collect()}
    assert got == {"m1": None, "m2": 2, "m3": 2, "m4": None, "m5": None, "m6": None}
    # without the time of the message the latest record counts, without times one of them
    late = ti.with_engines(left.drop("received_at"), vt, "url", "url")
    assert late.count() == 6 and {r[0] for r in late.filter("url = 'u'").select("vt.malicious_count").collect()} == {3}
    assert ti.with_engines(left, doubled(vt.drop("fetched_at")), "url", "url").count() == 6
    undated = vt.withColumn("fetched_at", F.when(F.col("malicious_count") < 3, F.col("fetched_at")))
    got = {r[0]: r[1] for r in ti.with_engines(left, undated, "url", "url").select("message_id", "vt.malicious_count").collect()}
    assert got["m1"] == 3 and got["m3"] == 2


def test_gathering_equals_the_single_lookups(spark):
    m, known = mail.messages(spark, SF), dated_snapshots(spark, SF)
    gathered = ti.gather(m, known).select(
        "message_id", F.explode("intel.url_results").alias("r")).select("message_id", "r.target", "r.malicious_count")
    single = ti.with_engines(ti.url_rows(m), known.vt, "url", "url").filter("vt IS NOT NULL").select(
        "message_id", F.col("url").alias("target"), "vt.malicious_count")
    assert rows(gathered) == rows(single)
    assert single.count() > 50


def test_duplicated_inputs_change_nothing(spark):
    m, known = mail.messages(spark, SF), snapshots(spark, SF)
    twice = ti.Snapshots(*[None if s is None else doubled(s) for s in
                           (known.vt, known.abuse, known.safe_browsing, known.malware_feed, known.expansions)])
    answers, box = mail.raw_answers(m), mail.mailbox(spark, SF)
    pick = lambda df: rows(df.select("message_id", "score", "risk_level", F.array_join("triggered_by", ";").alias("t")))
    plain = pick(verdicts(m, known, box, answers))
    assert pick(verdicts(m, twice, doubled(box), doubled(answers))) == plain
    # a message that is given twice gives its verdict twice
    few = m.filter("CAST(message_id AS INT) < 40")
    again = pick(verdicts(doubled(few), twice, box, answers))
    assert len(again) == 80 and sorted(set(again), key=repr) == pick(verdicts(few, known, box, answers))


def test_one_id_in_several_mailboxes(spark):
    m = mail.messages(spark, SF).limit(60)
    box = mail.mailbox(spark, SF)
    known = snapshots(spark, SF)
    other = m.withColumns({"mailbox_id": F.lit("other"), "authentication_results": F.lit(None).cast("string"), "urls": F.slice("urls", 1, 0)})
    pick = lambda df: rows(df.select("mailbox_id", "message_id", "score", "risk_level", F.size("signals").alias("n")))
    both = pick(verdicts(m.unionByName(other), known, box))
    assert both == sorted(pick(verdicts(m, known, box)) + pick(verdicts(other, known, box)), key=repr)
    opened = box.limit(5).select("mailbox_id", "message_id")
    assert latest_per_thread(box.unionByName(box.withColumn("mailbox_id", F.lit("z"))), opened).filter("mailbox_id = 'z'").count() == (
        latest_per_thread(box.withColumn("mailbox_id", F.lit("z"))).count())


COLUMNS = "mailbox_id string, message_id string, received_at timestamp, score int"


def test_merge_by_day(spark, tmp_path):
    path = str(tmp_path / "v")
    df = lambda data, schema=COLUMNS: spark.createDataFrame(data, schema)
    read = lambda *names: sorted((tuple(r) for r in spark.read.parquet(path).select(*names).collect()), key=str)
    sinks.merge_by_day(df([]), path)
    sinks.merge_by_day(df([("a", "1", at(0), 1), ("a", "2", at(24), 2), ("a", "3", at(25), 3), ("b", "1", at(0), 4), (None, "1", at(0), 5),
                           ("a", "9", None, 6)]), path)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "v").rglob("*.parquet")}
    # one message scored again and given twice, one new, one without a day; another day stays as it is
    late = [("a", "2", at(24), 20, at(30)), ("a", "2", at(24), 21, at(31)), ("a", "4", at(30), 7, at(31)), ("a", "9", None, 60, at(1))]
    sinks.merge_by_day(df(late, COLUMNS + ", scored_at timestamp"), path, scored_column="scored_at")
    assert read("mailbox_id", "message_id", "score") == sorted(
        [("a", "1", 1), ("a", "2", 21), ("a", "3", 3), ("b", "1", 4), (None, "1", 5), ("a", "4", 7), ("a", "9", 60)], key=str)
    first_day = [f for f in files if "2024-01-10" in str(f)]
    assert first_day and all(f.exists() and f.stat().st_mtime_ns == files[f] for f in first_day)
    sinks.merge_by_day(df([("a", "1", at(1), 100)]), path)
    assert ("a", "1", 100) in read("mailbox_id", "message_id", "score") and len(read("score")) == 7
    assert "scored_at" in spark.read.parquet(str(tmp_path / "v" / "day=2024-01-11")).columns


def test_merge_reads_only_the_days_it_changes(spark, tmp_path):
    path = str(tmp_path / "v")
    scored = offline_verdicts(mail.messages(spark, SF)).select("mailbox_id", "message_id", "received_at", "score")
    sinks.write_by_day(scored, path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "v").rglob("*.parquet")}
    sinks.merge_by_day(scored.filter("message_id = '30'").withColumn("score", F.lit(-1)), path)
    changed = [f for f, t in before.items() if not f.exists() or f.stat().st_mtime_ns != t]
    assert changed and all("2024-01-02" in str(f) for f in changed)
    back = spark.read.parquet(path)
    assert back.count() == scored.count() and back.filter("score = -1").count() == 1


def test_many_days_are_listed_and_named_in_few_steps(spark, tmp_path):
    """Runs of days are one condition each; the folders of a table are listed by few tasks."""
    from datetime import date, timedelta

    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(400)] + [date(2030, 1, 1), None]
    wanted = sinks._on_days(days[::-1])
    assert str(wanted).count("DATE") + str(wanted).count("between") < 12 and len(str(wanted)) < 400
    around = days + [date(2023, 12, 31), date(2025, 2, 4), date(2029, 12, 31)]
    table = spark.createDataFrame([(d,) for d in around], "day date")
    assert {r.day for r in table.filter(wanted).collect()} == set(days)
    assert table.filter(sinks._on_days([None])).collect() == [(None,)]
    path = str(tmp_path / "v")
    sinks.write_by_day(spark.range(150).selectExpr("CAST(id AS STRING) AS message_id", "CAST(id AS INT) AS score",
                                                   "timestampadd(DAY, CAST(id AS INT), TIMESTAMP '2024-01-01 00:00:00') AS received_at"), path)
    cores, tracker = spark.sparkContext.defaultParallelism, spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    assert sinks.read_by_day(spark, path).count() == 150
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds) <= 4 * cores < 150
