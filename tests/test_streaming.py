"""Streams over several micro-batches against the batch results."""

from pyspark.sql import functions as F

from tamarisk.operators import history as hist
from tamarisk.plans.verdicts import offline_verdicts, verdicts
from tamarisk.streaming import history as sh
from tamarisk.streaming import jobs
from tamarisk.streaming.verdicts import full_rows, verdict_plan
from tests.conftest import SF, rows
from workload import mail
from workload.queries_intel import snapshots
from workload.queries_stream import DOCUMENTS, EVENTS
from workload.registry import QUERIES


def split_by_time(df, path, column, n):
    """Files that arrive one after the other, in time order."""
    for i in range(n):
        df.filter(f"{column} % {n} >= 0").orderBy(column).withColumn(
            "_p", F.ntile(n).over(hist.Window.orderBy(column))
        ).filter(f"_p = {i + 1}").drop("_p").coalesce(1).write.mode("append").parquet(path)


def test_scoring_in_batches(spark, tmp_path):
    docs = mail.table(spark, SF, "documents")
    split_by_time(docs, str(tmp_path / "in"), "doc_id", 4)
    stream = mail.messages_from(jobs.read_stream(spark, str(tmp_path / "in"), DOCUMENTS, 1))
    pick = lambda df: df.select("message_id", "score", "risk_level", "threat_category")
    got = jobs.run_to_table(pick(offline_verdicts(stream)), "t")
    assert rows(got) == rows(pick(offline_verdicts(mail.messages_from(docs))))


def test_history_state_over_batches(spark, tmp_path):
    sh.use_state_store(spark)
    box, m = mail.mailbox(spark, SF), mail.messages(spark, SF)
    asked = m.select("message_id", "mailbox_id", "sender", "thread_id", "received_at")
    events = sh.history_events(box, asked).orderBy("at", "is_mail", "message_id")
    path = str(tmp_path / "in")
    split_by_time(events.withColumn("seq", F.col("at")), path, "seq", 5)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema) + ", seq bigint"
    stream = jobs.read_stream(spark, path, schema, 1).drop("seq")
    got = jobs.run_to_table(sh.running_history(stream), "t")
    want = hist.with_sender_history(asked, box)
    h = F.col("sender_history")
    assert rows(
        got.select("message_id", "total_threads", "spam_count", "trash_count", "has_user_replied",
                   "oldest_thread_iso_date", F.to_json(F.transform("recent", lambda r: r["subject"])).alias("subjects"))
    ) == rows(
        want.select("message_id", h["total_threads"].alias("total_threads"), h["spam_count"].alias("spam_count"),
                    h["trash_count"].alias("trash_count"), h["has_user_replied"].alias("has_user_replied"),
                    h["oldest_thread_iso_date"].alias("oldest_thread_iso_date"),
                    F.to_json(F.transform("recent_emails_from_sender", lambda r: r["subject"])).alias("subjects"))
    )


def test_repeated_batch_overwrites_itself(spark, tmp_path):
    docs = mail.table(spark, SF, "documents").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), DOCUMENTS)
    for run in ("a", "b"):  # a new checkpoint repeats batch 0
        jobs.write_batches(stream, lambda b: b.select("doc_id"), str(tmp_path / "out"), str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_a_batch_is_made_once(spark, tmp_path):
    """A plan that reads its batch several times does not run the stream, and its state, again."""
    docs = mail.table(spark, SF, "documents").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def noted(doc_id):
        made.add(1)
        return doc_id

    stream = jobs.read_stream(spark, str(tmp_path / "in"), DOCUMENTS).select(noted("doc_id").alias("doc_id"))
    twice = lambda b: b.where(f"doc_id < {b.count()}").unionByName(b.where("doc_id >= 0"))
    out = jobs.run_batches_to_table(stream, twice, "t")
    assert out.count() == 20 + docs.where("doc_id < 20").count()
    assert made.value == 20


def test_full_verdict_over_batches(spark, tmp_path):
    """History, answers and reputation of a stream in several batches equal the batch verdict."""
    sh.use_state_store(spark)
    docs = mail.table(spark, SF, "documents").filter("doc_id < 60").select("doc_id", "text", "lang", "source", "n_chars")
    events = mail.table(spark, SF, "events")
    cuts = [(0, 20), (20, 40), (40, 60)]
    hour = "(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00')) / 3.6e9"
    for lo, hi in cuts:
        docs.filter(f"doc_id >= {lo} AND doc_id < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
        events.filter(f"{hour} >= {lo} AND {hour} < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    close = docs.filter("doc_id = 0").withColumn("doc_id", F.lit(-1).cast("long")).coalesce(1)
    close.write.mode("append").parquet(str(tmp_path / "d"))
    events.filter("event_id = 0").withColumns({"ts": F.lit("2100-01-01 00:00:00").cast("timestamp"), "user_id": F.lit(7777777)}).select(
        *events.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    at = F.expr("CASE WHEN d < 0 THEN TIMESTAMP '2100-01-01 00:00:00' ELSE received_at END")
    read = lambda: mail.messages_from(jobs.read_stream(spark, str(tmp_path / "d"), DOCUMENTS, 1)).withColumn("received_at", at)
    answers = read().filter("d % 8 <> 7").selectExpr(
        "mailbox_id", "message_id", f"{mail.ANSWER_TEXT} AS raw_text",
        # every third comes too late, every second twice
        "received_at + make_interval(0, 0, 0, 0, 0, 0, CASE d % 3 WHEN 2 THEN 40 ELSE 5 END) AS answered_at",
    ).withColumn("again", F.explode(F.expr("CASE WHEN message_id % 2 = 0 THEN array(1, 2) ELSE array(1) END"))).drop("again")
    box = mail.mailbox_from(jobs.read_stream(spark, str(tmp_path / "e"), EVENTS, 1))
    versions = []

    def known():
        versions.append(1)
        return snapshots(spark, SF)

    plan = verdict_plan(known)
    pick = lambda df: df.select("message_id", "score", "risk_level", "threat_category", F.array_join("triggered_by", ";").alias("t"))
    out = jobs.run_batches_to_table(full_rows(read(), box, answers), lambda b: pick(plan(b)), "t").filter("message_id <> '-1'")
    m = mail.messages_from(docs)
    timely = mail.raw_answers(m.filter("d % 3 <> 2"))
    want = pick(verdicts(m, snapshots(spark, SF), mail.mailbox(spark, SF), timely))
    assert rows(out) == rows(want) and len(versions) > 1
    got = {r.has_history for r in jobs.run_batches_to_table(
        full_rows(read(), box, answers), lambda b: b.select(F.col("sender_history").isNotNull().alias("has_history")), "h").collect()}
    assert got == {True}


def test_tables_of_one_file_and_of_many(spark, tmp_path):
    """A folder of part files is read whole, like one file; no file at all gives no rows."""
    docs, box = mail.table(spark, SF, "documents"), mail.table(spark, SF, "events")
    many = tmp_path / "many"
    docs.repartition(3).write.parquet(str(many / "documents.parquet"))
    box.repartition(2).write.parquet(str(many / "events.parquet"))
    for name in ("stream_verdicts_intel", "stream_verdicts_offline", "stream_act_once"):
        want = rows(QUERIES[name](spark, SF))
        assert want and rows(QUERIES[name](spark, str(many))) == want
    (tmp_path / "none").mkdir()
    stream = mail.messages_from(jobs.read_stream(spark, str(tmp_path / "none"), DOCUMENTS))
    out = jobs.run_batches_to_table(stream, lambda b: offline_verdicts(b).select("message_id", "score"), "t")
    assert out.columns == ["message_id", "score"] and out.count() == 0
