"""Readers, writers, raw messages, actions, prompts corpus."""

import base64
import json

from pyspark.sql import functions as F

from tamarisk import schemas
from tamarisk.operators import mime
from tamarisk.operators.actions import pending_actions
from tamarisk.plans.verdicts import offline_verdicts
from tamarisk.sources import sinks, snapshots
from tests.conftest import SF, rows
from workload import mail


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode()


def raw(spark, *payloads):
    data = [(str(i), json.dumps({"id": str(i), "payload": p})) for i, p in enumerate(payloads)]
    return spark.createDataFrame(data, schemas.RAW_MESSAGE)


def test_raw_message(spark):
    tree = {
        "mimeType": "multipart/mixed",
        "headers": [{"name": "FROM", "value": "A <a@B.com>"}, {"name": "from", "value": "second"},
                    {"name": "Authentication-Results", "value": ""},
                    {"name": "ARC-Authentication-Results", "value": "arc"}],
        "parts": [
            {"mimeType": "multipart/alternative", "parts": [
                {"mimeType": "text/plain", "body": {"data": b64("hello https://p.com/a) ñ")}},
                {"mimeType": "text/html", "body": {"data": b64('<a href="https://h.com">text</a>')}}]},
            {"mimeType": "text/plain", "filename": "note.txt", "body": {"size": 3, "data": b64("no body")}},
            {"mimeType": "text/plain", "body": {"data": "!!"}},
            {"mimeType": "text/plain", "body": None, "parts": None},
        ],
    }
    row = mime.parse_raw_messages(raw(spark, tree, {}, {"parts": []})).orderBy("message_id").collect()
    assert row[0]["body_text"] == "hello https://p.com/a) ñ\n\n"
    assert row[0]["from_email"] == "A <a@B.com>" and row[0]["from_domain"] == "b.com"
    assert row[0]["authentication_results"] == "arc"
    assert [(a["filename"], a["size"]) for a in row[0]["attachments"]] == [("note.txt", 3)]
    assert [(u["url"], u["visible_text"]) for u in row[0]["urls"]] == [("https://h.com", "text"), ("https://p.com/a", None)]
    assert row[1]["body_text"] == "" and row[1]["attachments"] == [] and row[1]["urls"] == []


def test_deep_tree_keeps_every_part(spark):
    tree = {"mimeType": "text/plain", "body": {"data": b64("leaf")}}
    for _ in range(40):
        tree = {"mimeType": "multipart/x", "parts": [tree]}
    row = mime.with_parts(raw(spark, tree)).first()
    assert len(row["parts"]) == 41 and [len(p["path"]) for p in row["parts"]] == list(range(41))


def test_readers(spark, tmp_path):
    m = mail.messages(spark, SF)
    cols = [c for c in m.columns if c in schemas.MESSAGE]
    m.select(*cols).write.parquet(str(tmp_path / "m"))
    m.select(*cols).write.json(str(tmp_path / "j"))
    back = snapshots.read_messages(spark, str(tmp_path / "m"))
    again = snapshots.read_messages(spark, str(tmp_path / "j"), "json")
    assert back.count() == again.count() == m.count()
    flat = lambda df: rows(df.select("message_id", "subject", F.to_json("urls").alias("u"), F.to_json("attachments").alias("a")))
    assert flat(back) == flat(again) == flat(m)
    assert back.filter("recent_emails_from_sender IS NULL").count() == 0
    box = mail.mailbox(spark, SF)
    box.write.orc(str(tmp_path / "b"))
    assert snapshots.read_mailbox(spark, str(tmp_path / "b"), "orc").count() == box.count()


def test_attachment_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    files = snapshots.read_attachment_files(spark, str(tmp_path))
    row = mime.hash_attachments(files).first()
    assert row["size"] == 3 and row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert mime.hash_attachments(files, 2).first()["sha256"] is None


def test_writers(spark, tmp_path):
    scored = offline_verdicts(mail.messages(spark, SF))
    sinks.write_by_day(sinks.verdict_rows(scored), str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.count() == 200 and "day" in back.columns
    assert rows(back.select("message_id", "score", "risk_level")) == rows(scored.select("message_id", "score", "risk_level"))
    sinks.write_rows(sinks.signal_rows(scored), str(tmp_path / "s"), "json")
    assert spark.read.json(str(tmp_path / "s")).count() == sinks.signal_rows(scored).count()
    assert sinks.layer_score_rows(scored).count() == 1000


def test_day_filter_prunes_partitions(spark, tmp_path):
    scored = offline_verdicts(mail.messages(spark, SF)).select("message_id", "received_at", "score")
    sinks.write_by_day(scored, str(tmp_path / "v"))
    plan = spark.read.parquet(str(tmp_path / "v")).filter("day = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_scan_reads_only_needed_columns(spark):
    m = mail.messages(spark, SF)
    plan = m.select("message_id", "urls")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_actions_skip_handled_threads(spark):
    scored = spark.createDataFrame(
        [("1", "b", "t1", "Malicious"), ("2", "b", "t2", "Suspicious"), ("3", "b", "t3", "Safe"), ("4", "c", "t1", "Malicious")],
        "message_id string, mailbox_id string, thread_id string, risk_level string",
    )
    box = spark.createDataFrame([("b", "t1", "Spam"), ("c", "t9", "trash"), ("b", "t2", "inbox")],
                                "mailbox_id string, thread_id string, folder string")
    got = {r["message_id"]: (r["move_to_trash"], r["send_alert"], r["send_notice"]) for r in pending_actions(scored, box).collect()}
    assert got == {"2": (False, True, False), "4": (True, True, True)}


def test_partition_count_does_not_matter(spark):
    m = mail.messages(spark, SF)
    pick = lambda df: rows(offline_verdicts(df).select("message_id", "score", "threat_category", "user_explanation"))
    assert pick(m.repartition(7)) == pick(m.coalesce(1))


def test_only_small_inputs_are_spread(spark):
    from tamarisk.operators.layout import spread

    m = mail.messages(spark, SF)
    assert "RoundRobinPartitioning" in spread(m)._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        assert spread(m) is m
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_day_replaces_only_itself(spark, tmp_path):
    path = str(tmp_path / "days")
    days = [("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 10:00:00"), ("c", "2024-01-02 11:00:00"), ("d", None)]
    for row in days:
        df = spark.createDataFrame([row], "message_id string, at string").withColumn("at", F.col("at").cast("timestamp"))
        sinks.write_by_day(df, path, "at")
    assert sorted(r.message_id for r in spark.read.parquet(path).collect()) == ["a", "c", "d"]
