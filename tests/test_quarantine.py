"""Rows that do not parse: good and bad add up, reasons, counts."""

import json

import pytest

from tamarisk import schemas
from tamarisk.operators.answers import parse_answers
from tamarisk.sources import quarantine as qu
from tamarisk.sources import snapshots as snap


def test_json_lines(spark, tmp_path):
    lines = [json.dumps({"message_id": "1", "subject": "s", "urls": [{"url": "u"}]}), "{broken", '{"message_id": "2", "received_at": {}}',
             json.dumps({"subject": "none"}), json.dumps({"message_id": ""}), "[1]", json.dumps({"message_id": "3", "other": 1})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    found = qu.read_checked_messages(spark, str(tmp_path / "in"))
    good = {r.message_id: r for r in found.good.collect()}
    assert set(good) == {"1", "3"} and good["3"].urls == [] and good["1"].urls[0].url == "u"
    assert found.counts.get == {"n_rows": len(lines), "n_bad": 5}
    bad = sorted((r.reason, r.raw) for r in found.bad.collect())
    assert [r for r, _ in bad] == ["does not fit the schema"] * 3 + ["no message_id"] * 2
    assert {"{broken", "[1]"} <= {t for _, t in bad}
    # whatever is read of them
    assert found.good.select("subject").count() == 2
    assert found.good.columns == snap.read_messages(spark, str(tmp_path / "in"), "json").columns


def test_parquet_has_required_fields_only(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("1", "a"), (None, "b"), ("", "c")], schemas.RAW_ANSWER).write.parquet(path)
    found = qu.read_checked(spark, path, schemas.RAW_ANSWER, "parquet")
    assert found.good.count() == 1 and {r.reason for r in found.bad.collect()} == {"no message_id"}
    spark.createDataFrame([], schemas.RAW_ANSWER).write.parquet(str(tmp_path / "e"))
    assert qu.read_checked(spark, str(tmp_path / "e"), schemas.RAW_ANSWER, "parquet").rows.count() == 0


def test_answers(spark):
    texts = ['{"claude_score": 1}', "```json\n{}\n```", "", None, "[1]", "{", "7", '{"claude_score": 1, "claude_score": 2}', "{} x", "{}{}", '{"claude_score": 1, "claude_score": 2},{}']
    raw = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [(None, "{}")], schemas.RAW_ANSWER)
    found = qu.check_answers(raw)
    assert sorted(r.message_id for r in found.good.collect()) == ["0", "1", "7"]
    assert found.counts.get == {"n_rows": 12, "n_bad": 9}
    assert sorted(r.reason for r in found.bad.collect()) == [
        "empty", "empty", "no message_id", *["not JSON"] * 4, "not an object", "not an object"]
    # what is good here is what the parser calls available
    parsed = parse_answers(raw.filter("message_id IS NOT NULL"))
    assert sorted(r[0] for r in parsed.filter("analysis.available").select("message_id").collect()) == ["0", "1", "7"]


def test_engine_bodies(spark):
    fine = json.dumps({"data": {"attributes": {"last_analysis_stats": {"malicious": 3}}}})
    rows = [("url", "a", fine), (None, "b", fine), ("url", "c", "{"), ("url", "d", None), ("moon", "e", fine), ("ip", "f", "{}"),
            ("url", "g", json.dumps({"data": {"attributes": {"last_analysis_stats": {"malicious": "many"}}}})),
            ("url", "h", json.dumps({"data": {"attributes": {"last_analysis_stats": 5}}}))]
    raw = spark.createDataFrame(rows, schemas.REPUTATION_BODY)
    found = qu.check_engine_bodies(raw)
    assert sorted(r.reason for r in found.bad.collect()) == ["counts are no whole numbers"] * 2 + ["not JSON"] * 2 + ["unknown kind"]
    assert found.good.count() + found.bad.count() == raw.count()
    # the normaliser keeps the good rows and no other
    assert sorted(r.target for r in snap.normalise_engines(raw).collect()) == sorted(r.target for r in found.good.collect()) == ["a", "b", "f"]
    other = qu.check_bodies(spark.createDataFrame([("u", "{}"), ("v", "x"), ("w", None)], "url string, body string"))
    assert other.good.count() == 1 and other.bad.count() == 2


@pytest.mark.parametrize("text, score, category", [
    ('{"claude_score": 10, "threat_category": "BEC", "claude_score": 60}', 60, "BEC"),
    ('{"claude_score": 10, "threat_category": "BEC", "threat_category": "PHISHING"}', 10, "PHISHING"),
    ('{"claude_score": 5, "extra": 1, "extra": 2}', 5, "SUSPICIOUS"),
])
def test_a_repeated_key_takes_its_last_value(spark, text, score, category):
    got = parse_answers(spark.createDataFrame([("1", text)], schemas.RAW_ANSWER)).select("analysis.*").head()
    assert (got.available, got.score, got.threat_category) == (True, score, category)
    lists = '{"main_findings": ["a"], "main_findings": ["b", "", "c"], "what_to_do": {"do": ["x"]}}'
    got = parse_answers(spark.createDataFrame([("1", lists)], schemas.RAW_ANSWER)).select("analysis.*").head()
    assert (got.main_findings, got.do) == (["b", "c"], ["x"])
