"""Lookups with hot keys, sender history with sliced senders, redirects, suffixes."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tamarisk.operators import history as hist
from tamarisk.operators import intel as ti
from tamarisk.operators.lookup import fits_broadcast, hot_keys, lookup_join
from tamarisk.operators.redirects import expand_urls
from tamarisk.operators.suffixes import registered_domains
from tamarisk.params import RiskParams
from tests.conftest import rows
from workload import mail

HOT = RiskParams(hot_key_rows=20, hot_key_limit=3, hot_key_slots=4)


def skewed(spark):
    left = spark.range(400).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE 'k' || id % 40 END AS k"
    )
    right = spark.range(30).selectExpr("'k' || id AS k", "id AS v").unionByName(
        spark.createDataFrame([("hot", 99)], "k string, v bigint")
    )
    return left, right


def test_salted_lookup_equals_plain_join(spark, no_broadcast):
    left, right = skewed(spark)
    assert not fits_broadcast(right)
    got = lookup_join(left, right, ["k"], ["id"], HOT)
    assert rows(got) == rows(left.join(right, "k", "left"))
    assert got.count() == 400
    assert [r.k for r in hot_keys(left, ["k"], HOT).collect()] == ["hot"]


def test_salted_lookup_spreads_the_hot_key(spark, no_broadcast):
    left, right = skewed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lookup_join(left, right, ["k"], ["id"], HOT)
        tasks = got.filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 1


def test_small_snapshot_is_broadcast_without_counting(spark):
    left, right = skewed(spark)
    small = spark.range(5).selectExpr("'k' || id AS k", "id AS v")
    assert fits_broadcast(small)
    plan = lookup_join(left, small, ["k"], ["id"], HOT)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "HashAggregate" not in plan


def test_intel_is_the_same_either_way(spark, no_broadcast):
    m = mail.messages(spark, "/root/testdata/sf0.001").select(
        "message_id", "urls", "attachments", "from_domain", "authentication_results", "d"
    )
    known = ti.Snapshots(vt=mail.engines(m), abuse=mail.abuse(m), malware_feed=mail.malware_feed(m))
    flat = lambda df: df.select("message_id", F.to_json("intel").alias("intel"))
    salted = flat(ti.with_intel(m.drop("d"), known, HOT))
    plain = flat(ti.with_intel(m.drop("d"), known, RiskParams()))
    assert rows(salted) == rows(plain)


# --- sender history ---------------------------------------------------------

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def mailbox_and_messages(spark, seed=5, n_mail=400, n_asked=60):
    rnd = random.Random(seed)
    box = []
    for i in range(n_mail):
        who = "hot" if rnd.random() < 0.6 else f"s{rnd.randrange(4)}"
        folder = rnd.choice(["inbox", "inbox", "inbox", "spam", "trash", "sent"])
        sender, to = ("me", who) if folder == "sent" else (who, "me")
        box.append(("b", f"t{rnd.randrange(90)}", f"m{i:04d}", sender, to, folder,
                    T0 + dt.timedelta(minutes=rnd.randrange(2000)), f"subject {i}", f"body {i} http://x.y/{i}", i % 2))
    asked = [(f"q{i:03d}", "b", rnd.choice(["hot", "s1", "s9", None]), f"t{rnd.randrange(90)}",
              T0 + dt.timedelta(minutes=rnd.randrange(2200))) for i in range(n_asked)]
    return box, asked


def brute(box, asked, cap=50):
    out = {}
    for q, b, who, thread, at in asked:
        seen = [m for m in box if m[6] < at and (m[4] if m[5] == "sent" else m[3]) == who] if who else []
        count = lambda f: min(cap, len({m[1] for m in seen if m[5] == f and m[1] != thread}))
        last = {}
        for m in sorted((m for m in seen if m[5] == "inbox"), key=lambda m: (m[6], m[2])):
            last.pop(m[1], None)
            last[m[1]] = m
        newest = list(last.values())[::-1]
        others = [m for m in newest if m[1] != thread][:cap]
        out[q] = (count("inbox"), count("spam"), count("trash"), any(m[5] == "sent" for m in seen),
                  others[-1][6] if others else None, [m[7] for m in newest[:5]])
    return out


BOX = ("mailbox_id string, thread_id string, message_id string, sender string, recipient string,"
       "folder string, received_at timestamp, subject string, body string, n_attachments int")
ASKED = "message_id string, mailbox_id string, sender string, thread_id string, received_at timestamp"


def history_of(spark, box, asked, params):
    m, b = spark.createDataFrame(asked, ASKED), spark.createDataFrame(box, BOX)
    counts = {r["message_id"]: r for r in hist.thread_counts(m, b, params).collect()}
    recent = {r["message_id"]: r for r in hist.recent_mail(m, b, params).collect()}
    out = {}
    for q, c in counts.items():
        r = recent.get(q)
        oldest = r["oldest_thread_at"].replace(tzinfo=dt.timezone.utc) if r and r["oldest_thread_at"] else None
        out[q] = (c["total_threads"], c["spam_count"], c["trash_count"], c["has_user_replied"], oldest,
                  [x["subject"] for x in r["recent"]] if r else [])
    return out


def test_history_against_brute_force(spark):
    box, asked = mailbox_and_messages(spark)
    got = history_of(spark, box, asked, RiskParams())
    want = brute(box, asked)
    assert got == want
    assert any(w[0] == 50 for w in want.values()), "the cap must be reached"


def test_history_in_slices_is_the_same(spark, no_broadcast):
    box, asked = mailbox_and_messages(spark, seed=9)
    sliced = RiskParams(hot_key_rows=10, hot_key_slots=3)
    assert history_of(spark, box, asked, sliced) == brute(box, asked)


def test_current_thread_can_count(spark):
    box, asked = mailbox_and_messages(spark, n_asked=5)
    m, b = spark.createDataFrame(asked, ASKED), spark.createDataFrame(box, BOX)
    with_it = hist.thread_counts(m, b, RiskParams(include_current_thread=True)).filter("available").collect()
    assert all(not r["is_first_time_sender"] for r in with_it)


def test_no_history_without_sender(spark):
    box, asked = mailbox_and_messages(spark)
    m, b = spark.createDataFrame(asked, ASKED), spark.createDataFrame(box, BOX)
    got = hist.with_sender_history(m, b).filter("sender IS NULL").select("sender_history.*", "recent_emails_from_sender").collect()
    assert got and all(not r["available"] and r["total_threads"] == 0 and r["recent_emails_from_sender"] == [] for r in got)


# --- redirects and suffixes --------------------------------------------------


def test_redirects(spark, no_broadcast):
    edges = [(f"http://c/{i}", f"http://c/{i + 1}") for i in range(9)]
    edges += [("http://loop/a", "http://loop/b"), ("http://loop/b", "http://loop/a"), ("http://self", "http://self")]
    urls = ["http://c/0", "http://c/1", "http://c/5", "http://none", "http://loop/a", "http://self", "", "ftp://x"]
    df = expand_urls(
        spark.createDataFrame([(u,) for u in urls + urls], "url string"),
        spark.createDataFrame(edges, "src string, dst string"), HOT,
    )
    got = {r["original_url"]: r for r in df.collect()}
    assert len(got) == df.count() == len(urls)
    assert got["http://c/0"]["error"] == "too many redirects"
    assert (got["http://c/1"]["redirect_count"], got["http://c/1"]["final_url"]) == (8, "http://c/9")
    assert got["http://c/5"]["redirect_chain"] == [f"http://c/{i}" for i in range(5, 10)]
    assert got["http://none"]["expanded"] is False and got["http://none"]["final_url"] == "http://none"
    assert got["http://loop/a"]["error"] == got["http://self"]["error"] == "too many redirects"
    assert got[""]["error"] == "empty url" and got["ftp://x"]["error"] == "unsupported scheme: ftp"


def test_long_redirects(spark):
    """Chains beyond one plan, cycles that are met late, many URLs with one target, several targets."""
    edges = [(f"http://c/{i}", f"http://c/{i + 1}") for i in range(40)]
    edges += [(f"http://in/{i}", "http://c/30") for i in range(50)]
    edges += [(f"http://l/{i}", f"http://l/{i + 1}") for i in range(25)] + [("http://l/25", "http://l/13")]
    edges += [("http://two", "http://c/39"), ("http://two", "http://b"), (None, "x"), ("http://d", None), ("http://two", "http://b")]
    urls = ["http://c/0", "http://l/0", "http://two", "http://d", None] + [f"http://in/{i}" for i in range(50)]
    asked = spark.createDataFrame([(u,) for u in urls], "url string")
    links = spark.createDataFrame(edges, "src string, dst string")
    far = {r["original_url"]: r for r in expand_urls(asked, links, RiskParams(max_redirects=50)).collect()}
    assert (far["http://c/0"]["redirect_count"], far["http://c/0"]["final_url"], len(far["http://c/0"]["redirect_chain"])) == (40, "http://c/40", 41)
    assert far["http://l/0"]["error"] == "too many redirects" and far["http://l/0"]["redirect_chain"] == []
    assert far["http://two"]["redirect_chain"] == ["http://two", "http://b"] and far["http://d"]["expanded"] is False
    assert all(far[f"http://in/{i}"]["redirect_count"] == 11 for i in range(50)) and far[""]["error"] == "empty url"
    for limit, error in ((39, "too many redirects"), (40, None)):
        r = expand_urls(asked.limit(1), links, RiskParams(max_redirects=limit)).head()
        assert r["error"] == error
    plan = expand_urls(asked, links)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 9
    assert expand_urls(asked.limit(0), links).count() == 0 and expand_urls(asked, links.limit(0)).count() == len(far)


def test_suffixes(spark):
    rules = spark.createDataFrame([(s,) for s in ["com", "uk", "co.uk", "*.ck", "!www.ck"]], "suffix string")
    want = {"a.b.com": "b.com", "com": None, "x.co.uk": "x.co.uk", "y.z.co.uk": "z.co.uk", "q.uk": "q.uk",
            "a.b.ck": "a.b.ck", "b.ck": None, "www.ck": "www.ck", "x.www.ck": "www.ck"}
    hosts = spark.createDataFrame([(h,) for h in list(want) + ["nowhere"]], "host string")
    got = {r[0]: r[1] for r in registered_domains(hosts, rules).collect()}
    assert got == want
