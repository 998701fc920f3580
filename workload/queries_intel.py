"""Reputation, history, answers and full-verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk.functions.address import sender_ip
from tamarisk.operators import answers as ans
from tamarisk.operators import features as ft
from tamarisk.operators import history as hist
from tamarisk.operators import intel as ti
from tamarisk.operators import scoring as sc
from tamarisk.operators.lineage import new_folder
from tamarisk.operators.redirects import expand_urls
from tamarisk.params import RiskParams
from tamarisk.plans.verdicts import verdicts
from tamarisk.sources import snapshots as snap
from workload import duck, mail
from workload import duck_intel as di
from workload.mail import messages
from workload.registry import query

_REP = duck.with_mail(di.REPUTATION)
_HIST = duck.with_mail(di.HISTORY)
FULL = duck.with_mail(
    duck.FEATURES, di.REPUTATION, di.HISTORY, di.ANSWERS, di.FULL_G, duck.SCORED
)
_INTEL_ONLY = duck.with_mail(
    duck.FEATURES, di.REPUTATION, di.HISTORY, di.ANSWERS,
    di.FULL_G.replace("hs.total_threads = 0 AS", "false AS")
    .replace("hs.has_user_replied AS", "false AS")
    .replace("(spam_count + trash_count >= 3", "(false AND spam_count >= 0")
    .replace("OR (total_threads > 0", "AND (total_threads > 0")
    .replace("an.ok AS ai_ok", "false AS ai_ok"),
    duck.SCORED,
)


def snapshots(spark, sf, expanded=False):
    """Reputation of the messages' keys; expansions feed the reports only."""
    m = messages(spark, sf)
    return ti.Snapshots(
        vt=mail.engines(m),
        abuse=mail.abuse(m),
        safe_browsing=snap.normalise_safe_browsing(mail.browsing_matches(m)),
        malware_feed=mail.malware_feed(m),
        expansions=expand_urls(mail.short_urls(m), mail.redirects(m)) if expanded else None,
    )


def full_scored(spark, sf, recent=False):
    m = messages(spark, sf)
    return verdicts(
        m, snapshots(spark, sf, expanded=recent), mail.mailbox(spark, sf), mail.raw_answers(m), recent=recent
    )


# --- single lookups ---------------------------------------------------------


def _vt_oracle(kind: str, key: str) -> str:
    return _REP + (
        f"SELECT CAST(lv.d AS STRING) AS message_id, CAST(pos AS INT) AS pos, key AS {key}, malicious_count, total_engines"
        f" FROM lv WHERE kind = '{kind}'"
    )


def _vt_columns(df, key):
    return df.select(
        "message_id", "pos", key,
        F.col("vt.malicious_count").alias("malicious_count"),
        F.col("vt.total_engines").alias("total_engines"),
    )


@query("vt_url_join", _vt_oracle("url", "url"))
def vt_url_join(spark, sf):
    m = messages(spark, sf)
    rows = ti.url_rows(m).withColumn("pos", F.col("pos") + 1)
    return _vt_columns(ti.with_engines(rows, mail.engines(m), "url", "url"), "url")


@query("vt_file_join", _vt_oracle("file", "sha256"))
def vt_file_join(spark, sf):
    m = messages(spark, sf)
    rows = ti.hash_rows(m).withColumn("pos", F.col("pos") + 1)
    return _vt_columns(ti.with_engines(rows, mail.engines(m), "file", "sha256"), "sha256")


@query("vt_domain_join", _vt_oracle("domain", "from_domain"))
def vt_domain_join(spark, sf):
    m = messages(spark, sf)
    rows = m.filter("from_domain IS NOT NULL").select("message_id", F.lit(1).alias("pos"), "from_domain")
    return _vt_columns(ti.with_engines(rows, mail.engines(m), "domain", "from_domain"), "from_domain")


def _ip_rows(m):
    ip = sender_ip(F.col("authentication_results"))
    return m.select("message_id", F.lit(1).alias("pos"), ip.alias("sender_ip")).filter("sender_ip IS NOT NULL")


@query("vt_ip_join", _vt_oracle("ip", "sender_ip"))
def vt_ip_join(spark, sf):
    m = messages(spark, sf)
    return _vt_columns(ti.with_engines(_ip_rows(m), mail.engines(m), "ip", "sender_ip"), "sender_ip")


@query(
    "ip_abuse_join",
    _REP + "SELECT CAST(lk.d AS STRING) AS message_id, key AS sender_ip, abuse_confidence, country_name, total_reports,"
    " is_tor FROM lk LEFT JOIN ab ON ab.ip = key WHERE kind = 'ip'",
)
def ip_abuse_join(spark, sf):
    m = messages(spark, sf)
    return ti.with_abuse(_ip_rows(m), mail.abuse(m)).select(
        "message_id", "sender_ip", "abuse.abuse_confidence", "abuse.country_name",
        "abuse.total_reports", "abuse.is_tor",
    )


@query(
    "safe_browsing_join",
    _REP + "SELECT CAST(d AS STRING) AS message_id, CAST(pos AS INT) AS pos, key AS url, types IS NOT NULL AS is_threat,"
    " coalesce(types, '') AS threat_types FROM lv WHERE kind = 'url'",
)
def safe_browsing_join(spark, sf):
    m = messages(spark, sf)
    rows = ti.url_rows(m).withColumn("pos", F.col("pos") + 1)
    listed = snap.normalise_safe_browsing(mail.browsing_matches(m))
    return ti.with_safe_browsing(rows, listed).select(
        "message_id", "pos", "url", "gsb.is_threat",
        F.array_join("gsb.threat_types", ",").alias("threat_types"),
    )


@query(
    "malware_feed_join",
    _REP + "SELECT CAST(d AS STRING) AS message_id, CAST(pos AS INT) AS pos, key AS url,"
    " coalesce(in_database, false) AS in_database, threat, coalesce(tags, '') AS tags FROM lv WHERE kind = 'url'",
)
def malware_feed_join(spark, sf):
    m = messages(spark, sf)
    rows = ti.url_rows(m).withColumn("pos", F.col("pos") + 1)
    return ti.with_malware_feed(rows, mail.malware_feed(m)).select(
        "message_id", "pos", "url", "feed.in_database", "feed.threat",
        F.coalesce(F.array_join("feed.tags", ","), F.lit("")).alias("tags"),
    )


# --- the record that was valid when a message came ---------------------------

_DATED = duck.with_mail(di.DATED)


def dated_snapshots(spark, sf):
    m = messages(spark, sf)
    listed = snap.normalise_safe_browsing(mail.browsing_matches(m))
    return ti.Snapshots(
        vt=mail.dated(mail.engines(m), "target", malicious_count=mail.later("malicious_count", 3, 8)),
        abuse=mail.dated(mail.abuse(m), "ip", abuse_confidence=mail.later("abuse_confidence", 31, 101)),
        safe_browsing=mail.dated(
            listed, "url", threat_types="CASE WHEN v = 1 THEN array('MALWARE') ELSE threat_types END"
        ),
        malware_feed=mail.dated(mail.malware_feed(m), "url", in_database="in_database AND v <> 1"),
    )


@query(
    "engines_as_of",
    _DATED + "SELECT CAST(d AS STRING) AS message_id, kind, CAST(pos AS INT) AS pos, key, malicious_count, total_engines"
    " FROM lv",
)
def engines_as_of(spark, sf):
    m, vt = messages(spark, sf), dated_snapshots(spark, sf).vt
    key = ["message_id", "received_at"]
    kinds = {
        "url": ti.url_rows(m).select(*key, F.col("pos") + 1, F.col("url").alias("key")),
        "file": ti.hash_rows(m).select(*key, F.col("pos") + 1, F.col("sha256").alias("key")),
        "domain": m.select(*key, F.lit(1), F.col("from_domain").alias("key")).filter("key IS NOT NULL"),
        "ip": m.select(*key, F.lit(1), sender_ip(F.col("authentication_results")).alias("key")).filter("key IS NOT NULL"),
    }
    parts = [
        ti.with_engines(rows.toDF(*key, "pos", "key"), vt, kind, "key").select(
            "message_id", F.lit(kind).alias("kind"), "pos", "key", "vt.malicious_count", "vt.total_engines"
        )
        for kind, rows in kinds.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "lists_as_of",
    _DATED + "SELECT CAST(d AS STRING) AS message_id, CAST(pos AS INT) AS pos, key AS url, types IS NOT NULL AS is_threat,"
    " coalesce(types, '') AS threat_types, coalesce(in_database, false) AS in_database, coalesce(tags, '') AS tags"
    " FROM lv WHERE kind = 'url'",
)
def lists_as_of(spark, sf):
    m, known = messages(spark, sf), dated_snapshots(spark, sf)
    rows = ti.url_rows(m).withColumn("pos", F.col("pos") + 1)
    both = ti.with_malware_feed(ti.with_safe_browsing(rows, known.safe_browsing), known.malware_feed)
    return both.select(
        "message_id", "pos", "url", "gsb.is_threat", F.array_join("gsb.threat_types", ",").alias("threat_types"),
        "feed.in_database", F.coalesce(F.array_join("feed.tags", ","), F.lit("")).alias("tags"),
    )


@query(
    "abuse_as_of",
    _DATED + "SELECT CAST(d AS STRING) AS message_id, key AS sender_ip, abuse_confidence, country_name, total_reports"
    " FROM lv WHERE kind = 'ip'",
)
def abuse_as_of(spark, sf):
    m = messages(spark, sf)
    ip = sender_ip(F.col("authentication_results"))
    rows = m.select("message_id", "received_at", ip.alias("sender_ip")).filter("sender_ip IS NOT NULL")
    return ti.with_abuse(rows, dated_snapshots(spark, sf).abuse).select(
        "message_id", "sender_ip", "abuse.abuse_confidence", "abuse.country_name", "abuse.total_reports"
    )


@query(
    "verdicts_as_of",
    duck.with_mail(duck.FEATURES, di.DATED, di.HISTORY, di.ANSWERS, di.FULL_G, duck.SCORED)
    + "SELECT message_id, score, risk_level, threat_category, action_taken, triggered_by FROM v",
)
def verdicts_as_of(spark, sf):
    """The full verdict with reputation as it stood when each message came."""
    m = messages(spark, sf)
    return _verdict_columns(
        verdicts(m, dated_snapshots(spark, sf), mail.mailbox(spark, sf), mail.raw_answers(m))
    )


_CHAINS = """
ex AS (SELECT url, k, CASE WHEN k < 0 THEN 1 ELSE CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 8 ELSE -1 END END AS hops
  FROM (SELECT DISTINCT url, CASE WHEN d % 9 = 0 THEN -1 ELSE d % 200 END AS k FROM mu WHERE domain IN ('bit.ly', 't.co'))),
xp AS (SELECT url AS original_url,
  CASE WHEN hops < 0 THEN NULL WHEN hops = 0 THEN url WHEN k < 0 THEN 'https://land.example/0'
       ELSE 'https://hop.example/' || k || '/' || hops END AS final_url,
  CAST(greatest(hops, 0) AS INT) AS redirect_count, hops > 0 AS expanded,
  CASE WHEN hops < 0 THEN 'too many redirects' END AS error,
  CASE WHEN hops < 0 THEN '' WHEN hops = 0 THEN url WHEN k < 0 THEN url || ' https://land.example/0'
       ELSE url || ' ' || array_to_string(list_transform(range(1, hops + 1), lambda i: 'https://hop.example/' || k || '/' || i), ' ')
  END AS chain FROM ex)"""


@query("redirect_chains", duck.with_mail(_CHAINS) + "SELECT * FROM xp")
def redirect_chains(spark, sf):
    m = messages(spark, sf)
    return expand_urls(mail.short_urls(m), mail.redirects(m)).select(
        "original_url", "final_url", "redirect_count", "expanded", "error",
        F.array_join("redirect_chain", " ").alias("chain"),
    )


@query(
    "redirect_chains_long",
    duck.with_mail()
    + """SELECT url AS original_url, CASE WHEN n > 0 THEN 'https://far.example/' || k || '/' || n WHEN n = 0 THEN url END AS final_url,
      CAST(greatest(n, 0) AS INT) AS redirect_count, CASE WHEN n < 0 THEN 'too many redirects' END AS error,
      CASE WHEN n < 0 THEN '' ELSE array_to_string(list_concat([url],
        list_transform(range(1, n + 1), lambda i: 'https://far.example/' || k || '/' || i)), ' ') END AS chain
    FROM (SELECT url, k, CASE WHEN k = '' THEN 0 ELSE CASE CAST(k AS INT) % 4 WHEN 0 THEN 8 WHEN 1 THEN 9 WHEN 2 THEN 40 ELSE -1 END END AS n
      FROM (SELECT DISTINCT url, regexp_extract(url, 't.co/q([0-9]+)$', 1) AS k FROM mu WHERE domain IN ('bit.ly', 't.co')))""",
)
def redirect_chains_long(spark, sf):
    """A limit of fifty hops."""
    m = messages(spark, sf)
    found = expand_urls(mail.short_urls(m), mail.long_redirects(m), RiskParams(max_redirects=50))
    return found.select(
        "original_url", "final_url", "redirect_count", "error", F.array_join("redirect_chain", " ").alias("chain")
    )


@query(
    "shortener_expansions",
    duck.with_mail(_CHAINS)
    + "SELECT message_id, url, final_url, redirect_count, error FROM mu LEFT JOIN xp ON original_url = url"
    " WHERE pos <= 5 AND lower(domain) IN ('bit.ly', 't.co')",
)
def shortener_expansions(spark, sf):
    m = messages(spark, sf)
    expansions = expand_urls(mail.short_urls(m), mail.redirects(m))
    return ti.with_expansion(ti.shortener_rows(m), expansions).select(
        "message_id", "url", "expansion.final_url", "expansion.redirect_count", "expansion.error"
    )


# --- gathered reputation ----------------------------------------------------


@query(
    "intel_measures",
    _REP + "SELECT m.message_id, coalesce(url_n, 0) AS max_url_engines, coalesce(file_n, 0) AS max_file_engines,"
    " coalesce(conf, 0) AS abuse_confidence, coalesce(dom_n, 0) AS max_domain_engines, coalesce(ip_n, 0) AS max_ip_engines,"
    " CAST(coalesce(gsb_n, 0) AS INT) AS gsb_threats, CAST(coalesce(feed_n, 0) AS INT) AS feed_hits FROM m LEFT JOIN im ON im.d = m.d",
)
def intel_measures(spark, sf):
    m = messages(spark, sf)
    narrow = m.select("message_id", "urls", "attachments", "from_domain", "authentication_results")
    gathered = ti.with_intel(narrow, snapshots(spark, sf))
    return sc.with_intel_measures(gathered).select("message_id", *sc.INTEL_MEASURES)


@query(
    "late_flags",
    _REP + "SELECT m.message_id, coalesce(young, false) AS domain_recently_registered,"
    " coalesce(fresh, false) AS recently_seen_attachment FROM m LEFT JOIN im ON im.d = m.d",
)
def late_flags(spark, sf):
    m = messages(spark, sf)
    narrow = m.select(
        "message_id", "urls", "attachments", "from_domain", "authentication_results", "received_at"
    )
    gathered = ti.with_intel(narrow, ti.Snapshots(vt=mail.engines(m)))
    return ft.with_intel_flags(gathered).select("message_id", *ft.INTEL_FLAGS)


@query(
    "proven_triggers",
    _REP + "SELECT CAST(d AS STRING) AS message_id, array_to_string(proven, ';') AS triggers FROM pt",
)
def proven_triggers(spark, sf):
    m = messages(spark, sf)
    narrow = m.select("message_id", "urls", "attachments", "from_domain", "authentication_results")
    gathered = ti.with_intel(narrow, snapshots(spark, sf))
    triggers = F.array_join(sc.proven_triggers(F.col("intel"), sc.RiskParams()), ";")
    return gathered.select("message_id", triggers.alias("triggers")).filter("triggers <> ''")


@query(
    "proven_predicates",
    _REP + "SELECT kind, count(*) FILTER (WHERE malicious_count >= 5) AS proven,"
    " count(*) FILTER (WHERE malicious_count > 0) AS is_malicious, count(*) AS n FROM vt GROUP BY kind"
    " UNION ALL SELECT 'abuse', count(*) FILTER (WHERE abuse_confidence >= 75), count(*) FILTER (WHERE abuse_confidence > 0), count(*) FROM ab",
)
def proven_predicates(spark, sf):
    m = messages(spark, sf)
    vt, ab = mail.engines(m), mail.abuse(m)
    by_kind = vt.groupBy("kind").agg(
        F.count_if(ti.proven_by_engines(F.col("malicious_count"))).alias("proven"),
        F.count_if(F.col("malicious_count") > 0).alias("is_malicious"),
        F.count("*").alias("n"),
    )
    by_abuse = ab.select(
        F.lit("abuse").alias("kind"), ti.proven_by_abuse(F.col("abuse_confidence")).alias("p"),
        (F.col("abuse_confidence") > 0).alias("a"),
    ).groupBy("kind").agg(
        F.count_if("p").alias("proven"), F.count_if("a").alias("is_malicious"), F.count("*").alias("n")
    )
    return by_kind.unionByName(by_abuse)


# --- normalised snapshots ---------------------------------------------------


@query(
    "engine_snapshot",
    _REP + "SELECT kind, target, malicious_count, total_engines, first_submission_date, creation_date,"
    " malicious_count > 0 AS is_malicious, CASE n % 3 WHEN 0 THEN 'phish,kit' ELSE '' END AS threat_names FROM vt",
)
def engine_snapshot(spark, sf):
    vt = mail.engines(messages(spark, sf))
    body = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    F.create_map(
                        F.lit("malicious"), F.col("malicious_count"),
                        F.lit("undetected"), F.col("total_engines") - F.col("malicious_count") - 1,
                        F.lit("brand-new"), F.lit(1),
                    ).alias("last_analysis_stats"),
                    "first_submission_date", "creation_date", "threat_names",
                    F.when(F.col("kind") == "file", F.col("target")).alias("sha256"),
                ).alias("attributes")
            ).alias("data")
        )
    )
    # stored as they are kept, one JSON line per answer
    folder = new_folder(spark, "bodies")
    vt.select("kind", "target", body.alias("body")).write.json(folder)
    raw = snap.read_reputation_bodies(spark, folder)
    broken = vt.select(
        "kind", "target",
        F.lit('{"data": {"attributes": {"last_analysis_stats": {"malicious": "many"}}}}').alias("body"),
    )
    return snap.normalise_engines(raw.unionByName(broken)).select(
        "kind", "target", "malicious_count", "total_engines", "first_submission_date",
        "creation_date", "is_malicious", F.array_join("threat_names", ",").alias("threat_names"),
    )


@query(
    "abuse_snapshot",
    _REP + "SELECT ip, abuse_confidence, country_name, isp, total_reports, is_tor,"
    " '[[18],[22,4]]' AS categories FROM ab",
)
def abuse_snapshot(spark, sf):
    ab = mail.abuse(messages(spark, sf))
    reports = F.expr(
        "array(named_struct('categories', array(18)), named_struct('categories', CAST(array() AS array<int>)),"
        " named_struct('categories', CAST(NULL AS array<int>)), named_struct('categories', array(22, 4)),"
        " named_struct('categories', CAST(NULL AS array<int>)), named_struct('categories', array(99)))"
    )
    body = F.to_json(
        F.struct(
            F.struct(
                F.col("ip").alias("ipAddress"), F.col("abuse_confidence").alias("abuseConfidenceScore"),
                F.col("country_name").alias("countryName"), "isp",
                F.col("total_reports").alias("totalReports"), F.col("is_tor").alias("isTor"),
                reports.alias("reports"),
            ).alias("data")
        )
    )
    return snap.normalise_abuse(ab.select("ip", body.alias("body"))).select(
        "ip", "abuse_confidence", "country_name", "isp", "total_reports", "is_tor",
        F.to_json("recent_report_categories").alias("categories"),
    )


@query(
    "safe_browsing_snapshot",
    _REP + "SELECT url, true AS is_threat, types AS threat_types FROM gs",
)
def safe_browsing_snapshot(spark, sf):
    matches = mail.browsing_matches(messages(spark, sf))
    raw = matches.groupBy("url").agg(
        F.to_json(
            F.struct(
                F.collect_list(
                    F.struct(
                        F.col("threat_type").alias("threatType"), F.col("platform_type").alias("platformType")
                    )
                ).alias("matches")
            )
        ).alias("body")
    )
    return snap.normalise_safe_browsing(snap.safe_browsing_matches(raw)).select(
        "url", "is_threat", F.array_join("threat_types", ",").alias("threat_types")
    )


@query(
    "malware_feed_snapshot",
    _REP + "SELECT url, in_database, threat, tags FROM fd",
)
def malware_feed_snapshot(spark, sf):
    feed = mail.malware_feed(messages(spark, sf))
    status = F.when(F.col("in_database"), "ok").otherwise("no_results")
    body = F.to_json(
        F.struct(status.alias("query_status"), "threat", F.when(F.size("tags") > 0, F.col("tags")).alias("tags"))
    )
    return snap.normalise_malware_feed(feed.select("url", body.alias("body"))).select(
        "url", "in_database", "threat", F.array_join("tags", ",").alias("tags")
    )


# --- sender history ---------------------------------------------------------


def _asked(m):
    return m.select("message_id", "mailbox_id", "sender", "thread_id", "received_at")


@query(
    "sender_history",
    _HIST + "SELECT message_id, CAST(total_threads AS INT) AS total_threads, total_threads = 0 AS is_first_time_sender,"
    " has_user_replied, CAST(spam_count AS INT) AS spam_count, CAST(trash_count AS INT) AS trash_count, true AS available FROM hs",
)
def sender_history(spark, sf):
    return hist.thread_counts(_asked(messages(spark, sf)), mail.mailbox(spark, sf)).drop("mailbox_id")


@query(
    "history_flags",
    _HIST + "SELECT message_id, total_threads = 0 AS is_first_time_sender, has_user_replied AS has_user_replied_to_sender,"
    " (spam_count + trash_count >= 3 OR (total_threads > 0 AND spam_count + trash_count >= 1"
    " AND (spam_count + trash_count) / total_threads >= 0.30)) AS sender_has_spam_history FROM hs",
)
def history_flags(spark, sf):
    m = hist.with_sender_history(_asked(messages(spark, sf)), mail.mailbox(spark, sf), recent=False)
    return ft.with_history_flags(m).select("message_id", *ft.HISTORY_FLAGS)


_THREADS = """
tl AS (SELECT d, th, max(bt) AS last_at FROM hc WHERE folder = 'inbox' AND th <> own GROUP BY ALL)"""


@query(
    "oldest_thread",
    duck.with_mail(di.HISTORY, _THREADS)
    + "SELECT CAST(d AS STRING) AS message_id, strftime(min(last_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS oldest_thread_iso_date"
    " FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY last_at DESC) AS rn FROM tl) WHERE rn <= 50 GROUP BY d",
)
def oldest_thread(spark, sf):
    found = hist.oldest_threads(_asked(messages(spark, sf)), mail.mailbox(spark, sf))
    return found.filter("oldest_thread_at IS NOT NULL").select(
        "message_id", hist.iso_utc(F.col("oldest_thread_at")).alias("oldest_thread_iso_date")
    )


@query(
    "recent_five",
    duck.with_mail(di.HISTORY)
    + """SELECT CAST(d AS STRING) AS message_id, CAST(rn - 1 AS INT) AS pos, subject, body_snippet,
      received_iso_date, has_attachments, url_count FROM (
      SELECT d, row_number() OVER (PARTITION BY d ORDER BY bt DESC, event_id DESC) AS rn, bsubject AS subject,
        substr(coalesce(body, ''), 1, 600) AS body_snippet, strftime(bt, '%Y-%m-%dT%H:%M:%S.%gZ') AS received_iso_date,
        n_attachments > 0 AS has_attachments, CAST(CASE event_id % 4 WHEN 0 THEN 2 ELSE 0 END AS INT) AS url_count
      FROM (SELECT *, row_number() OVER (PARTITION BY d, th ORDER BY bt DESC) AS tr FROM hc WHERE folder = 'inbox')
      WHERE tr = 1) WHERE rn <= 5""",
)
def recent_five(spark, sf):
    found = hist.recent_mail(_asked(messages(spark, sf)), mail.mailbox(spark, sf))
    return found.select("message_id", F.posexplode("recent").alias("pos", "r")).select(
        "message_id", "pos", "r.*"
    )


def _conversation_mail(spark, sf):
    return mail.table(spark, sf, "conversations").filter("role <> 'system'").selectExpr(
        "CAST(conv_id % 7 AS STRING) AS mailbox_id",
        "CASE role WHEN 'user' THEN 'u' || CAST(conv_id % 30 AS STRING) ELSE 'owner' END AS sender",
        "CASE role WHEN 'user' THEN 'owner' ELSE 'u' || CAST(conv_id % 30 AS STRING) END AS recipient",
        "CASE role WHEN 'user' THEN 'inbox' ELSE 'sent' END AS folder",
        "CAST(conv_id AS STRING) AS thread_id",
        "CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING) AS message_id",
        "timestamp_seconds(conv_id * 1000 + turn) AS received_at",
        "text AS body", "turn",
    )


@query(
    "latest_per_thread",
    "SELECT CAST(conv_id % 7 AS STRING) AS mailbox_id, CASE role WHEN 'user' THEN 'u' || (conv_id % 30) ELSE 'owner' END AS sender,"
    " CAST(conv_id AS STRING) AS thread_id, max(turn) AS turn, arg_max(md5(text), turn) AS body_md5 FROM conversations"
    " WHERE role <> 'system' AND turn <> 2 GROUP BY ALL",
)
def latest_per_thread(spark, sf):
    rows = _conversation_mail(spark, sf)
    opened = rows.filter("turn = 2").select("message_id")
    return hist.latest_per_thread(rows, opened).select(
        "mailbox_id", "sender", "thread_id", "turn", F.md5("body").alias("body_md5")
    )


@query(
    "replied_semi",
    "SELECT message_id FROM (SELECT conv_id || '/' || turn AS message_id, conv_id % 7 AS mb, conv_id % 30 AS s FROM conversations"
    " WHERE role = 'user') WHERE (mb, s) IN (SELECT (conv_id % 7, conv_id % 30) FROM conversations WHERE role = 'assistant')",
)
def replied_semi(spark, sf):
    return hist.from_replied_senders(_conversation_mail(spark, sf)).select("message_id")


# --- answers ----------------------------------------------------------------


@query(
    "answers_parsed",
    duck.with_mail(di.ANSWERS)
    + "SELECT message_id, CAST(ai_score AS INT) AS score, ai_category AS threat_category, findings, damage, todo, avoid, ok AS available FROM an",
)
def answers_parsed(spark, sf):
    m = messages(spark, sf)
    a = F.col("analysis")
    joined = ans.with_analysis(m.select("message_id"), ans.parse_answers(mail.raw_answers(m)))
    return joined.select(
        "message_id", a["score"].alias("score"), a["threat_category"].alias("threat_category"),
        F.array_join(a["main_findings"], "|").alias("findings"), a["potential_damage"].alias("damage"),
        F.array_join(a["do"], "|").alias("todo"), F.array_join(a["do_not"], "|").alias("avoid"),
        a["available"].alias("available"),
    )


# --- verdicts ---------------------------------------------------------------

_VERDICT = "SELECT message_id, score, risk_level, threat_category, action_taken, triggered_by FROM v"


def _verdict_columns(df):
    return df.select(
        "message_id", "score", "risk_level", "threat_category", "action_taken",
        F.array_join("triggered_by", ";").alias("triggered_by"),
    )


@query("verdicts_with_intel", _INTEL_ONLY + _VERDICT)
def verdicts_with_intel(spark, sf):
    return _verdict_columns(verdicts(messages(spark, sf), snapshots(spark, sf)))


@query("verdicts_full", FULL + _VERDICT)
def verdicts_full(spark, sf):
    return _verdict_columns(full_scored(spark, sf))


@query(
    "layer_scores_full",
    FULL + "SELECT message_id, " + ", ".join(f"CAST({n}_score AS INT) AS {n}_score" for n in sc.LAYERS)
    + ", comp AS composite_score, lim AS effective_threshold FROM v",
)
def layer_scores_full(spark, sf):
    return full_scored(spark, sf).select(
        "message_id", *[f"{n}_score" for n in sc.LAYERS], "composite_score", "effective_threshold"
    )


@query(
    "intel_evidence",
    FULL + "SELECT message_id, CAST(max_url_engines AS INT) AS max_url_engines, CAST(feed_hits AS INT) AS feed_hits,"
    " spf_fail, ai_ok AS ai_available, CASE WHEN ai_ok THEN ai_category END AS ai_category FROM v",
)
def intel_evidence(spark, sf):
    e = F.col("evidence")
    return full_scored(spark, sf).select(
        "message_id", e["threat_intel"]["max_url_engines"].alias("max_url_engines"),
        e["threat_intel"]["feed_hits"].alias("feed_hits"), e["auth"]["spf_fail"].alias("spf_fail"),
        e["claude"]["available"].alias("ai_available"), e["claude"]["threat_category"].alias("ai_category"),
    )


