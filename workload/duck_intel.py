"""DuckDB building blocks: reputation, history, answers and the full verdict."""

from __future__ import annotations

from workload import mail

_ENGINE_COLS = ", ".join(f"{sql} AS {c}" for c, sql in mail.ENGINE_RULES.items())
_ABUSE_COLS = ", ".join(f"{sql} AS {c}" for c, sql in mail.ABUSE_RULES.items())

REPUTATION = f"""
ek AS (SELECT kind, target, min(d) AS n FROM (
    SELECT 'url' AS kind, url AS target, d FROM mu
    UNION ALL SELECT 'file', sha256, d FROM ma WHERE sha256 IS NOT NULL
    UNION ALL SELECT 'domain', from_domain, d FROM m WHERE from_domain IS NOT NULL
    UNION ALL SELECT 'ip', '203.0.113.' || (d % 250), d FROM m WHERE authentication_results IS NOT NULL)
  GROUP BY ALL),
vt AS (SELECT kind, target, n, {_ENGINE_COLS} FROM ek WHERE {mail.ENGINE_KEPT}),
ab AS (SELECT DISTINCT '203.0.113.' || n AS ip, {_ABUSE_COLS} FROM
    (SELECT DISTINCT d % 250 AS n FROM m WHERE authentication_results IS NOT NULL) WHERE {mail.ABUSE_KEPT}),
gs AS (SELECT target AS url, CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'MALWARE' ELSE 'MALWARE,SOCIAL_ENGINEERING' END AS types
  FROM ek WHERE kind = 'url' AND n % 5 = 0),
fd AS (SELECT target AS url, n % 7 = 0 AS in_database,
  CASE WHEN n % 7 = 0 AND n % 2 = 1 THEN 'malware_download' END AS threat,
  CASE WHEN n % 7 <> 0 OR n % 3 = 0 THEN '' WHEN n % 3 = 1 THEN 'exe' ELSE 'exe,zip' END AS tags
  FROM ek WHERE kind = 'url' AND n % 7 <= 1),
lk AS (SELECT d, 'url' AS kind, pos, url AS key FROM mu WHERE pos <= 5
  UNION ALL SELECT d, 'file', pos, sha256 FROM ma WHERE pos <= 3 AND sha256 IS NOT NULL
  UNION ALL SELECT d, 'domain', 1, from_domain FROM m WHERE from_domain IS NOT NULL
  UNION ALL SELECT d, 'ip', 1, '203.0.113.' || (d % 250) FROM m WHERE authentication_results IS NOT NULL),
lv AS (SELECT lk.d, lk.kind, pos, key, malicious_count, total_engines, first_submission_date, creation_date,
    abuse_confidence, gs.types, fd.in_database, fd.threat, fd.tags, m.received_at
  FROM lk JOIN m ON m.d = lk.d LEFT JOIN vt ON vt.kind = lk.kind AND vt.target = key
  LEFT JOIN ab ON lk.kind = 'ip' AND ab.ip = key
  LEFT JOIN gs ON lk.kind = 'url' AND gs.url = key LEFT JOIN fd ON lk.kind = 'url' AND fd.url = key),
im AS (SELECT d,
  max(coalesce(malicious_count, 0)) FILTER (WHERE kind = 'url') AS url_n,
  max(coalesce(malicious_count, 0)) FILTER (WHERE kind = 'file') AS file_n,
  max(coalesce(malicious_count, 0)) FILTER (WHERE kind = 'domain') AS dom_n,
  max(coalesce(malicious_count, 0)) FILTER (WHERE kind = 'ip') AS ip_n,
  max(abuse_confidence) AS conf, count(types) AS gsb_n, count(*) FILTER (WHERE in_database) AS feed_n,
  bool_or(kind = 'domain' AND coalesce(creation_date, 0) <> 0
    AND floor((epoch(received_at) - creation_date) / 86400) <= 30) AS young,
  bool_or(kind = 'file' AND coalesce(first_submission_date, 0) <> 0
    AND (epoch(received_at) - first_submission_date) / 3600 <= 72) AS fresh FROM lv GROUP BY d),
pt AS (SELECT d, list(t ORDER BY grp, pos) AS proven FROM (
    SELECT d, pos, CASE kind WHEN 'url' THEN 1 WHEN 'file' THEN 2 ELSE 3 END AS grp,
      'VT_' || upper(kind) || '_FLAGGED:' || malicious_count || '_engines' AS t
      FROM lv WHERE kind <> 'ip' AND malicious_count >= 5
    UNION ALL SELECT d, pos, 4, 'ABUSEIPDB_FLAGGED:' || abuse_confidence || '%' FROM lv WHERE abuse_confidence >= 75
    UNION ALL SELECT d, pos, 5, 'GSB_FLAGGED:' || CASE WHEN types = '' THEN 'threat' ELSE types END FROM lv WHERE types IS NOT NULL
    UNION ALL SELECT d, pos, 6, 'URLHAUS_FLAGGED:' || coalesce(threat, 'malware') FROM lv WHERE in_database)
  GROUP BY d)"""

_V = f"(SELECT unnest([{mail.VERSIONS}]) AS v)"


def _fetched(key: str) -> str:
    return f"TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST({mail.fetched_hours(key)} AS INTEGER)) AS fetched_at"


# the same with snapshots that hold several dated records of a key
_LOOKUPS, _GATHERED = REPUTATION.split("lv AS (")
DATED = (
    _LOOKUPS
    + f"""vtd AS (SELECT kind, target, {mail.later('malicious_count', 3, 8)} AS malicious_count, total_engines,
    first_submission_date, creation_date, {_fetched('target')} FROM vt, {_V}),
abd AS (SELECT 'ip' AS kind, ip, {mail.later('abuse_confidence', 31, 101)} AS abuse_confidence, country_name, total_reports,
    {_fetched('ip')} FROM ab, {_V}),
gsd AS (SELECT 'url' AS kind, url, CASE WHEN v = 1 THEN 'MALWARE' ELSE types END AS types, {_fetched('url')} FROM gs, {_V}),
fdd AS (SELECT 'url' AS kind, url, in_database AND v <> 1 AS in_database, threat, tags, {_fetched('url')} FROM fd, {_V}),
lv AS (SELECT lk.d, lk.kind, pos, key, malicious_count, total_engines, first_submission_date, creation_date,
    abuse_confidence, country_name, total_reports, gs.types, fd.in_database, fd.threat, fd.tags, m.received_at
  FROM lk JOIN m ON m.d = lk.d
  ASOF LEFT JOIN vtd vt ON vt.kind = lk.kind AND vt.target = key AND m.received_at >= vt.fetched_at
  ASOF LEFT JOIN abd ab ON ab.kind = lk.kind AND ab.ip = key AND m.received_at >= ab.fetched_at
  ASOF LEFT JOIN gsd gs ON gs.kind = lk.kind AND gs.url = key AND m.received_at >= gs.fetched_at
  ASOF LEFT JOIN fdd fd ON fd.kind = lk.kind AND fd.url = key AND m.received_at >= fd.fetched_at),
im AS ("""
    + _GATHERED.split("im AS (", 1)[1]
)

_BOX = ", ".join(f"{sql} AS {c}" for c, sql in mail.MAILBOX.items())
HISTORY = f"""
bx AS (SELECT {_BOX}, event_id FROM events),
hc AS (SELECT m.d, m.message_id, m.mailbox_id, m.sender, m.received_at, m.thread_id AS own, b.folder, b.thread_id AS th, b.received_at AS bt,
    b.subject AS bsubject, b.body, b.n_attachments, b.event_id
  FROM m JOIN bx b ON b.mailbox_id = m.mailbox_id
    AND CASE WHEN b.folder = 'sent' THEN b.recipient ELSE b.sender END = m.sender AND b.received_at < m.received_at),
hs AS (SELECT m.d, m.message_id,
  least(50, count(DISTINCT th) FILTER (WHERE folder = 'inbox' AND th <> m.thread_id)) AS total_threads,
  least(50, count(DISTINCT th) FILTER (WHERE folder = 'spam' AND th <> m.thread_id)) AS spam_count,
  least(50, count(DISTINCT th) FILTER (WHERE folder = 'trash' AND th <> m.thread_id)) AS trash_count,
  count(*) FILTER (WHERE folder = 'sent') > 0 AS has_user_replied
  FROM m LEFT JOIN hc ON hc.d = m.d GROUP BY m.d, m.message_id)"""

ANSWERS = """
an AS (SELECT d, message_id, d % 8 < 6 AS ok,
  CASE d % 8 WHEN 0 THEN d % 101 WHEN 1 THEN 40 WHEN 2 THEN 87 WHEN 3 THEN 0 WHEN 4 THEN 100 WHEN 5 THEN 55 ELSE 0 END AS ai_score,
  CASE d % 8 WHEN 0 THEN 'PHISHING' WHEN 1 THEN 'BEC' WHEN 2 THEN 'IMPERSONATION' WHEN 3 THEN 'SAFE' WHEN 4 THEN 'SUSPICIOUS'
    WHEN 5 THEN 'PHISHING' ELSE 'SAFE' END AS ai_category,
  CASE d % 8 WHEN 0 THEN 'f1|f2' WHEN 2 THEN 'only' WHEN 5 THEN
    CASE d % 3 WHEN 0 THEN '' WHEN 1 THEN '1|2|3|4|5' ELSE 'z|True|7' END ELSE '' END AS findings,
  CASE d % 8 WHEN 0 THEN 'loss' WHEN 4 THEN 'harm' ELSE '' END AS damage,
  CASE d % 8 WHEN 0 THEN 'a|b|c' ELSE '' END AS todo, CASE d % 8 WHEN 0 THEN 'x' ELSE '' END AS avoid FROM m)"""

FULL_G = """
g AS (SELECT f.*, hs.total_threads = 0 AS is_first_time_sender, hs.has_user_replied AS has_user_replied_to_sender,
  (spam_count + trash_count >= 3 OR (total_threads > 0 AND spam_count + trash_count >= 1
    AND (spam_count + trash_count) / total_threads >= 0.30)) AS sender_has_spam_history,
  coalesce(young, false) AS domain_recently_registered, coalesce(fresh, false) AS recently_seen_attachment,
  coalesce(url_n, 0) AS max_url_engines, coalesce(file_n, 0) AS max_file_engines, coalesce(conf, 0) AS abuse_confidence,
  coalesce(dom_n, 0) AS max_domain_engines, coalesce(ip_n, 0) AS max_ip_engines,
  coalesce(gsb_n, 0) AS gsb_threats, coalesce(feed_n, 0) AS feed_hits,
  coalesce(proven, CAST([] AS VARCHAR[])) AS proven, an.ok AS ai_ok, an.ai_score, an.ai_category, 1.0 AS tc,
  an.findings, an.damage, an.todo, an.avoid
  FROM f JOIN hs ON hs.d = f.d JOIN an ON an.d = f.d LEFT JOIN im ON im.d = f.d LEFT JOIN pt ON pt.d = f.d)"""

# what a thread's place is before each message that is not Safe; over ``v`` and ``m``
ACTIONS = f"""
te AS (SELECT mailbox_id, thread_id, received_at AS seen_at, 0 AS turn, message_id AS tie, folder IN ('spam', 'trash') AS q,
    0 AS level, NULL AS message_id, NULL AS risk_level FROM (SELECT {_BOX} FROM events) WHERE folder <> 'sent'
  UNION ALL SELECT m.mailbox_id, m.thread_id, m.received_at, 1, m.message_id, CASE WHEN risk_level = 'Malicious' THEN true END,
    CASE risk_level WHEN 'Malicious' THEN 2 WHEN 'Suspicious' THEN 1 ELSE 0 END, m.message_id, risk_level FROM v JOIN m ON m.d = v.d),
ts AS (SELECT *, last_value(q IGNORE NULLS) OVER w AS placed, max(level) OVER w AS worst FROM te
  WINDOW w AS (PARTITION BY mailbox_id, thread_id ORDER BY seen_at, turn, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
act AS (SELECT mailbox_id, thread_id, message_id, risk_level,
    CASE worst WHEN 2 THEN 'Malicious' WHEN 1 THEN 'Suspicious' ELSE 'Safe' END AS worst_before
  FROM ts WHERE turn = 1 AND level > 0 AND NOT coalesce(placed, false))
"""
