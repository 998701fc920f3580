"""Explanations, findings, alerts, notices, actions and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk.functions import redact as rd
from tamarisk.operators import reports as rp
from tamarisk.operators.layout import redact_table
from tamarisk.operators.actions import pending_actions, routed_actions
from tamarisk.plans.verdicts import offline_verdicts, prompt_rows, verdicts
from workload import duck, mail
from workload import duck_intel as di
from workload.mail import messages
from workload.queries_core import _FLAG_SIGNAL_ROWS, _OFFLINE
from workload.queries_intel import _CHAINS, FULL, full_scored, snapshots
from workload.registry import query

T = duck.text

# --- all signals of the full verdict, as rows -------------------------------


def _counted(ord_, code, n, points, high, layer="threat_intel"):
    title, told = fv.INTEL_TEXTS[code]
    sub = lambda t: "replace(" + T(t.replace("%%", "%")) + f", '%s', CAST({n} AS STRING))"
    severity = f"CASE WHEN {n} >= {high} THEN 'high' ELSE 'medium' END" if high else "'medium'"
    floor = 50 if code == "ABUSEIPDB_FLAGGED" else 1
    return (
        f"SELECT d, message_id, {ord_} AS ord, 0 AS pos, '{code}' AS code, '{layer}' AS layer,"
        f" CAST({points} AS INT) AS points, {severity} AS severity, {sub(title)} AS title, {sub(told)} AS explanation"
        f" FROM v WHERE {n} >= {floor}"
    )


def _listed(ord_, code, points, tags, where):
    title, told = fv.INTEL_TEXTS[code]
    return (
        f"SELECT v.d, message_id, {ord_}, pos, '{code}', 'threat_intel', {points}, 'high', {T(title)},"
        f" replace({T(told)}, '%s', {tags}) FROM v JOIN lv ON lv.d = v.d WHERE {where}"
    )


# the flag rows number the content layer 20 and up; reputation goes before it
_FLAGS = _FLAG_SIGNAL_ROWS.replace(" FROM g WHERE ", " FROM v WHERE ")
SIGNALS = f"""
sg AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ord, sub) - 1 AS pos FROM (
  SELECT d, message_id, CASE WHEN layer = 'content' THEN 100 + ord ELSE ord END AS ord, 0 AS sub, code, layer, points,
    severity, title, explanation FROM ({_FLAGS})
  UNION ALL SELECT * FROM (
  {_counted(50, "VT_URL_FLAGGED", "max_url_engines", "least(35, max_url_engines * 5)", 5)}
  UNION ALL {_counted(51, "VT_FILE_FLAGGED", "max_file_engines", "least(40, max_file_engines * 6)", 5)}
  UNION ALL {_counted(52, "ABUSEIPDB_FLAGGED", "abuse_confidence", "least(30, abuse_confidence // 4)", 75)}
  UNION ALL {_counted(53, "VT_DOMAIN_FLAGGED", "max_domain_engines", "least(20, max_domain_engines * 4)", 0)}
  UNION ALL {_counted(54, "VT_IP_FLAGGED", "max_ip_engines", "least(20, max_ip_engines * 4)", 0)}
  UNION ALL {_listed(55, "GSB_FLAGGED", 35, "replace(types, ',', ', ')", "types IS NOT NULL")}
  UNION ALL {_listed(56, "URLHAUS_FLAGGED", 30, "CASE WHEN tags = '' THEN 'malware' ELSE replace(tags, ',', ', ') END", "in_database")}
  UNION ALL SELECT d, message_id, 200, 0, '{fv.AI_SIGNAL_CODE}', 'claude', CAST(greatest(1, claude_score // 5) AS INT),
    CASE WHEN claude_score < 35 THEN 'low' WHEN claude_score < 70 THEN 'medium' ELSE 'high' END,
    'AI analysis: ' || claude_score || '/100 (' || ai_category || ')',
    CASE WHEN findings <> '' THEN split_part(findings, '|', 1) WHEN damage <> '' THEN damage ELSE {T(fv.AI_SIGNAL_FALLBACK)} END
    FROM v WHERE ai_ok)))"""

SIGNAL_FULL = FULL.rstrip() + ",\n" + SIGNALS.strip() + "\n"


@query(
    "signals_full",
    SIGNAL_FULL + "SELECT message_id, pos, code, points, severity, title, explanation FROM sg",
)
def signals_full(spark, sf):
    from tamarisk.sources.sinks import signal_rows

    return signal_rows(full_scored(spark, sf)).select(
        "message_id", F.col("pos").cast("long").alias("pos"), "code",
        F.col("score").alias("points"), "severity", "title", "explanation",
    )


@query(
    "verdict_records",
    SIGNAL_FULL + "SELECT v.mailbox_id, v.message_id, score, score >= 35 AS alert, 35 AS threshold, coalesce(reasons, '') AS reasons,"
    " coalesce(n, 0) AS n_signals, action_taken, CASE WHEN len(trig) > 0 THEN " + T(fv.OVERRIDE_REASON)
    + " WHEN comp >= lim THEN " + T(fv.COMPOSITE_REASON) + " ELSE '' END AS quarantine_reason"
    " FROM (SELECT v.*, m.mailbox_id FROM v JOIN m ON m.d = v.d) v LEFT JOIN (SELECT d, string_agg(title, '|' ORDER BY pos) AS reasons,"
    " CAST(count(*) AS INT) AS n FROM sg GROUP BY d) r ON r.d = v.d",
)
def verdict_records(spark, sf):
    """The record as it is stored."""
    from tamarisk.sources.sinks import verdict_rows

    return verdict_rows(full_scored(spark, sf)).select(
        "mailbox_id", "message_id", "score", "alert", "threshold", F.array_join("reasons", "|").alias("reasons"),
        F.size("signals").alias("n_signals"), "quarantine_action.action_taken",
        F.col("quarantine_action.reason").alias("quarantine_reason"),
    )


_STORED = "message_id, score, risk_level, CASE WHEN score >= 35 THEN 'alert' ELSE '' END AS alert"


@query(
    "verdicts_by_day",
    f"SELECT day, count(*) AS n, sum(score) AS scores, count(*) FILTER (WHERE alert <> '') AS alerts,"
    " count(*) FILTER (WHERE ai) AS with_answer, md5(string_agg(message_id || ':' || score || ':' || risk_level, ',' ORDER BY message_id)) AS rows_md5"
    f" FROM (SELECT a.*, CAST(m.received_at AS DATE) AS day FROM (SELECT {_STORED}, true AS ai FROM ({FULL} SELECT * FROM v WHERE d % 8 <> 7)"
    f" UNION ALL SELECT {_STORED}, false FROM ({_OFFLINE} SELECT * FROM v WHERE d % 8 = 7)) a"
    " JOIN (" + duck.with_mail() + "SELECT * FROM m) m USING (message_id)) GROUP BY day",
)
def verdicts_by_day(spark, sf):
    """Offline verdicts of all messages are stored by day; those whose answers came in later are
    scored again in full and merged into their days."""
    from tamarisk.operators.lineage import new_folder
    from tamarisk.sources import sinks

    m, folder = messages(spark, sf), new_folder(spark, "verdicts")
    sinks.write_by_day(sinks.verdict_rows(offline_verdicts(m)), folder)
    answers = mail.raw_answers(m)
    answered = m.join(answers.select("message_id"), "message_id", "left_semi")
    again = verdicts(answered, snapshots(spark, sf), mail.mailbox(spark, sf), answers)
    sinks.merge_by_day(sinks.verdict_rows(again).withColumn("answered", F.lit(True)), folder)
    listed = F.sort_array(F.collect_list(F.struct("message_id", F.concat_ws(":", "message_id", "score", "risk_level").alias("t"))))
    return sinks.read_by_day(spark, folder).groupBy("day").agg(
        F.count("*").alias("n"), F.sum("score").alias("scores"), F.count_if("alert").alias("alerts"),
        F.count_if("answered").alias("with_answer"), F.md5(F.array_join(listed["t"], ",")).alias("rows_md5"),
    )


def _group_rule() -> str:
    groups: dict = {}
    for code, group in fv.SIGNAL_GROUPS.items():
        groups.setdefault(group, []).append(code)
    return ", ".join(f"bool_or({duck.one_of('code', codes)}) AS g_{g}" for g, codes in groups.items())


_N = {k: T(v) for k, v in fv.NARRATIVE.items()}
NARRATIVE = f"""
gr AS (SELECT d, {_group_rule()}, string_agg('  • ' || title || ' — ' || explanation, chr(10) ORDER BY pos) AS listed
  FROM sg GROUP BY d),
na AS (SELECT d, listed, array_to_string(list_filter([
  CASE WHEN g_attachment THEN {_N['attachment']} END,
  CASE WHEN g_url AND g_social THEN {_N['url_social']} WHEN g_url THEN {_N['url']} END,
  CASE WHEN g_identity AND g_auth THEN {_N['identity_auth']} WHEN g_identity THEN {_N['identity']} WHEN g_auth THEN {_N['auth']} END,
  CASE WHEN g_social AND NOT g_url AND NOT g_attachment THEN {_N['social_only']} END],
  lambda x: x IS NOT NULL), chr(10) || chr(10)) AS story FROM gr),
xp2 AS (SELECT v.d, v.message_id, CASE WHEN na.d IS NULL OR story = '' THEN {_N['other']} ELSE story END AS narrative,
  CASE WHEN na.d IS NULL THEN {T(fv.NO_SIGNALS_TEXT)}
  ELSE {T(fv.FINDINGS_HEADING)} || listed || {T(fv.MEANING_HEADING)} || CASE WHEN story = '' THEN {_N['other']} ELSE story END END AS told
  FROM v LEFT JOIN na ON na.d = v.d)"""
_TOLD = SIGNAL_FULL.rstrip() + ",\n" + NARRATIVE.strip() + "\n"


@query("explanations", _TOLD + "SELECT message_id, told AS user_explanation, narrative AS damage_narrative FROM xp2")
def explanations(spark, sf):
    return full_scored(spark, sf).select("message_id", "user_explanation", "damage_narrative")


def _top(rank: str) -> str:
    return SIGNAL_FULL + f"""SELECT message_id, CAST(rn - 1 AS INT) AS pos, finding FROM (
      SELECT message_id, row_number() OVER (PARTITION BY d ORDER BY {rank}, pos) AS rn,
        title || ' — ' || explanation AS finding FROM sg WHERE d NOT IN (SELECT d FROM v WHERE ai_ok AND findings <> ''))
      WHERE rn <= 5
    UNION ALL SELECT message_id, CAST(i - 1 AS INT), split_part(findings, '|', i) FROM v, range(1, 6) r(i)
      WHERE ai_ok AND findings <> '' AND i <= len(split(findings, '|'))"""


@query("top_findings", _top("CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"))
def top_findings(spark, sf):
    scored = full_scored(spark, sf)
    return scored.select("message_id", F.posexplode(rp.top_findings(scored)).alias("pos", "finding"))


@query("top_findings_observed", _top("CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 1 ELSE 2 END"))
def top_findings_observed(spark, sf):
    scored = full_scored(spark, sf)
    params = rp.RiskParams(observed_severity_order=True)
    return scored.select(
        "message_id", F.posexplode(rp.top_findings(scored, params)).alias("pos", "finding")
    )


_CATEGORY_TEXT = "CASE threat_category " + " ".join(
    f"WHEN '{c}' THEN {T('|'.join(t[:3]))}" for c, t in fv.CATEGORY_ACTIONS.items()
) + " END"


@query(
    "verdict_cards",
    FULL + f"""SELECT message_id, risk_level, score,
      CASE WHEN risk_level <> 'Safe' AND ai_ok AND damage <> '' THEN damage END AS potential_damage,
      CASE WHEN risk_level <> 'Safe' THEN CASE WHEN ai_ok THEN avoid ELSE '' END END AS what_not_to_do,
      CASE WHEN risk_level <> 'Safe' THEN CASE WHEN ai_ok THEN todo ELSE {_CATEGORY_TEXT} END END AS what_to_do,
      CASE WHEN risk_level = 'Malicious' THEN 'Moved to Trash. ' ||
        CASE WHEN len(trig) > 0 THEN {T(fv.OVERRIDE_REASON)} ELSE {T(fv.COMPOSITE_REASON)} END END AS status_line FROM v""",
)
def verdict_cards(spark, sf):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return rp.verdict_cards(full_scored(spark, sf)).select(
        "message_id", "risk_level", "score", "potential_damage", joined("what_not_to_do"),
        joined("what_to_do"), "status_line",
    )


# --- alerts and notices -----------------------------------------------------


def _l(label: str) -> str:
    return T(label.ljust(20))


def _level(texts: dict) -> str:
    return f"CASE WHEN risk_level = 'Malicious' THEN {T(texts['Malicious'])} ELSE {T(texts['Suspicious'])} END"


_NL = "chr(10)"
ALERTS = f"""
rep AS (SELECT d,
    string_agg('URL: ' || key || {_NL} || '  VirusTotal: ' || malicious_count || '/' || total_engines || ' engines' ||
      CASE WHEN n % 3 = 0 THEN {_NL} || '  VT threats: phish, kit' ELSE '' END, {_NL} ORDER BY pos) FILTER (WHERE kind = 'url') AS urls,
    string_agg('Attachment hash: ' || key || {_NL} || '  VirusTotal: ' || malicious_count || '/' || total_engines || ' engines' ||
      CASE WHEN n % 2 = 0 THEN {_NL} || '  Type: Win32 EXE' ELSE '' END, {_NL} ORDER BY pos) FILTER (WHERE kind = 'file') AS files
  FROM (SELECT lv.*, vt.n FROM lv JOIN vt ON vt.kind = lv.kind AND vt.target = lv.key) GROUP BY d),
abl AS (SELECT lv.d, 'AbuseIPDB:' || {_NL} || '  Confidence: ' || ab.abuse_confidence || '%' || {_NL} || '  Reports: ' || total_reports ||
    ' (' || distinct_reporters || ' reporters)' || coalesce({_NL} || '  Country: ' || country_name, '') || coalesce({_NL} || '  ISP: ' || isp, '') AS txt
  FROM lv JOIN ab ON lv.kind = 'ip' AND ab.ip = lv.key),
st AS (SELECT d, string_agg('- ' || title, {_NL} ORDER BY pos) AS titles FROM sg GROUP BY d),
al AS (SELECT v.message_id, m.mailbox_id, risk_level,
  '[MAIL RISK] ' || {_level(fv.ALERT_MARK)} || ' ' || upper(risk_level) || ' [' || threat_category || '] from ' ||
    coalesce(from_email, '(unknown sender)') || ' — ' || score || '/100 — ' || {_level(fv.ALERT_TAG)} AS alert_subject,
  {T(chr(10).join(fv.ALERT_HEAD) + chr(10))} || {_level({k: chr(10).join(t) for k, t in fv.ALERT_OPENING.items()})} || {_NL} || {_NL} ||
  '------ INCIDENT METADATA ------' || {_NL} || {_l('Detected at:')} || strftime(m.received_at, '%Y-%m-%dT%H:%M:%S.%gZ') || {_NL} ||
  {_l('Recipient:')} || m.mailbox_id || {_NL} || {_l('Malicious rate:')} || score || ' / 100' || {_NL} ||
  {_l('Risk Level:')} || risk_level || {_NL} || {_l('Threat Category:')} || threat_category || {_NL} ||
  {_l('Action Taken:')} || {_level(fv.ALERT_ACTION)} || {_NL} || {_NL} ||
  '------ SENDER ------' || {_NL} || {_l('From:')} || coalesce(from_email, '(unknown sender)') || {_NL} ||
  {_l('Reply-To:')} || coalesce(reply_to_email, '(none)') || {_NL} || {_l('Sender domain:')} || coalesce(m.from_domain, '') || {_NL} ||
  CASE WHEN authentication_results IS NOT NULL THEN {_l('Sender IP:')} || '203.0.113.' || (v.d % 250) || {_NL} ELSE '' END || {_NL} ||
  CASE WHEN ai_ok THEN {T(fv.ALERT_AI_HEADING)} || {_NL} || 'Main findings:' || {_NL} ||
      CASE WHEN findings <> '' THEN '  - ' || replace(findings, '|', {_NL} || '  - ') || {_NL} ELSE '' END || {_NL} ||
      CASE WHEN damage <> '' THEN 'Potential damage:' || {_NL} || '  ' || damage || {_NL} || {_NL} ELSE '' END
    ELSE {T(chr(10).join(fv.ALERT_NO_AI) + chr(10) + chr(10))} END ||
  '------ EMAIL CONTENT ------' || {_NL} || {_l('Subject:')} || coalesce(subject, '') || {_NL} || 'Body snippet:' || {_NL} ||
  substr(body_text, 1, 250) || {_NL} || {_NL} || '------ THREAT INTELLIGENCE ------' || {_NL} ||
  coalesce(urls || {_NL}, '') || coalesce(files || {_NL}, '') || coalesce(abl.txt || {_NL}, '') || {_NL} ||
  '------ SIGNALS FIRED ------' || {_NL} || coalesce(titles || {_NL}, '') || {_NL} || {T(fv.ALERT_END)} || {_NL} || {_NL} ||
  'This is an automated alert from Mail Risk Analytics.' AS alert_body
  FROM v JOIN m ON m.d = v.d LEFT JOIN rep ON rep.d = v.d LEFT JOIN abl ON abl.d = v.d LEFT JOIN st ON st.d = v.d
  WHERE risk_level <> 'Safe')"""


@query(
    "soc_alerts",
    SIGNAL_FULL.rstrip() + ",\n" + ALERTS.strip() + "\nSELECT * FROM al",
)
def soc_alerts(spark, sf):
    return rp.security_alerts(full_scored(spark, sf)).drop("recipient")


@query(
    "user_notices",
    FULL + f"""SELECT v.message_id, m.mailbox_id, {T(fv.NOTICE_SUBJECT)} || coalesce(from_email, '(unknown sender)') AS notice_subject,
      {T(fv.NOTICE_TITLE)} || {_NL} || {_NL} || 'Hi,' || {_NL} || {_NL} || {T(fv.NOTICE_OPENING)} || coalesce(from_email, '(unknown sender)') || '.' ||
      {_NL} || {_NL} || 'WHAT WE DID' || {_NL} || {T(fv.NOTICE_ACTION)} || {_NL} || {_NL} || 'WHY WE FLAGGED IT' || {_NL} ||
      CASE WHEN ai_ok AND findings <> '' THEN split_part(findings, '|', 1) ELSE {T(fv.NOTICE_DEFAULT_REASON)} END || {_NL} || {_NL} ||
      CASE WHEN ai_ok AND damage <> '' THEN 'WHAT COULD HAVE HAPPENED' || {_NL} || damage || {_NL} || {_NL} ELSE '' END ||
      'WHAT YOU SHOULD DO' || {_NL} || {T(chr(10).join(fv.NOTICE_ADVICE))} || {_NL} || {_NL} ||
      'Your SOC team (soc@example.com) has been notified with full incident details.' || {_NL} || {_NL} || '— Mail Risk Analytics' AS notice_body
      FROM v JOIN m ON m.d = v.d WHERE risk_level = 'Malicious'""",
)
def user_notices(spark, sf):
    return rp.recipient_notices(full_scored(spark, sf))


@query(
    "action_routing",
    FULL + "SELECT risk_level, risk_level = 'Malicious' AS move_to_trash, risk_level <> 'Safe' AS send_alert,"
    " risk_level = 'Malicious' AS send_notice, count(*) AS n FROM v GROUP BY ALL",
)
def action_routing(spark, sf):
    return (
        routed_actions(full_scored(spark, sf))
        .groupBy("risk_level", "move_to_trash", "send_alert", "send_notice")
        .agg(F.count("*").alias("n"))
    )


@query("mailbox_actions", FULL + ", " + di.ACTIONS + "SELECT message_id, risk_level, worst_before, risk_level = 'Malicious' AS move_to_trash FROM act")
def mailbox_actions(spark, sf):
    return pending_actions(full_scored(spark, sf), mail.mailbox(spark, sf)).select(
        "message_id", "risk_level", "worst_before", "move_to_trash"
    )


# --- rows that do not parse ------------------------------------------------------


@query(
    "quarantined_messages",
    """SELECT reason, count(*) AS n, CAST(sum(d) AS BIGINT) AS ids FROM (SELECT doc_id AS d,
      CASE WHEN doc_id % 7 = 3 OR doc_id % 11 = 5 THEN 'does not fit the schema' WHEN doc_id % 13 = 4 THEN 'no message_id' ELSE 'good' END AS reason
      FROM documents) GROUP BY reason""",
)
def quarantined_messages(spark, sf):
    """All messages as JSON lines, some cut off, some with a wrong type, some without an id."""
    from tamarisk.operators.lineage import new_folder
    from tamarisk.sources.quarantine import read_checked_messages

    folder = new_folder(spark, "lines")
    m = messages(spark, sf).withColumn("message_id", F.expr("CASE WHEN d % 13 <> 4 THEN message_id END"))
    line = F.to_json(F.struct(*[c for c in m.columns if c != "d"], F.col("d").cast("string").alias("return_path")))
    wrong = F.regexp_replace(line, '"received_at":"[^"]*"', '"received_at":["soon"]')
    cut = F.concat(F.lit('{"return_path":"'), F.col("d"), F.lit('","subject":"cut'))
    m.select(F.when(F.col("d") % 7 == 3, cut).when(F.col("d") % 11 == 5, wrong).otherwise(line).alias("value")).write.text(folder)
    found = read_checked_messages(spark, folder)
    number = lambda c: F.regexp_extract(c, '"return_path":"([0-9]+)"', 1).cast("long")
    bad = found.bad.select("reason", number(F.col("raw")).alias("d"))
    good = found.good.select(F.lit("good").alias("reason"), F.col("return_path").cast("long").alias("d"))
    return good.unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"), F.sum("d").alias("ids"))


@query(
    "quarantined_answers",
    "SELECT CASE d % 8 WHEN 6 THEN 'not JSON' ELSE 'good' END AS reason, count(*) AS n FROM (SELECT doc_id AS d FROM documents) WHERE d % 8 <> 7 GROUP BY 1",
)
def quarantined_answers(spark, sf):
    from tamarisk.sources.quarantine import check_answers

    found = check_answers(mail.raw_answers(messages(spark, sf)))
    both = found.good.select(F.lit("good").alias("reason")).unionByName(found.bad.select("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"))


# --- redaction ---------------------------------------------------------------

# fixed values: personal data put into the texts
_INJECTED = """text || CASE doc_id % 10 WHEN 1 THEN ' pay GB29 NWBK 6016 1331 9268 19 now'
 WHEN 2 THEN ' id 123-45-6789 end' WHEN 3 THEN ' https://x.example/?tok=' || 'Ab0_' || repeat('xyz-', 9) || '&a=1'
 WHEN 4 THEN ' call +1 (555) 123-4567 or 12345 6' ELSE '' END"""


# fixed values below: the patterns that are redacted
def duck_redact(source: str) -> str:
    """CTEs ``r0(k, t)`` -> ``rx(k, t)``."""
    chain = "t"
    for pattern, mark in (
        (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
        (r"\b[A-Z]{2}\d{2}[\sA-Z0-9]{10,30}\b", "[IBAN]"),
        (r"\b\d{3}-\d{2}-\d{4}\b", "[ID_NUMBER]"),
        (r"\b(?:\d[ -]*?){13,19}\b", "[CARD]"),
        (r"([?&][^=&\s]+=)([A-Za-z0-9_\-]{32,})", r"\1[TOKEN]"),
    ):
        chain = f"regexp_replace({chain}, '{pattern}', '{mark}', 'g')"
    phone = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3}[\s.-]?\d{3,4}[\s.-]?\d{0,4}"
    return f"""r0 AS ({source}), r1 AS (SELECT k, {chain} AS t FROM r0),
r2 AS (SELECT k, regexp_split_to_array(t, '{phone}') AS s, regexp_extract_all(t, '{phone}', 0) AS x FROM r1),
rx AS (SELECT k, array_to_string(list_transform(range(1, len(s) + 1), lambda i: s[i] || coalesce(
  CASE WHEN length(regexp_replace(x[i], '\\D', '', 'g')) BETWEEN 7 AND 15 THEN '[PHONE]' ELSE x[i] END, '')), '') AS t FROM r2)"""


@query(
    "redact_documents",
    "WITH " + duck_redact(f"SELECT doc_id AS k, {_INJECTED} AS t FROM documents")
    + " SELECT k AS doc_id, md5(t) AS redacted_md5, length(t) AS n FROM rx",
)
def redact_documents(spark, sf):
    docs = mail.table(spark, sf, "documents").selectExpr("doc_id", f"{_INJECTED} AS text")
    return redact_table(docs, ["text"]).select(
        "doc_id", F.md5("text").alias("redacted_md5"), F.length("text").cast("long").alias("n")
    )


@query(
    "pii_counts",
    "WITH " + duck_redact(f"SELECT doc_id AS k, {_INJECTED} AS t FROM documents")
    + " SELECT lang, "
    + ", ".join(
        f"CAST(sum((length(t) - length(replace(t, '[{m}]', ''))) // {len(m) + 2}) AS BIGINT) AS {m.lower()}"
        for m in ("EMAIL", "IBAN", "ID_NUMBER", "CARD", "TOKEN", "PHONE")
    )
    + " FROM rx JOIN documents ON doc_id = k GROUP BY lang",
)
def pii_counts(spark, sf):
    docs = mail.table(spark, sf, "documents").selectExpr("lang", f"{_INJECTED} AS text")
    clean = redact_table(docs, ["text"])
    times = lambda m: F.sum(F.regexp_count("text", F.lit(rf"\[{m}\]")))
    return clean.groupBy("lang").agg(
        *[times(m).alias(m.lower()) for m in ("EMAIL", "IBAN", "ID_NUMBER", "CARD", "TOKEN", "PHONE")]
    )


@query(
    "sender_redacted",
    duck.with_mail() + "SELECT message_id, regexp_replace(from_email, '^.*@', '[REDACTED]@') AS sender FROM m",
)
def sender_redacted(spark, sf):
    return messages(spark, sf).select(
        "message_id", rd.redact_local_part(F.col("from_email")).alias("sender")
    )


@query(
    "redact_turns",
    "WITH " + duck_redact("SELECT conv_id || '/' || turn AS k, text || ' t' || turn AS t FROM conversations WHERE text <> ''")
    + " SELECT k AS turn_key, md5(t) AS redacted_md5 FROM rx",
)
def redact_turns(spark, sf):
    turns = mail.table(spark, sf, "conversations").filter("text <> ''").selectExpr(
        "conv_id || '/' || turn AS turn_key",
        "array(text || ' t' || CAST(turn AS STRING), CAST(NULL AS STRING), '') AS texts",
    )
    return turns.select("turn_key", F.explode(rd.redact_each(F.col("texts"))).alias("t")).select(
        "turn_key", F.md5("t").alias("redacted_md5")
    )


# --- prompts ------------------------------------------------------------------

_FINDINGS = "list_filter([" + ", ".join(
    f"CASE WHEN {flag} THEN {T(t)} END" for flag, t in fv.PROMPT_FINDINGS
) + "], lambda x: x IS NOT NULL)"
_YES = lambda c: f"CASE WHEN {c} THEN 'yes' ELSE 'no' END"
_STATE = lambda c: f"CASE WHEN {c} THEN 'fail' ELSE 'pass/unknown' END"
_H = {k: T(v) for k, v in fv.PROMPT_HEADINGS.items()}

PROMPTS = f"""
tl AS (SELECT d, th, max(bt) AS last_at FROM hc WHERE folder = 'inbox' AND th <> own GROUP BY ALL),
ot AS (SELECT d, strftime(min(last_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM
  (SELECT *, row_number() OVER (PARTITION BY d ORDER BY last_at DESC) AS rn FROM tl) WHERE rn <= 50 GROUP BY d),
rc AS (SELECT d, string_agg('Prior email #' || rn || ':' || {_NL} || '  Received: ' || iso || {_NL} || '  Subject: ' || bsubject ||
    CASE WHEN body <> '' THEN {_NL} || '  Body snippet:' || {_NL} || '    ' || body ELSE '' END ||
    CASE WHEN n_attachments > 0 THEN {_NL} || '  Had attachments: yes' ELSE '' END ||
    CASE WHEN event_id % 4 = 0 THEN {_NL} || '  URLs in body: 2' ELSE '' END, {_NL} || {_NL} ORDER BY rn) AS txt
  FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY bt DESC, event_id DESC) AS rn, strftime(bt, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso
    FROM (SELECT *, row_number() OVER (PARTITION BY d, th ORDER BY bt DESC) AS tr FROM hc WHERE folder = 'inbox') WHERE tr = 1)
  WHERE rn <= 5 GROUP BY d),
ib AS (SELECT lk.d, 'IP: ' || ab.ip || {_NL} || 'Abuse confidence: ' || ab.abuse_confidence || '/100' || {_NL} ||
    'Total abuse reports: ' || total_reports || {_NL} || 'Distinct reporters: ' || distinct_reporters || {_NL} ||
    'Country: ' || coalesce(country_name, country_code, 'unknown') || {_NL} || 'ISP: ' || coalesce(isp, 'unknown') || {_NL} ||
    'Usage type: ' || coalesce(usage_type, 'unknown') || coalesce({_NL} || 'Last reported: ' || last_reported_at, '') ||
    CASE WHEN is_tor THEN {_NL} || 'Tor exit node: yes' ELSE '' END || CASE WHEN is_whitelisted THEN {_NL} || 'Whitelisted: yes' ELSE '' END AS txt
  FROM lk JOIN ab ON lk.kind = 'ip' AND ab.ip = lk.key),
rb AS (SELECT d,
    CASE WHEN count(types) > 0 THEN string_agg('Google Safe Browsing: FLAGGED — ' || key || ' (' ||
      CASE WHEN types = '' THEN 'threat' ELSE replace(types, ',', ', ') END || ')', {_NL} ORDER BY pos) FILTER (WHERE types IS NOT NULL)
      ELSE {T(fv.PROMPT_GSB_CLEAN)} END || {_NL} ||
    CASE WHEN count(*) FILTER (WHERE in_database) > 0 THEN string_agg('URLhaus: MALWARE DISTRIBUTION — ' || key || ' (tags: ' ||
      CASE WHEN tags = '' THEN 'malware' ELSE replace(tags, ',', ', ') END || ')', {_NL} ORDER BY pos) FILTER (WHERE in_database)
      ELSE {T(fv.PROMPT_FEED_CLEAN)} END AS txt FROM lv WHERE kind = 'url' GROUP BY d),
us AS (SELECT lk.d, lk.key, vt.*, xp.*, row_number() OVER (PARTITION BY lk.d ORDER BY lk.key) AS rn
  FROM lk JOIN mu ON mu.d = lk.d AND mu.pos = lk.pos LEFT JOIN vt ON vt.kind = 'url' AND vt.target = lk.key
  LEFT JOIN xp ON xp.original_url = lk.key AND mu.domain IN ('bit.ly', 't.co')
  WHERE lk.kind = 'url' AND (vt.target IS NOT NULL OR xp.original_url IS NOT NULL)),
ub AS (SELECT d, string_agg('URL #' || rn || ':' || {_NL} || '  Original: ' || key ||
    CASE WHEN expanded AND final_url <> key THEN {_NL} || '  Expanded to: ' || final_url || ' (' || redirect_count || ' redirects)'
      WHEN error IS NOT NULL THEN {_NL} || '  Expansion: failed (' || error || ')' ELSE '' END ||
    CASE WHEN target IS NULL THEN {_NL} || '  VirusTotal: not found in database' ELSE
      {_NL} || '  VirusTotal: ' || malicious_count || '/' || total_engines || ' engines flagged as malicious' ||
      CASE WHEN coalesce(first_submission_date, 0) <> 0 THEN {_NL} || '  VT first seen (epoch): ' || first_submission_date ELSE '' END ||
      CASE WHEN n % 3 = 0 THEN {_NL} || '  VT threat names: phish, kit' ELSE '' END ||
      CASE WHEN n % 4 = 0 THEN {_NL} || '  VT categories: A: news, B: ads, C: spam' ELSE '' END END, {_NL} || {_NL} ORDER BY rn) AS txt
  FROM us GROUP BY d),
tb AS (SELECT ma.d, string_agg('Attachment #' || pos || ':' || {_NL} || '  Filename: ' || filename || {_NL} || '  MIME type: ' || mime_type ||
    {_NL} || '  Size: ' || size || ' bytes' || CASE WHEN sha256 IS NULL THEN {_NL} || '  SHA-256: (not provided by client)' ELSE
      {_NL} || '  SHA-256: ' || sha256 || CASE WHEN vt.target IS NULL OR pos > 3 THEN {_NL} || '  VirusTotal: hash not found in database' ELSE
      {_NL} || '  VirusTotal: ' || malicious_count || '/' || total_engines || ' engines flagged' ||
      CASE WHEN n % 2 = 0 THEN {_NL} || '  VT type description: Win32 EXE' ELSE '' END ||
      CASE WHEN coalesce(first_submission_date, 0) <> 0 THEN {_NL} || '  VT first seen (epoch): ' || first_submission_date ELSE '' END ||
      CASE WHEN n % 3 = 0 THEN {_NL} || '  VT threat label: trojan.x' ELSE '' END END END, {_NL} || {_NL} ORDER BY pos) AS txt
  FROM ma LEFT JOIN vt ON vt.kind = 'file' AND vt.target = sha256 GROUP BY ma.d),
pr AS (SELECT m.message_id,
  {_H['metadata']} || {_NL} || 'Subject: ' || coalesce(subject, '(empty)') || {_NL} || 'From display name: ' ||
  coalesce(nullif(trim(regexp_extract(from_email, '^"?([^"<]*)"?[ ]*<', 1)), ''), '(empty)') || {_NL} ||
  'From email: ' || coalesce(regexp_replace(from_email, '^.*@', '[REDACTED]@'), '(empty)') || {_NL} ||
  'From domain: ' || coalesce(m.from_domain, '(empty)') || {_NL} || 'Reply-To domain: ' || coalesce(reply_to_domain, '(none)') || {_NL} ||
  'Authentication: SPF=' || {_STATE('spf_fail')} || ', DKIM=' || {_STATE('dkim_fail')} || ', DMARC=' || {_STATE('dmarc_fail')} || {_NL} || {_NL} AS p1,
  {_H['history']} || {_NL} || 'Total prior threads from this sender in recipient''s mailbox: ' || total_threads || {_NL} ||
  'First-time sender: ' || {_YES('total_threads = 0')} || {_NL} || 'Recipient has previously replied to this sender: ' || {_YES('has_user_replied')} || {_NL} ||
  'Prior threads from this sender currently in Spam: ' || spam_count || {_NL} || 'Prior threads from this sender currently in Trash: ' || trash_count ||
  coalesce({_NL} || 'Oldest known thread from this sender: ' || ot.iso, '') || {_NL} || {_NL} AS p2,
  {_H['recent']} || {_NL} || coalesce(rc.txt, {T(fv.PROMPT_NO_RECENT)}) || {_NL} || {_NL} AS p3,
  {_H['ip']} || {_NL} || coalesce(ib.txt, {T(fv.PROMPT_NO_IP)}) || {_NL} || {_NL} AS p4,
  {_H['findings']} || {_NL} || CASE WHEN len({_FINDINGS}) > 0 THEN array_to_string({_FINDINGS}, {_NL}) ELSE '- (none)' END || {_NL} || {_NL} AS p5,
  {_H['content']} || {_NL} || CASE WHEN length(rx.t) > 3000 THEN substr(rx.t, 1, 3000) || {T(fv.PROMPT_BODY_CUT)} WHEN rx.t = '' THEN '(empty body)' ELSE rx.t END || {_NL} ||
  {_H['content_end']} || {_NL} || {_NL} AS p6,
  {_H['urls']} || {_NL} || coalesce(ub.txt, '(no URLs)') || {_NL} || {_NL} AS p7,
  {_H['reputation']} || {_NL} || coalesce(rb.txt, '(no reputation data available)') || {_NL} || {_NL} AS p8,
  {_H['attachments']} || {_NL} || coalesce(tb.txt, '(no attachments)') || {_NL} || {_NL} || {_H['task']} || {_NL} || {T(fv.PROMPT_TASK)} AS p9
  FROM m JOIN f ON f.d = m.d JOIN hs ON hs.d = m.d JOIN rx ON rx.k = m.d LEFT JOIN ot ON ot.d = m.d LEFT JOIN rc ON rc.d = m.d
  LEFT JOIN ib ON ib.d = m.d LEFT JOIN rb ON rb.d = m.d LEFT JOIN ub ON ub.d = m.d LEFT JOIN tb ON tb.d = m.d)"""

_PROMPT_SQL = duck.with_mail(
    duck.FEATURES, di.REPUTATION, di.HISTORY, _CHAINS, duck_redact("SELECT d AS k, body_text AS t FROM m"), PROMPTS
)


def _prompts(spark, sf):
    return prompt_rows(
        messages(spark, sf), snapshots(spark, sf, expanded=True), mail.mailbox(spark, sf)
    )


@query("prompts", _PROMPT_SQL + "SELECT message_id, p1||p2||p3||p4||p5||p6||p7||p8||p9 AS prompt FROM pr")
def prompts(spark, sf):
    return _prompts(spark, sf)
