"""Mail tables as deterministic projections of the test tables.

The test tables hold no e-mail.  Each mail table is described once, as SQL text
that both Spark and DuckDB read, so that a query and its SQL twin start from
the same rows.  The tables grow with ``documents`` and ``events``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk import schemas

# --- messages <- documents -------------------------------------------------

FROM_EMAIL = """CASE d % 10
 WHEN 0 THEN 'PayPal Security <alerts@gmail.com>'
 WHEN 1 THEN 'Alice <alice@partner.example.com>'
 WHEN 2 THEN 'IT Team <helpdesk@yahoo.com>'
 WHEN 3 THEN '"ceo@company.com" <x@gmail.com>'
 WHEN 4 THEN 'Microsoft <no-reply@mail.microsoft.com>'
 WHEN 5 THEN 'Billing <a@xn--pypal-7vc.com>'
 WHEN 6 THEN 'Promo <p@deals.xyz>'
 WHEN 7 THEN 'Support <s@login-verify.net>'
 WHEN 8 THEN 'Bob <bob@google.com>'
 ELSE NULL END"""

FROM_DOMAIN = """CASE d % 10
 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'partner.example.com' WHEN 2 THEN 'yahoo.com'
 WHEN 3 THEN 'gmail.com' WHEN 4 THEN 'mail.microsoft.com' WHEN 5 THEN 'xn--pypal-7vc.com'
 WHEN 6 THEN 'deals.xyz' WHEN 7 THEN 'login-verify.net' WHEN 8 THEN 'google.com'
 ELSE NULL END"""

_IPS = "' client-ip=10.0.0.1 relay=203.0.113.' || CAST(d % 250 AS STRING)"

SCALARS = {
    "message_id": "CAST(d AS STRING)",
    "mailbox_id": "CAST((d % 200) % 20 AS STRING)",
    # threads of the mailbox below, each with several messages
    "thread_id": "CAST(d % 200 AS STRING) || '-' || CAST(CAST(floor(d / 200) AS BIGINT) % 3 AS STRING)",
    "sender": "CAST(d % 200 AS STRING)",
    "subject": """CASE d % 6
 WHEN 0 THEN 'Urgent: action required' WHEN 1 THEN 'Invoice for payment'
 WHEN 2 THEN 'Your verification' WHEN 3 THEN 'Dear customer' WHEN 4 THEN 'דחוף'
 ELSE NULL END""",
    "from_email": FROM_EMAIL,
    "from_domain": FROM_DOMAIN,
    "reply_to_email": f"CASE WHEN d % 4 = 0 THEN 'Desk <desk@other.example>' ELSE {FROM_EMAIL} END",
    "reply_to_domain": f"CASE WHEN d % 4 = 0 THEN 'other.example' ELSE {FROM_DOMAIN} END",
    "authentication_results": f"""CASE d % 7
 WHEN 0 THEN 'spf=fail dkim=fail dmarc=fail' || {_IPS}
 WHEN 1 THEN 'spf=pass dkim=pass dmarc=fail' || {_IPS}
 WHEN 2 THEN 'spf=fail dkim=fail dmarc=pass' || {_IPS}
 WHEN 3 THEN 'SPF = Fail dkim=pass dmarc=pass' || {_IPS}
 WHEN 4 THEN 'spf=softfail dkim=failed dmarc=none' || {_IPS}
 WHEN 5 THEN 'spf=pass dkim=pass dmarc=pass' || {_IPS}
 ELSE NULL END""",
    "body_text": "CASE WHEN d % 6 = 2 THEN 'code ' || text ELSE text END",
    "body_html": """CASE d % 5
 WHEN 0 THEN '<p>Dear</p> user <style>otp</style>' WHEN 1 THEN '<b>refund</b> &amp; more'
 ELSE NULL END""",
}

_S = "CAST({} AS STRING)"
# d % 9 -> [(url, domain, visible text)] as SQL expressions
URL_CASES = {
    0: [("'https://bit.ly/fake-login'", "'bit.ly'", "NULL")],
    1: [("'https://evil.example.ru/p?m=' || CAST(d % 1000 AS STRING)", "'evil.example.ru'", "'paypal.com'")],
    2: [("'https://www.paypal.com/x'", "'www.paypal.com'", "'paypal.com'")],
    3: [("'https://a.example/update-payment?m=' || CAST(d % 700 AS STRING)", "'a.example'", "NULL")],
    4: [],
    5: [
        (f"'https://cdn{k}.example.net/f/' || CAST(d % 500 AS STRING)", f"'cdn{k}.example.net'", "NULL")
        for k in range(1, 7)
    ],
    6: [("'https://news.example.org/a/' || CAST(d % 300 AS STRING)", "'news.example.org'", "'Click here'")],
    7: [("'https://nodomain.example/z'", "NULL", "'paypal.com'")],
    8: [("'https://t.co/q' || CAST(d % 200 AS STRING)", "'t.co'", "'see Example.COM. now'")],
}
# d % 11 -> [(file name, MIME type, has a hash)]
ATTACHMENT_CASES = {
    0: [("Invoice.pdf.exe", "application/octet-stream", True)],
    1: [("a.xlsm", "application/octet-stream", True)],
    2: [("b.tar.gz", "application/gzip", True)],
    3: [("c.pdf", "application/pdf", True)],
    4: [("d.exe", "image/png", True)],
    5: [],
    6: [("noext", "application/pdf", True)],
    7: [("one.txt", "text/plain", True), ("two.txt", "text/plain", False),
        ("three.txt", "text/plain", True), ("four.js", "text/plain", True)],
    8: [("x.docx", "application/x-unknown", True)],
    9: [("photo.JPG.scr", "application/octet-stream", True)],
    10: [("y.zip", " APPLICATION/ZIP ", True)],
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spark_urls() -> str:
    cases = []
    for case, urls in URL_CASES.items():
        items = ", ".join(
            f"named_struct('url', {u}, 'domain', CAST({dom} AS STRING),"
            f" 'visible_text', CAST({t} AS STRING))"
            for u, dom, t in urls
        )
        empty = f"CAST(array() AS array<{schemas.URL_INFO}>)"
        cases.append(f"WHEN {case} THEN " + (f"array({items})" if urls else empty))
    return "CASE d % 9 " + " ".join(cases) + " END"


def _spark_attachments() -> str:
    cases = []
    for case, files in ATTACHMENT_CASES.items():
        items = ", ".join(
            f"named_struct('filename', {_quoted(f)}, 'mime_type', {_quoted(m)},"
            f" 'size', CAST(1000 + d % 100 AS BIGINT), 'sha256', "
            + (
                f"sha2('att-' || CAST(d % 50 AS STRING) || '-{pos}', 256))"
                if hashed
                else "CAST(NULL AS STRING))"
            )
            for pos, (f, m, hashed) in enumerate(files, start=1)
        )
        empty = f"CAST(array() AS array<{schemas.ATTACHMENT}>)"
        cases.append(f"WHEN {case} THEN " + (f"array({items})" if files else empty))
    return "CASE d % 11 " + " ".join(cases) + " END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A handful of text rows as a literal relation, whose size the planner knows."""
    values = ", ".join("(" + ", ".join(_quoted(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


def messages_from(documents: DataFrame) -> DataFrame:
    """Messages of a (batch or streaming) ``documents`` frame."""
    return documents.select(F.col("doc_id").alias("d"), "text").selectExpr(
        "d",
        *[f"{sql} AS {name}" for name, sql in SCALARS.items()],
        "timestampadd(HOUR, CAST(d AS INT), TIMESTAMP '2024-01-01 00:00:00') AS received_at",
        f"{_spark_urls()} AS urls",
        f"{_spark_attachments()} AS attachments",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(table(spark, sf_dir, "documents"))


def _duck_urls() -> str:
    rows = []
    for case, urls in URL_CASES.items():
        for pos, (u, dom, t) in enumerate(urls, start=1):
            rows.append(
                f"SELECT d, message_id, {pos} AS pos, {u} AS url, CAST({dom} AS STRING) AS domain,"
                f" CAST({t} AS STRING) AS visible_text FROM m WHERE d % 9 = {case}"
            )
    return " UNION ALL ".join(rows)


def _duck_attachments() -> str:
    rows = []
    for case, files in ATTACHMENT_CASES.items():
        for pos, (f, m, hashed) in enumerate(files, start=1):
            sha = f"sha256('att-' || CAST(d % 50 AS STRING) || '-{pos}')" if hashed else "NULL"
            rows.append(
                f"SELECT d, message_id, {pos} AS pos, {_quoted(f)} AS filename,"
                f" {_quoted(m)} AS mime_type, CAST(1000 + d % 100 AS BIGINT) AS size,"
                f" {sha} AS sha256 FROM m WHERE d % 11 = {case}"
            )
    return " UNION ALL ".join(rows)


# CTEs for the SQL twins: m (messages), mu (their URLs), ma (their attachments)
DUCK_MAIL = (
    "m AS (SELECT d, "
    + ", ".join(f"{sql} AS {name}" for name, sql in SCALARS.items())
    + ", TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d AS INTEGER)) AS received_at"
    + " FROM (SELECT doc_id AS d, text FROM documents)),\n"
    + f"mu AS ({_duck_urls()}),\nma AS ({_duck_attachments()})"
)


# --- reputation <- the distinct keys of the messages -------------------------
# Every key is numbered by the lowest d of the messages that hold it.

_BASE = 1704067200  # 2024-01-01T00:00:00Z
ENGINE_RULES = {
    "malicious_count": "CAST(n % 8 AS INT)",
    "total_engines": "CAST(70 + n % 5 AS INT)",
    "first_submission_date": f"CASE n % 20 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE {_BASE} + n * 3600 - (n % 100) * 3600 END",
    "creation_date": f"CASE n WHEN 3 THEN NULL WHEN 7 THEN 0 ELSE {_BASE} - n * 5 * 86400 END",
}
ENGINE_KEPT = "n % 3 <> 2"
ABUSE_RULES = {
    "abuse_confidence": "CAST((n * 7) % 101 AS INT)",
    "country_code": "CASE WHEN n % 4 = 0 THEN 'NL' END",
    "country_name": "CASE WHEN n % 3 = 0 THEN 'Netherlands' END",
    "usage_type": "CASE WHEN n % 5 = 0 THEN 'Data Center' END",
    "isp": "CASE WHEN n % 2 = 0 THEN 'ISP-' || CAST(n AS STRING) END",
    "total_reports": "CAST(n % 10 AS INT)",
    "distinct_reporters": "CAST(n % 4 AS INT)",
    "last_reported_at": "CASE WHEN n % 6 = 0 THEN '2024-01-02T00:00:00+00:00' END",
    "is_whitelisted": "n % 13 = 0",
    "is_tor": "n % 11 = 0",
}
ABUSE_KEPT = "n % 9 <> 4"


def engine_keys(messages: DataFrame) -> DataFrame:
    """``kind, target, n`` of every distinct lookup key."""
    url = messages.select("d", F.explode("urls.url").alias("target")).withColumn("kind", F.lit("url"))
    file = messages.select("d", F.explode("attachments.sha256").alias("target")).withColumn("kind", F.lit("file"))
    domain = messages.select("d", F.col("from_domain").alias("target")).withColumn("kind", F.lit("domain"))
    ip = messages.filter("authentication_results IS NOT NULL").select(
        "d", F.expr("'203.0.113.' || CAST(d % 250 AS STRING)").alias("target")
    ).withColumn("kind", F.lit("ip"))
    rows = url.unionByName(file).unionByName(domain).unionByName(ip)
    return rows.filter("target IS NOT NULL").groupBy("kind", "target").agg(F.min("d").alias("n"))


def engines(messages: DataFrame) -> DataFrame:
    return engine_keys(messages).filter(ENGINE_KEPT).selectExpr(
        "kind", "target", *[f"{sql} AS {c}" for c, sql in ENGINE_RULES.items()],
        "CASE n % 3 WHEN 0 THEN array('phish', 'kit') ELSE CAST(array() AS array<string>) END AS threat_names",
        "CASE n % 4 WHEN 0 THEN map('A', 'news', 'B', 'ads', 'C', 'spam', 'D', 'x')"
        " ELSE CAST(map() AS map<string,string>) END AS categories",
        "CASE WHEN kind = 'file' AND n % 2 = 0 THEN 'Win32 EXE' END AS type_description",
        "CASE WHEN kind = 'file' AND n % 3 = 0 THEN 'trojan.x' END AS threat_label",
    )


def abuse(messages: DataFrame) -> DataFrame:
    ips = messages.filter("authentication_results IS NOT NULL").selectExpr("d % 250 AS n").distinct()
    return ips.filter(ABUSE_KEPT).selectExpr(
        "'203.0.113.' || CAST(n AS STRING) AS ip", *[f"{sql} AS {c}" for c, sql in ABUSE_RULES.items()]
    )


def _url_numbers(messages: DataFrame) -> DataFrame:
    return engine_keys(messages).filter("kind = 'url'").select(F.col("target").alias("url"), "n")


def browsing_matches(messages: DataFrame) -> DataFrame:
    """Match rows of every fifth URL, types out of order and repeated."""
    return _url_numbers(messages).filter("n % 5 = 0").selectExpr(
        "url",
        """inline(CASE n % 3
          WHEN 0 THEN array(named_struct('threat_type', CAST(NULL AS STRING), 'platform_type', 'LINUX'))
          WHEN 1 THEN array(named_struct('threat_type', 'MALWARE', 'platform_type', 'WINDOWS'))
          ELSE array(named_struct('threat_type', 'SOCIAL_ENGINEERING', 'platform_type', 'WINDOWS'),
                     named_struct('threat_type', 'MALWARE', 'platform_type', 'ANY_PLATFORM'),
                     named_struct('threat_type', 'MALWARE', 'platform_type', 'WINDOWS')) END)""",
    )


def malware_feed(messages: DataFrame) -> DataFrame:
    return _url_numbers(messages).filter("n % 7 <= 1").selectExpr(
        "url", "n % 7 = 0 AS in_database",
        "CASE WHEN n % 7 = 0 AND n % 2 = 1 THEN 'malware_download' END AS threat",
        "CASE WHEN n % 7 <> 0 OR n % 3 = 0 THEN CAST(array() AS array<string>)"
        " WHEN n % 3 = 1 THEN array('exe') ELSE array('exe', 'zip') END AS tags",
    )


# --- reputation over time ------------------------------------------------------
# Four records of each key: an older one, a later one, and one more later still that the table
# holds twice.  A key's name says when it was first fetched; some only after all messages.

VERSIONS = "0, 1, 2, 2"


def fetched_hours(key: str) -> str:
    age = f"(ascii(right({key}, 1)) * 7 + length({key}))"
    return f"({age} % 50 + v * 200 + CASE WHEN {age} % 6 = 0 THEN 100000 ELSE 0 END)"


def later(column: str, step: int, below: int) -> str:
    """A number that differs from version to version."""
    return f"CAST(({column} + {step} * v) % {below} AS INT)"


def dated(snapshot: DataFrame, key: str, **changed: str) -> DataFrame:
    rows = snapshot.withColumn("v", F.expr(f"explode(array({VERSIONS}))"))
    rows = rows.withColumns({c: F.expr(sql) for c, sql in changed.items()})
    hours = f"timestampadd(HOUR, CAST({fetched_hours(key)} AS INT), TIMESTAMP '2024-01-01 00:00:00')"
    return rows.withColumn("fetched_at", F.expr(hours)).drop("v")


# --- redirect edges of the shortened URLs ------------------------------------
# k = number in the URL; k % 5 gives no hop, one, eight, nine hops or a cycle


def redirects(messages: DataFrame) -> DataFrame:
    short = messages.filter("d % 9 = 8").selectExpr("d % 200 AS k").distinct()
    hops = short.selectExpr(
        "k", "CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 8 WHEN 3 THEN 9 ELSE 2 END AS n"
    ).filter("n > 0").selectExpr("k", "n", "explode(sequence(1, n)) AS i")
    chains = hops.selectExpr(
        "CASE WHEN i = 1 THEN 'https://t.co/q' || CAST(k AS STRING) ELSE"
        " 'https://hop.example/' || CAST(k AS STRING) || '/' || CAST(i - 1 AS STRING) END AS src",
        "CASE WHEN k % 5 = 4 AND i = 2 THEN 'https://t.co/q' || CAST(k AS STRING) ELSE"
        " 'https://hop.example/' || CAST(k AS STRING) || '/' || CAST(i AS STRING) END AS dst",
    )
    landing = messages.filter("d % 9 = 0").selectExpr(
        "'https://bit.ly/fake-login' AS src", "'https://land.example/0' AS dst"
    ).distinct()
    return chains.unionByName(landing)


def long_redirects(messages: DataFrame) -> DataFrame:
    """Chains of 8, 9 and 40 hops and cycles of three by k % 4, of the t.co URLs of all messages."""
    numbers = short_urls(messages).selectExpr("regexp_extract(url, 't.co/q([0-9]+)$', 1) AS k").filter("k <> ''")
    hops = numbers.distinct().selectExpr(
        "CAST(k AS BIGINT) AS k", "CASE CAST(k AS BIGINT) % 4 WHEN 0 THEN 8 WHEN 1 THEN 9 WHEN 2 THEN 40 ELSE 3 END AS n"
    ).selectExpr("k", "n", "explode(sequence(1, n)) AS i")
    return hops.selectExpr(
        "CASE WHEN i = 1 THEN 'https://t.co/q' || k ELSE 'https://far.example/' || k || '/' || (i - 1) END AS src",
        "CASE WHEN k % 4 = 3 AND i = n THEN 'https://t.co/q' || k ELSE 'https://far.example/' || k || '/' || i END AS dst",
    )


def short_urls(messages: DataFrame) -> DataFrame:
    """URLs of all messages that go through a link shortener of the tables."""
    return messages.select(F.inline("urls")).filter("domain IN ('bit.ly', 't.co')").select("url")


# --- mailbox <- events -------------------------------------------------------

MAILBOX = {
    "mailbox_id": "CAST(user_id % 20 AS STRING)",
    "thread_id": "CAST(user_id AS STRING) || '-' || CAST(CAST(floor(value) AS BIGINT) AS STRING)",
    "message_id": "'e' || CAST(event_id AS STRING)",
    "sender": "CASE WHEN event_type = 'purchase' THEN 'owner' ELSE CAST(user_id AS STRING) END",
    "recipient": "CASE WHEN event_type = 'purchase' THEN CAST(user_id AS STRING) ELSE 'owner' END",
    "folder": """CASE event_type WHEN 'error' THEN 'spam' WHEN 'signup' THEN 'trash'
 WHEN 'purchase' THEN 'sent' ELSE 'inbox' END""",
    "received_at": "CAST(ts AS TIMESTAMP)",
    "subject": "'Note ' || CAST(event_id % 50 AS STRING)",
    "body": """CASE event_id % 4 WHEN 0 THEN 'see https://a.example/1 and https://a.example/1 or http://b.example'
 WHEN 1 THEN props ELSE NULL END""",
    "n_attachments": "CAST(event_id % 3 AS INT)",
}


def mailbox_from(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{sql} AS {c}" for c, sql in MAILBOX.items()])


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailbox_from(table(spark, sf_dir, "events"))


# --- stored answers, one shape per d % 8 -------------------------------------

_ADVICE = ', "what_to_do": {"do": ["a", "b", "c", "d"], "do_not": ["x"]}'
ANSWER_TEXT = f"""CASE d % 8
 WHEN 0 THEN '{{"claude_score": ' || CAST(d % 101 AS STRING) || ', "threat_category": "PHISHING", "main_findings": ["f1", "f2"], "potential_damage": "loss"{_ADVICE}}}'
 WHEN 1 THEN '```json
{{"claude_score": 40.9, "threat_category": "BEC", "main_findings": [], "potential_damage": null, "what_to_do": {{"do": [], "do_not": []}}}}
```'
 WHEN 2 THEN '{{"claude_score": "87", "threat_category": "IMPERSONATION", "main_findings": ["only"], "what_to_do": "none"}}'
 WHEN 3 THEN '{{"claude_score": "87.9", "threat_category": "SAFE"}}'
 WHEN 4 THEN '{{"claude_score": 172, "threat_category": "WEIRD", "potential_damage": "harm"}}'
 WHEN 5 THEN CASE d % 3
   WHEN 0 THEN '{{"claude_score": 55, "threat_category": "PHISHING", "main_findings": "oops"}}'
   WHEN 1 THEN '{{"claude_score": 55, "threat_category": "PHISHING", "main_findings": ["1", "2", "3", "4", "5", "6", "7"]}}'
   ELSE '{{"claude_score": 55, "threat_category": "PHISHING", "main_findings": ["", "z", 0, null, false, true, [], {{}}, 7]}}' END
 WHEN 6 THEN '{{"claude_score": ' END"""


def raw_answers(messages: DataFrame) -> DataFrame:
    return messages.filter("d % 8 <> 7").selectExpr("message_id", f"{ANSWER_TEXT} AS raw_text")
