"""Parsing queries: URLs, addresses, MIME trees, domains, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk.functions import address as ad
from tamarisk.functions import text as tx
from tamarisk.functions import urls as ur
from tamarisk.operators import mime
from tamarisk.operators.intel import hash_rows, url_rows
from tamarisk.operators.lineage import new_folder
from tamarisk.operators.suffixes import with_registered_domains
from tamarisk.sources import snapshots as snap
from workload import duck, mail
from workload.mail import messages, table
from workload.registry import query

# --- URLs in pages -----------------------------------------------------------

# fixed values: anchors and URLs put into the pages
_HTML = """html || CASE page_id % 5
 WHEN 0 THEN '<a href="https://shop.example/' || CAST(page_id AS STRING) || '">Buy &amp;lt; <b>now</b>  &nbsp; </a>'
 WHEN 1 THEN '<A class="x" HREF=''HTTP://Evil.Example.RU:8080/a''>pay<b>pal</b>.com</A> https://plain.example/x?p=' || CAST(page_id AS STRING)
 WHEN 2 THEN '<a href="https://shop.example/same">first</a><a href="https://shop.example/same">second</a>'
 WHEN 3 THEN '<a href="mailto:x@y.example">mail</a><a href="https://shop.example/e"> </a>'
 ELSE 'see (https://user@www.Site.Example/p#f) and https://a.example' END"""


def _pages(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", "url", f"{_HTML} AS html")


# fixed values: the patterns of anchors and URLs
_DUCK_PAGES = f"""WITH p AS (SELECT page_id, url, {_HTML} AS html FROM pages),
an AS (SELECT page_id, i, h[i] AS href, t[i] AS inner_html FROM (SELECT page_id,
    regexp_extract_all(html, '(?i)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']+)["''][^>]*>([\\s\\S]*?)</a>', 1) AS h,
    regexp_extract_all(html, '(?i)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']+)["''][^>]*>([\\s\\S]*?)</a>', 2) AS t FROM p),
    range(1, 1000) r(i) WHERE i <= len(h)),
wa AS (SELECT page_id, i, href AS url, nullif(trim(regexp_replace(replace(replace(replace(replace(
    replace(replace(regexp_replace(inner_html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'),
    '&quot;', '"'), '&#39;', ''''), '\\s+', ' ', 'g')), '') AS visible_text
  FROM an WHERE regexp_matches(href, '(?i)^https?://')),
pu AS (SELECT page_id, i + 1000000 AS i, u[i] AS url FROM (SELECT page_id,
    regexp_extract_all(html, '(?i)https?://[^\\s"''<>]+') AS u FROM p), range(1, 1000) r(i) WHERE i <= len(u))
"""
_HOST = (
    "nullif(regexp_replace(lower(regexp_extract({u}, '(?i)^https?://(?:[^/?#]*@)?([^/?#:@\\s]+)', 1)), '^www\\.', ''), '')"
)


@query(
    "anchor_extract",
    _DUCK_PAGES + "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, url, visible_text FROM wa",
)
def anchor_extract(spark, sf):
    return _pages(spark, sf).select(
        "page_id", F.posexplode(ur.web_anchors(F.col("html"))).alias("pos", "a")
    ).select("page_id", F.col("pos").cast("long").alias("pos"), "a.url", "a.visible_text")


@query(
    "plain_urls",
    _DUCK_PAGES + "SELECT page_id, count(*) AS n, md5(string_agg(url, ' ' ORDER BY i)) AS urls_md5 FROM pu GROUP BY page_id",
)
def plain_urls(spark, sf):
    found = ur.plain_urls(F.lit(""), F.col("html"))
    return _pages(spark, sf).withColumn("u", found).filter(F.size("u") > 0).select(
        "page_id", F.size("u").cast("long").alias("n"), F.md5(F.array_join("u", " ")).alias("urls_md5")
    )


@query(
    "message_urls_client",
    _DUCK_PAGES + f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, url,
      {_HOST.format(u='url')} AS domain, visible_text FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY i) AS dup FROM (
          SELECT page_id, i, url, visible_text FROM wa UNION ALL SELECT page_id, i, url, NULL FROM pu)) WHERE dup = 1""",
)
def message_urls_client(spark, sf):
    return _pages(spark, sf).select(
        "page_id", F.posexplode(ur.message_urls(F.lit(None), F.col("html"))).alias("pos", "u")
    ).select("page_id", F.col("pos").cast("long").alias("pos"), "u.*")


@query(
    "message_urls_server",
    _DUCK_PAGES + f""", su AS (SELECT page_id, i + 1000000 AS i, u[i] AS url FROM (SELECT page_id,
      regexp_extract_all(html, '(?i)https?://[^\\s<>''"\\\\)]+') AS u FROM p), range(1, 1000) r(i) WHERE i <= len(u))
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first_i) - 1 AS pos, url, visible_text FROM (
      SELECT *, min(i) OVER (PARTITION BY page_id, url) AS first_i, row_number() OVER (PARTITION BY page_id, url ORDER BY i DESC) AS dup
      FROM (SELECT page_id, i, url, visible_text FROM wa WHERE regexp_matches(url, '^https?://')
            UNION ALL SELECT page_id, i, url, NULL FROM su)) WHERE dup = 1""",
)
def message_urls_server(spark, sf):
    urls = ur.message_urls(F.col("html"), F.col("html"), "server")
    return _pages(spark, sf).select("page_id", F.posexplode(urls).alias("pos", "u")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "u.url", "u.visible_text"
    )


@query(
    "url_hosts",
    f"SELECT page_id, {_HOST.format(u='url')} AS host FROM pages UNION ALL SELECT page_id + 1000000, "
    + _HOST.format(u="u") + " FROM (SELECT page_id, 'HTTPS://me:pw@WWW.Host' || page_id || '.Example:8443/a' AS u FROM pages)"
    " UNION ALL SELECT page_id + 2000000, NULL FROM pages",
)
def url_hosts(spark, sf):
    pages = table(spark, sf, "pages")
    made = pages.selectExpr(
        "page_id + 1000000 AS page_id", "'HTTPS://me:pw@WWW.Host' || page_id || '.Example:8443/a' AS url"
    )
    broken = pages.selectExpr("page_id + 2000000 AS page_id", "'ht!tp://' || page_id AS url")
    return pages.select("page_id", "url").unionByName(made).unionByName(broken).select(
        "page_id", ur.url_host(F.col("url")).alias("host")
    )


@query(
    "url_ids",
    "SELECT page_id, rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') AS id FROM pages",
)
def url_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", ur.url_id(F.col("url")).alias("id"))


@query(
    "html_strip",
    f"SELECT page_id, md5(regexp_replace({_HTML}, '<[^>]+>', ' ', 'g')) AS stripped_md5,"
    f" md5(replace(replace(replace({_HTML}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages",
)
def html_strip(spark, sf):
    return _pages(spark, sf).select(
        "page_id", F.md5(tx.strip_tags(F.col("html"))).alias("stripped_md5"),
        F.md5(tx.escape_html(F.col("html"))).alias("escaped_md5"),
    )


_SUFFIXES = ["com", "net", "org", "co.uk", "*.ck", "!www.ck", "example.com", "example.net"]


def _suffix_rules(spark, sf):
    """Suffix table: fixed rules and one rule per language of the documents."""
    fixed = mail.literal_table(spark, ["suffix"], [(s,) for s in _SUFFIXES])
    langs = table(spark, sf, "documents").selectExpr("lang || '.example' AS suffix").distinct()
    return fixed.unionByName(langs)


_REGISTERED = f"""WITH h AS (SELECT page_id, {_HOST.format(u='url')} AS host FROM pages UNION ALL
        SELECT page_id + 1000000, 'a' || page_id || CASE page_id % 5 WHEN 0 THEN '.b.co.uk' WHEN 1 THEN '.x.ck' WHEN 2 THEN '.y.www.ck'
          WHEN 3 THEN '.z.en.example' ELSE '.unknown' END FROM pages)
      SELECT page_id, CASE
        WHEN regexp_matches(host, '(^|[.])www[.]ck$') THEN 'www.ck'
        WHEN regexp_matches(host, '[.]ck$') THEN nullif(regexp_extract(host, '([^.]+[.][^.]+[.]ck)$', 1), '')
        WHEN regexp_matches(host, '(^|[.])(co[.]uk|example[.]com|example[.]net|(en|fr|de|es|zh|ja|it|pt|nl|ru)[.]example)$')
          THEN nullif(regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1), '')
        WHEN regexp_matches(host, '[.](com|net|org)$') THEN nullif(regexp_extract(host, '([^.]+[.][^.]+)$', 1), '')
        ELSE NULL END AS url_domain FROM h"""


def _page_hosts(pages):
    """Hosts of the pages' URLs, and as many made ones."""
    return pages.select("page_id", ur.url_host(F.col("url")).alias("url_domain")).unionByName(
        pages.selectExpr(
            "page_id + 1000000 AS page_id",
            "'a' || page_id || CASE page_id % 5 WHEN 0 THEN '.b.co.uk' WHEN 1 THEN '.x.ck' WHEN 2 THEN '.y.www.ck'"
            " WHEN 3 THEN '.z.en.example' ELSE '.unknown' END AS url_domain",
        )
    )


@query("registered_domains", _REGISTERED)
def registered_domains(spark, sf):
    hosts = _page_hosts(table(spark, sf, "pages"))
    return with_registered_domains(hosts, "url_domain", _suffix_rules(spark, sf), ["page_id"], fallback=False)


@query("registered_domains_from_list", _REGISTERED)
def registered_domains_from_list(spark, sf):
    """The same rules, read from text files in the format of the public list."""
    folder = new_folder(spark, "suffixes")
    rules = _suffix_rules(spark, sf)
    lines = rules.select(F.explode(F.array(F.concat(F.lit("// for "), "suffix"), F.lit(""), F.concat(F.lit("  "), F.upper("suffix"), F.lit(" trailing"))))
                         .alias("value"))
    lines.write.text(folder)
    pages = table(spark, sf, "pages")
    return with_registered_domains(_page_hosts(pages), "url_domain", snap.read_suffix_rules(spark, folder), ["page_id"], fallback=False)


@query(
    "sender_domains",
    duck.with_mail() + """SELECT message_id, CASE from_domain WHEN 'partner.example.com' THEN 'partner.example.com'
      WHEN 'mail.microsoft.com' THEN 'microsoft.com' ELSE from_domain END AS from_domain FROM m WHERE from_domain IS NOT NULL""",
)
def sender_domains(spark, sf):
    m = messages(spark, sf).filter("from_domain IS NOT NULL").select("message_id", "from_domain")
    return with_registered_domains(m, "from_domain", _suffix_rules(spark, sf), ["message_id"], fallback=True)


# --- addresses and headers ---------------------------------------------------


@query(
    "sender_addresses",
    duck.with_mail() + """SELECT message_id, CASE WHEN contains(from_email, '<') THEN regexp_extract(from_email, '<([^>]+)>', 1) ELSE from_email END AS address,
      CASE WHEN d % 4 = 0 THEN 'other.example' ELSE from_domain END AS reply_domain, from_domain AS domain,
      coalesce(lower(trim(regexp_extract(from_email, '^"?([^"<]*)"?[ ]*<', 1))), '') AS display_name FROM m""",
)
def sender_addresses(spark, sf):
    return messages(spark, sf).select(
        "message_id",
        ad.mailbox_address(F.col("from_email")).alias("address"),
        ad.mailbox_domain(F.col("reply_to_email")).alias("reply_domain"),
        ad.mailbox_domain(F.col("from_email")).alias("domain"),
        ad.display_name(F.col("from_email")).alias("display_name"),
    )


# fixed values: private address ranges
_PRIVATE = "'^(10|172[.](1[6-9]|2[0-9]|3[01])|192[.]168|127|0|169[.]254|255)[.]'"


@query(
    "sender_ips",
    duck.with_mail() + f"""SELECT message_id, list_filter(regexp_extract_all(authentication_results,
      '\\b(?:25[0-5]|2[0-4]\\d|[01]?\\d?\\d)(?:\\.(?:25[0-5]|2[0-4]\\d|[01]?\\d?\\d)){{3}}\\b'),
      lambda x: NOT regexp_matches(x, {_PRIVATE}))[1] AS from_auth,
      CASE WHEN authentication_results IS NULL THEN '198.51.100.' || (d % 200) ELSE '203.0.113.' || (d % 250) END AS from_any FROM m""",
)
def sender_ips(spark, sf):
    auth = F.col("authentication_results")
    received = F.expr(
        "array('from a (192.168.1.1)', 'from b (198.51.100.' || CAST(d % 200 AS STRING) || ') by 172.16.0.1')"
    )
    return messages(spark, sf).select(
        "message_id", ad.sender_ip(auth).alias("from_auth"),
        ad.sender_ip(auth, received).alias("from_any"),
    )


@query(
    "auth_blocks",
    duck.with_mail() + """SELECT message_id, CASE WHEN authentication_results IS NULL THEN NULL ELSE
      'authentication-results: mx.example;' || chr(10) || ' ' || authentication_results END AS block FROM m""",
)
def auth_blocks(spark, sf):
    raw = F.expr(
        "'Received: by mx' || chr(10) || coalesce('authentication-results: mx.example;' || chr(10) || ' ' ||"
        " authentication_results || chr(10), '') || 'Subject: x' || chr(10) || chr(10) || 'Authentication: no'"
    )
    return messages(spark, sf).select("message_id", ad.auth_results_block(raw).alias("block"))


# --- attachments ---------------------------------------------------------------


@query(
    "attachment_hashes",
    "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN strlen(text) <= 5000 THEN sha256(text) END AS sha256 FROM documents",
)
def attachment_hashes(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return mime.hash_attachments(files, max_bytes=5000)


_FILE_PARTS = 64


@query(
    "attachment_files",
    f"SELECT lang, doc_id % {_FILE_PARTS} AS part, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size,"
    " CASE WHEN sum(strlen(coalesce(text, '')) + 1) <= 200000 THEN sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)) END AS sha256"
    " FROM documents GROUP BY ALL",
)
def attachment_files(spark, sf):
    """Texts stored as files, several to a file, read back as bytes; larger files get no hash."""
    folder = new_folder(spark, "files")
    rows = table(spark, sf, "documents").select("doc_id", "lang", (F.col("doc_id") % _FILE_PARTS).alias("part"), F.coalesce("text", F.lit("")).alias("value"))
    laid_out = rows.repartition("lang", "part").sortWithinPartitions("lang", "part", "doc_id")
    laid_out.select("lang", "part", "value").write.partitionBy("lang", "part").text(folder)
    files = mime.hash_attachments(snap.read_attachment_files(spark, folder), max_bytes=200_000)
    named = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    return files.select(named("lang").alias("lang"), named("part").cast("long").alias("part"), "size", "sha256")


@query(
    "lookup_hashes",
    duck.with_mail() + "SELECT message_id, CAST(pos - 1 AS INT) AS pos, sha256 FROM ma WHERE pos <= 3 AND sha256 IS NOT NULL",
)
def lookup_hashes(spark, sf):
    return hash_rows(messages(spark, sf)).select("message_id", "pos", "sha256")


@query(
    "lookup_urls",
    duck.with_mail() + "SELECT message_id, CAST(pos - 1 AS INT) AS pos, url, domain FROM mu WHERE pos <= 5",
)
def lookup_urls(spark, sf):
    return url_rows(messages(spark, sf)).select("message_id", "pos", "url", "domain")


# --- raw messages ---------------------------------------------------------------

_PAGE_LINK = "'<p>Hi <a href=\"https://x.example/p' || CAST(doc_id AS STRING) || '\">Shop &amp; go</a></p>'"


def raw_messages(spark, sf):
    """``message_id, raw_json``: flat, nested, damaged and header-only messages."""
    data = lambda sql: F.translate(F.base64(F.encode(F.expr(sql), "utf-8")), "+/=", "-_")
    leaf = lambda kind, body: F.struct(
        F.lit(kind).alias("mimeType"), F.lit("").alias("filename"),
        F.struct(F.lit(5).alias("size"), body.alias("data")).alias("body"),
    )
    head = lambda name, sql: F.struct(F.lit(name).alias("name"), F.expr(sql).alias("value"))
    headers = F.array(
        head("SUBJECT", "'Doc ' || doc_id"), head("from", "'Ann Lee <ann@mail.example.com>'"),
        head("Reply-To", "'desk@reply.example.net'"), head("subject", "'second'"),
        head("ARC-Authentication-Results", "'arc spf=fail'"), head("Return-Path", "'<b@c.example>'"),
    ).alias("headers")
    docs = table(spark, sf, "documents")

    def shaped(rest: int, *fields):
        payload = F.struct(headers, *fields)
        return docs.filter(f"doc_id % 4 = {rest}").select(
            F.col("doc_id").cast("string").alias("message_id"),
            F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), payload.alias("payload"))).alias("raw_json"),
        )

    def holder(kind, *kids):
        return F.struct(F.lit(kind).alias("mimeType"), F.to_variant_object(F.array(*kids)).alias("parts"))

    variant = lambda c: F.parse_json(F.to_json(c))
    flat = shaped(
        0, F.lit("text/plain").alias("mimeType"),
        F.struct(F.lit(1).alias("size"), data("text").alias("data")).alias("body"),
    )
    pdf = F.struct(
        F.lit("application/pdf").alias("mimeType"), F.expr("'r' || doc_id || '.pdf'").alias("filename"),
        F.struct((F.col("doc_id") + 10).alias("size")).alias("body"),
    )
    both = holder("multipart/alternative", variant(leaf("text/plain", data("text"))), variant(leaf("text/html", data(_PAGE_LINK))))
    mixed = shaped(
        1, F.lit("multipart/mixed").alias("mimeType"), F.array(variant(both), variant(pdf)).alias("parts")
    )
    deep = variant(leaf("text/plain", data("'deep'")))
    for _ in range(12):
        deep = variant(F.struct(F.lit("multipart/x").alias("mimeType"), F.array(deep).alias("parts")))
    odd = shaped(
        2, F.lit("multipart/mixed").alias("mimeType"),
        F.array(
            variant(leaf("text/plain", F.lit("__5B"))), variant(leaf("text/plain", F.lit("abcde"))),
            deep, variant(leaf("text/plain", data("'tail'"))),
        ).alias("parts"),
    )
    bare = shaped(3, F.lit("text/plain").alias("mimeType"))
    return flat.unionByName(mixed).unionByName(odd).unionByName(bare)


_DEEP_PATHS = ", ".join("'2" + "/0" * k + "'" for k in range(13))
_PART_ROWS = f"""SELECT CAST(doc_id AS STRING) AS message_id, path, kind AS mime_type FROM documents, (VALUES
  (0, '', 'text/plain'), (1, '', 'multipart/mixed'), (1, '0', 'multipart/alternative'), (1, '0/0', 'text/plain'),
  (1, '0/1', 'text/html'), (1, '1', 'application/pdf'), (2, '', 'multipart/mixed'), (2, '0', 'text/plain'),
  (2, '1', 'text/plain'), (2, '3', 'text/plain'), (3, '', 'text/plain')) t(r, path, kind) WHERE doc_id % 4 = r
  UNION ALL SELECT CAST(doc_id AS STRING), path, CASE WHEN length(path) = 25 THEN 'text/plain' ELSE 'multipart/x' END
  FROM documents, (SELECT unnest([{_DEEP_PATHS}]) AS path) WHERE doc_id % 4 = 2"""


@query("mime_parts", _PART_ROWS)
def mime_parts(spark, sf):
    parts = mime.with_parts(raw_messages(spark, sf))
    return parts.select("message_id", F.explode("parts").alias("p")).select(
        "message_id", F.array_join(F.col("p.path").cast("array<string>"), "/").alias("path"), "p.mime_type"
    )


_BODY = """CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text
  WHEN 2 THEN chr(65533) || chr(65533) || 'A' || chr(10) || chr(10) || 'deep' || chr(10) || 'tail' ELSE '' END"""


@query(
    "raw_message_bodies",
    f"SELECT CAST(doc_id AS STRING) AS message_id, md5({_BODY}) AS text_md5, CASE WHEN doc_id % 4 = 1 THEN {_PAGE_LINK} ELSE '' END AS body_html,"
    " CASE WHEN doc_id % 4 = 1 THEN 'r' || doc_id || '.pdf:application/pdf:' || (doc_id + 10) ELSE '' END AS files FROM documents",
)
def raw_message_bodies(spark, sf):
    files = F.array_join(
        F.transform("attachments", lambda a: F.concat_ws(":", a["filename"], a["mime_type"], a["size"].cast("string"))), ";"
    )
    return mime.parse_raw_messages(raw_messages(spark, sf)).select(
        "message_id", F.md5("body_text").alias("text_md5"), "body_html", files.alias("files")
    )


@query(
    "raw_message_headers",
    "SELECT CAST(doc_id AS STRING) AS message_id, 'Doc ' || doc_id AS subject, 'example.com' AS from_domain, 'example.net' AS reply_to_domain,"
    " 'arc spf=fail' AS authentication_results, '<b@c.example>' AS return_path,"
    " CASE WHEN doc_id % 4 = 1 THEN 'https://x.example/p' || doc_id || '|x.example|Shop & go' ELSE '' END AS links FROM documents",
)
def raw_message_headers(spark, sf):
    # the documents hold no URL of their own
    links = F.array_join(F.transform("urls", lambda u: F.concat_ws("|", u["url"], u["domain"], u["visible_text"])), ";")
    rules = mail.literal_table(spark, ["suffix"], [("com",), ("net",), ("example",)])
    return mime.parse_raw_messages(raw_messages(spark, sf), rules=rules).select(
        "message_id", "subject", "from_domain", "reply_to_domain", "authentication_results",
        "return_path", links.alias("links"),
    )
