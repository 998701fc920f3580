"""URL extraction from message bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk.functions.text import bind, text_or_empty, trim_space

URL_ARRAY = "array<struct<url:string,domain:string,visible_text:string>>"


def url_host(url: Column) -> Column:
    """Lower-cased host without a leading ``www.``; null for a malformed URL."""
    host = F.lower(F.regexp_extract(url, fv.URL_HOST_PATTERN, 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def url_id(url: Column) -> Column:
    """URL-safe base64 of the URL without padding."""
    encoded = F.translate(F.base64(F.encode(url, "utf-8")), "+/", "-_")
    return F.regexp_replace(encoded, r"[=\s]+", "")


def clean_anchor_text(inner_html: Column) -> Column:
    """Visible text of an anchor: tags out, entities decoded, blanks collapsed."""
    text = F.regexp_replace(inner_html, "<[^>]+>", " ")
    for entity, plain in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
        ("&quot;", '"'), ("&#39;", "'"),
    ):
        text = F.regexp_replace(text, "(?i)" + entity, plain)
    text = trim_space(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(text != "", text)


def anchors(html: Column) -> Column:
    """``array<struct<href, inner>>`` of the anchors, in document order."""
    source = text_or_empty(html)
    hrefs = F.regexp_extract_all(source, F.lit(fv.ANCHOR_PATTERN), F.lit(1))
    inner = F.regexp_extract_all(source, F.lit(fv.ANCHOR_PATTERN), F.lit(2))
    return F.zip_with(
        hrefs, inner, lambda h, i: F.struct(h.alias("href"), text_or_empty(i).alias("inner"))
    )


def web_anchors(html: Column) -> Column:
    """``array<struct<url, visible_text>>`` of http(s) anchors."""
    web = F.filter(anchors(html), lambda a: a["href"].rlike("(?i)^https?://"))
    return F.transform(
        web,
        lambda a: F.struct(
            a["href"].alias("url"), clean_anchor_text(a["inner"]).alias("visible_text")
        ),
    )


def plain_urls(text: Column, html: Column | None = None) -> Column:
    """URLs written out in the text; with ``html`` that source is scanned too."""
    if html is None:
        return F.regexp_extract_all(
            text_or_empty(text), F.lit(fv.SERVER_URL_PATTERN), F.lit(0)
        )
    both = F.concat(text_or_empty(text), F.lit(" "), text_or_empty(html))
    return F.regexp_extract_all(both, F.lit(fv.CLIENT_URL_PATTERN), F.lit(0))


def dedupe_urls(records: Column, keep: str = "first") -> Column:
    """One record per URL at its first position.

    ``keep='first'`` keeps the first record of a URL, ``keep='last'`` the last
    (so a later plain mention erases the anchor text).
    """
    if keep == "last":
        records = F.reverse(records)

    def kept(rs: Column) -> Column:
        names = rs["url"]
        return F.transform(
            F.array_distinct(names if keep == "first" else F.reverse(names)),
            lambda u: F.get(rs, F.array_position(names, u).cast("int") - 1),
        )

    return bind(records, kept)


def message_urls(text: Column, html: Column, mode: str = "client") -> Column:
    """All URLs of a message.

    ``client`` scans text and HTML and keeps anchor text; ``server`` scans the
    text with a narrower pattern and lets the last record of a URL win.
    """
    client = mode == "client"
    # the server form takes lower-case schemes only, as written
    linked = web_anchors(html)
    if not client:
        linked = F.filter(linked, lambda a: a["url"].rlike("^https?://"))
    plain = plain_urls(text, html if client else None)
    records = F.concat(
        F.transform(
            linked,
            lambda a: F.struct(
                a["url"].alias("url"),
                url_host(a["url"]).alias("domain"),
                a["visible_text"].alias("visible_text"),
            ),
        ),
        F.transform(
            plain,
            lambda u: F.struct(
                u.alias("url"),
                url_host(u).alias("domain"),
                F.lit(None).cast("string").alias("visible_text"),
            ),
        ),
    ).cast(URL_ARRAY)
    return dedupe_urls(records, "first" if client else "last")
