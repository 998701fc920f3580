"""The 27 feature flags of a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk.functions.address import display_name
from tamarisk.functions.text import (
    contains_any,
    ends_with_any,
    has_text,
    sql_any,
    sql_text,
    strip_tags,
    text_or_empty,
)
from tamarisk.operators.keys import message_key
from tamarisk.operators.lookup import lookup_join
from tamarisk.params import RiskParams

BODY_FLAGS = [
    "spf_fail", "dkim_fail", "dmarc_fail",
    "reply_to_mismatch", "suspicious_sender_domain", "display_name_spoofing",
    "free_provider_spoofing",
    "has_urls", "has_login_or_verification_url", "has_url_shortener",
    "has_suspicious_url_keywords", "has_link_text_href_mismatch",
    "urgent_language", "financial_request_language", "credential_request_language",
    "generic_greeting",
    "has_attachments", "has_executable_attachment", "has_macro_attachment",
    "has_archive_attachment", "has_double_extension_attachment",
    "has_mime_extension_mismatch",
]
INTEL_FLAGS = ["domain_recently_registered", "recently_seen_attachment"]
HISTORY_FLAGS = [
    "is_first_time_sender", "has_user_replied_to_sender", "sender_has_spam_history",
]
ALL_FLAGS = BODY_FLAGS + INTEL_FLAGS + HISTORY_FLAGS


def auth_failed(header: Column, mechanism: str) -> Column:
    return text_or_empty(header).rlike(fv.AUTH_FAIL_PATTERN % mechanism)


def brand_spoofed(name: str, domain: str, brands: dict) -> Column:
    """A brand is named and the domain is none of the brand's own (column names)."""

    def foreign(own):
        return "NOT " + sql_any(
            f"lower({domain}) = {sql_text(d)} OR endswith(lower({domain}), {sql_text('.' + d)})"
            for d in own
        )

    hit = F.expr(
        sql_any(
            f"(contains({name}, {sql_text(brand)}) AND {foreign(own)})"
            for brand, own in brands.items()
        )
    )
    return has_text(F.col(name)) & has_text(F.col(domain)) & F.coalesce(hit, F.lit(False))


_GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """All pieces of the text of that length."""
    last = F.length(text) - size + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(text, i, F.lit(size)))


def brand_spoofed_by_table(
    messages: DataFrame, brands: DataFrame, params: RiskParams = RiskParams()
) -> DataFrame:
    """Key of the message and ``brand_spoofing``, for a large dictionary ``brand, domain``.

    "The name contains the brand" becomes an equi join through an inverted index: each brand
    stands under one of its grams, the one that fewest names hold (a brand with a gram that no
    name holds is in no name), and each distinct name asks with all of its grams.  What meets
    is verified.  A second equi join, on the endings of the sender's domain, tells the brand's
    own domains.  No row meets the whole dictionary, and nothing runs while the plan is built.
    """
    key = message_key(messages)
    senders = messages.select(
        *key, display_name(F.col("from_email")).alias("name"), F.lower("from_domain").alias("host")
    )
    pairs = senders.filter(has_text(F.col("name")) & has_text(F.col("host"))).select(
        "name", "host"
    ).distinct()
    asked = pairs.select(
        "name", "host", F.explode(F.array_distinct(F.concat(*[_grams(F.col("name"), n) for n in range(1, _GRAM + 1)]))).alias("gram")
    )
    held = asked.groupBy("gram").agg(F.count("*").alias("n_names"))
    known = brands.filter(has_text(F.col("brand"))).select("brand").distinct()
    own_grams = F.coalesce(*[
        F.when(F.length("brand") >= n, _grams(F.col("brand"), n)) for n in range(_GRAM, 0, -1)
    ])
    index = (
        known.select("brand", F.explode(own_grams).alias("gram")).join(held, "gram", "left")
        .groupBy("brand").agg(F.min(F.struct(F.coalesce("n_names", F.lit(0)).alias("n"), "gram")).alias("rarest"))
        .filter("rarest.n > 0").select("brand", F.col("rarest.gram").alias("gram"))
    )
    named = asked.join(index, "gram").filter(F.contains("name", "brand")).select("name", "host", "brand")
    labels = F.split("host", r"\.")
    endings = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    own = brands.select("brand", F.lower("domain").alias("ending"), F.lit(True).alias("_own")).distinct()
    ended = named.select("name", "host", "brand", F.explode(endings).alias("ending"))
    judged = lookup_join(ended, own, ["brand", "ending"], ["name", "host"], params)
    foreign = (
        judged.groupBy("name", "host", "brand")
        .agg(F.max(F.coalesce("_own", F.lit(False))).alias("own"))
        .filter(~F.col("own"))
        .select("name", "host", F.lit(True).alias("_foreign"))
        .distinct()
    )
    return lookup_join(senders, foreign, ["name", "host"], ["message_id"], params).select(
        *key, F.coalesce("_foreign", F.lit(False)).alias("brand_spoofing")
    )


def foreign_address_in_name(name: Column, domain: Column) -> Column:
    """The display name holds an address of another domain."""
    claimed = F.regexp_replace(
        F.lower(F.regexp_extract(name, fv.DISPLAY_ADDRESS_PATTERN, 1)), r"\.+$", ""
    )
    matched = name.rlike(fv.DISPLAY_ADDRESS_PATTERN)
    return has_text(domain) & F.coalesce(matched & (claimed != F.lower(domain)), F.lit(False))


def link_text_mismatch(visible_text: Column, href_domain: Column) -> Column:
    """A domain written in the link text is unrelated to the link's domain."""
    target = F.regexp_replace(F.lower(href_domain), r"^\.+", "")
    claims = F.regexp_extract_all(
        text_or_empty(visible_text), F.lit(fv.DOMAIN_IN_TEXT_PATTERN), F.lit(1)
    )

    def unrelated(claim: Column) -> Column:
        c = F.regexp_replace(F.lower(claim), r"\.+$", "")
        related = (
            (c == target)
            | target.endswith(F.concat(F.lit("."), c))
            | c.endswith(F.concat(F.lit("."), target))
        )
        return c.contains(".") & (F.length(c) >= 4) & ~related

    return has_text(visible_text) & has_text(href_domain) & F.coalesce(
        F.exists(claims, unrelated), F.lit(False)
    )


def double_extension(filename: Column) -> Column:
    """``<name>.<decoy>.<dangerous>``."""
    parts = F.split(F.lower(text_or_empty(filename)), r"\.")
    n = F.size(parts)
    bare = lambda endings: [e[1:] for e in endings]
    dangerous = fv.EXECUTABLE_ENDINGS + fv.MACRO_ENDINGS + fv.ARCHIVE_ENDINGS
    return (
        (n >= 3)
        & F.get(parts, n - 2).isin(bare(fv.DECOY_ENDINGS))
        & F.get(parts, n - 1).isin(bare(dangerous))
    )


def mime_mismatch(filename: Column, mime_type: Column) -> Column:
    """The declared type is a known one and the file's ending is not its own."""
    expected = F.create_map(
        *[
            x
            for mime, endings in fv.MIME_ENDINGS.items()
            for x in (F.lit(mime), F.array(*[F.lit(e) for e in endings]))
        ]
    )
    own = F.try_element_at(expected, F.lower(F.regexp_replace(mime_type, r"(?U)^\s+|\s+$", "")))
    name = F.lower(filename)
    ending = F.concat(F.lit("."), F.substring_index(name, ".", -1))
    wrong = F.when(~name.contains("."), True).otherwise(~F.array_contains(own, ending))
    return has_text(filename) & F.coalesce(own.isNotNull() & wrong, F.lit(False))


def _file_ends(endings):
    return lambda a: ends_with_any(F.lower(text_or_empty(a["filename"])), endings)


def with_body_flags(messages: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Add the 22 flags that need nothing but the message.

    One narrow pass: the lower-cased text, the joined URLs and the display name
    are projected once and dropped again, no shuffle and no Python.
    """
    d = params.dictionaries
    staged = messages.withColumns(
        {
            "_text": F.lower(
                F.concat(
                    text_or_empty(F.col("subject")), F.lit(" "),
                    text_or_empty(F.col("body_text")), F.lit(" "),
                    strip_tags(text_or_empty(F.col("body_html"))),
                )
            ),
            "_url_text": F.lower(F.array_join(F.col("urls")["url"], " ")),
            "_name": display_name(F.col("from_email")),
            "_urls": F.coalesce("urls", F.array().cast(messages.schema["urls"].dataType)),
            "_files": F.coalesce(
                "attachments", F.array().cast(messages.schema["attachments"].dataType)
            ),
        }
    )
    text, url_text, name = "_text", "coalesce(_url_text, '')", F.col("_name")
    urls, files = F.col("_urls"), F.col("_files")
    domain = F.col("from_domain")
    lowered_domain = F.lower(domain)
    worded = contains_any("from_domain", fv.SENDER_DOMAIN_WORDS) & ~ends_with_any(
        domain, fv.SENDER_DOMAIN_EXEMPT_ENDINGS
    )
    odd_domain = (
        worded
        | lowered_domain.contains(fv.PUNYCODE_MARK)
        | ends_with_any(lowered_domain, d.bad_tlds)
    )
    known_shortener = lambda u: text_or_empty(u["domain"]).isin(list(d.shorteners))
    flags = {
        "spf_fail": auth_failed(F.col("authentication_results"), "spf"),
        "dkim_fail": auth_failed(F.col("authentication_results"), "dkim"),
        "dmarc_fail": auth_failed(F.col("authentication_results"), "dmarc"),
        "reply_to_mismatch": has_text(F.col("reply_to_domain"))
        & has_text(domain)
        & F.coalesce(F.col("reply_to_domain") != domain, F.lit(False)),
        "suspicious_sender_domain": has_text(domain) & F.coalesce(odd_domain, F.lit(False)),
        "display_name_spoofing": brand_spoofed("_name", "from_domain", d.brands)
        | foreign_address_in_name(name, domain),
        "free_provider_spoofing": has_text(name)
        & F.coalesce(lowered_domain.isin(list(d.free_providers)), F.lit(False))
        & contains_any("_name", d.role_words),
        "has_urls": F.size(urls) > 0,
        "has_login_or_verification_url": contains_any(url_text, d.login_url_words),
        "has_url_shortener": F.exists(urls, known_shortener),
        "has_suspicious_url_keywords": contains_any(url_text, d.risky_url_words),
        "has_link_text_href_mismatch": F.exists(
            urls, lambda u: link_text_mismatch(u["visible_text"], u["domain"])
        ),
        "urgent_language": contains_any(text, d.urgent),
        "financial_request_language": contains_any(text, d.financial),
        "credential_request_language": contains_any(text, d.credential),
        "generic_greeting": contains_any(text, d.greetings),
        "has_attachments": F.size(files) > 0,
        "has_executable_attachment": F.exists(files, _file_ends(fv.EXECUTABLE_ENDINGS)),
        "has_macro_attachment": F.exists(files, _file_ends(fv.MACRO_ENDINGS)),
        "has_archive_attachment": F.exists(files, _file_ends(fv.ARCHIVE_ENDINGS)),
        "has_double_extension_attachment": F.exists(
            files, lambda a: double_extension(a["filename"])
        ),
        "has_mime_extension_mismatch": F.exists(
            files, lambda a: mime_mismatch(a["filename"], a["mime_type"])
        ),
    }
    return staged.withColumns(flags).drop("_text", "_url_text", "_name", "_urls", "_files")


def with_history_flags(
    df: DataFrame, params: RiskParams = RiskParams(), history: str = "sender_history"
) -> DataFrame:
    """Three flags from the ``sender_history`` struct; absent history gives false."""
    h = F.col(history)
    known = F.coalesce(h["available"], F.lit(False))
    unwanted = F.coalesce(h["spam_count"], F.lit(0)) + F.coalesce(h["trash_count"], F.lit(0))
    total = F.coalesce(h["total_threads"], F.lit(0))
    often = (unwanted >= params.spam_history_count) | (
        (total > 0)
        & (unwanted >= 1)
        & (unwanted / F.greatest(total, F.lit(1)) >= params.spam_history_ratio)
    )
    return df.withColumns(
        {
            "is_first_time_sender": known & F.coalesce(h["is_first_time_sender"], F.lit(False)),
            "has_user_replied_to_sender": known & F.coalesce(h["has_user_replied"], F.lit(False)),
            "sender_has_spam_history": known & often,
        }
    )


def with_intel_flags(
    df: DataFrame,
    params: RiskParams = RiskParams(),
    intel: str = "intel",
    as_of: str = "received_at",
) -> DataFrame:
    """Two flags that need the gathered reputation.

    Ages are taken at ``as_of``; a missing or zero epoch is no age at all, and a
    date in the future counts as recent.
    """
    now = F.unix_micros(F.col(as_of)) / F.lit(1_000_000)
    dated = lambda e: F.coalesce(e, F.lit(0)) != 0
    fresh_domain = F.exists(
        F.col(intel)["domain_results"],
        lambda r: (F.lower(r["target"]) == F.lower("from_domain"))
        & dated(r["creation_date"])
        & (F.floor((now - r["creation_date"]) / 86400) <= params.recent_domain_days),
    )
    fresh_file = F.exists(
        F.col(intel)["file_results"],
        lambda r: dated(r["first_submission_date"])
        & ((now - r["first_submission_date"]) / 3600 <= params.recent_file_hours),
    )
    return df.withColumns(
        {
            "domain_recently_registered": F.coalesce(fresh_domain, F.lit(False)),
            "recently_seen_attachment": F.coalesce(fresh_file, F.lit(False)),
        }
    )


def without_flags(df: DataFrame, names) -> DataFrame:
    """Set the named flags to false (offline scoring knows nothing of them)."""
    return df.withColumns({n: F.lit(False) for n in names})
