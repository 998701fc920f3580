"""The redacted prompt document of a message and its blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk.functions.address import display_name_raw
from tamarisk.functions.redact import redact, redact_local_part
from tamarisk.functions.text import bind, cut, has_text, lines, non_null, string_array, text_or, text_or_empty
from tamarisk.operators.scoring import feed_hits, threats


def _s(value: Column) -> Column:
    return value.cast("string")


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def _if_text(label: str, value: Column) -> Column:
    return F.when(has_text(value), _line(label, value))


def _numbered(items: Column, block) -> Column:
    """Blocks ``#1, #2, ...`` with an empty line between them."""
    return F.array_join(F.transform(items, lambda x, i: block(x, _s(i + 1))), "\n\n")


def prompt_body(body_text: Column) -> Column:
    """Redacted first, cut second, so no identifier is cut in half and kept."""
    return cut(redact(body_text), fv.PROMPT_BODY_CHARS, fv.PROMPT_BODY_CUT)


def auth_line() -> Column:
    state = lambda flag: F.when(F.col(flag), "fail").otherwise("pass/unknown")
    return F.concat(
        F.lit("SPF="), state("spf_fail"), F.lit(", DKIM="), state("dkim_fail"),
        F.lit(", DMARC="), state("dmarc_fail"),
    )


def metadata_block() -> Column:
    return lines(
        _line("Subject: ", text_or(redact(F.col("subject")), "(empty)")),
        _line("From display name: ", text_or(display_name_raw(F.col("from_email")), "(empty)")),
        _line("From email: ", text_or(redact_local_part(F.col("from_email")), "(empty)")),
        _line("From domain: ", text_or(F.col("from_domain"), "(empty)")),
        _line("Reply-To domain: ", text_or(F.col("reply_to_domain"), "(none)")),
        _line("Authentication: ", auth_line()),
    )


def history_block(h: Column) -> Column:
    yes = lambda c: F.when(c, "yes").otherwise("no")
    known = lines(
        _line("Total prior threads from this sender in recipient's mailbox: ", _s(h["total_threads"])),
        _line("First-time sender: ", yes(h["is_first_time_sender"])),
        _line("Recipient has previously replied to this sender: ", yes(h["has_user_replied"])),
        _line("Prior threads from this sender currently in Spam: ", _s(h["spam_count"])),
        _line("Prior threads from this sender currently in Trash: ", _s(h["trash_count"])),
        _if_text("Oldest known thread from this sender: ", h["oldest_thread_iso_date"]),
    )
    return F.when(F.coalesce(h["available"], F.lit(False)), known).otherwise(fv.PROMPT_NO_HISTORY)


def recent_block(recent: Column) -> Column:
    def one(mail: Column, number: Column) -> Column:
        body = cut(redact(mail["body_snippet"]), fv.RECENT_BODY_CHARS, fv.PROMPT_RECENT_CUT)

        def indented(text: Column) -> Column:
            shifted = F.concat(F.lit("    "), F.replace(text, F.lit("\n"), F.lit("\n    ")))
            return F.when(text != "", lines(F.lit("  Body snippet:"), shifted))

        return lines(
            F.concat(F.lit("Prior email #"), number, F.lit(":")),
            _if_text("  Received: ", mail["received_iso_date"]),
            F.when(has_text(mail["subject"]), _line("  Subject: ", redact(mail["subject"]))),
            bind(body, indented),
            F.when(mail["has_attachments"], F.lit("  Had attachments: yes")),
            F.when(mail["url_count"] > 0, _line("  URLs in body: ", _s(mail["url_count"]))),
        )

    shown = F.slice(recent, 1, fv.MAX_RECENT_EMAILS)
    return F.when(F.size(recent) > 0, _numbered(shown, one)).otherwise(fv.PROMPT_NO_RECENT)


def ip_block(a: Column) -> Column:
    country = F.when(has_text(a["country_name"]), a["country_name"]).otherwise(
        text_or(a["country_code"], "unknown")
    )
    known = lines(
        _line("IP: ", a["ip"]),
        F.concat(F.lit("Abuse confidence: "), _s(a["abuse_confidence"]), F.lit("/100")),
        _line("Total abuse reports: ", _s(a["total_reports"])),
        _line("Distinct reporters: ", _s(a["distinct_reporters"])),
        _line("Country: ", country),
        _line("ISP: ", text_or(a["isp"], "unknown")),
        _line("Usage type: ", text_or(a["usage_type"], "unknown")),
        _if_text("Last reported: ", a["last_reported_at"]),
        F.when(a["is_tor"], F.lit("Tor exit node: yes")),
        F.when(a["is_whitelisted"], F.lit("Whitelisted: yes")),
    )
    return F.when(a.isNotNull(), known).otherwise(fv.PROMPT_NO_IP)


def findings_block() -> Column:
    raised = non_null(
        F.array(*[F.when(F.col(flag), F.lit(text)) for flag, text in fv.PROMPT_FINDINGS])
    )
    return F.when(F.size(raised) > 0, F.array_join(raised, "\n")).otherwise(fv.PROMPT_NO_FINDINGS)


def reputation_block(intel: Column) -> Column:
    listed = lambda xs, none: text_or(F.array_join(xs, ", "), none)
    browsing = F.transform(
        threats(intel),
        lambda r: F.concat(
            F.lit("Google Safe Browsing: FLAGGED — "), r["url"], F.lit(" ("),
            listed(r["threat_types"], "threat"), F.lit(")"),
        ),
    )
    feed = F.transform(
        feed_hits(intel),
        lambda r: F.concat(
            F.lit("URLhaus: MALWARE DISTRIBUTION — "), r["url"], F.lit(" (tags: "),
            listed(r["tags"], "malware"), F.lit(")"),
        ),
    )

    def or_clean(flagged: Column, checked: Column, clean: str) -> Column:
        return F.when(F.size(flagged) > 0, flagged).when(
            F.size(checked) > 0, string_array([clean])
        ).otherwise(string_array([]))

    blocks = F.concat(
        or_clean(browsing, intel["safe_browsing_results"], fv.PROMPT_GSB_CLEAN),
        or_clean(feed, intel["malware_feed_results"], fv.PROMPT_FEED_CLEAN),
    )
    return text_or(F.array_join(blocks, "\n"), fv.PROMPT_NO_REPUTATION)


def _first(items: Column, holds) -> Column:
    return F.get(F.filter(items, holds), F.lit(0))


def url_findings(intel: Column) -> Column:
    """URLs known to either source, sorted, each with both records."""
    urls = F.array_sort(
        F.array_union(intel["url_results"]["target"], intel["url_expansions"]["original_url"])
    )
    return F.transform(
        urls,
        lambda u: F.struct(
            u.alias("url"),
            _first(intel["url_results"], lambda r: r["target"] == u).alias("vt"),
            _first(intel["url_expansions"], lambda e: e["original_url"] == u).alias("expansion"),
        ),
    )


def url_block(intel: Column) -> Column:
    def one(f: Column, number: Column) -> Column:
        vt, exp = f["vt"], f["expansion"]
        moved = exp["expanded"] & has_text(exp["final_url"]) & (exp["final_url"] != f["url"])
        expanded = F.when(
            moved,
            F.concat(
                F.lit("  Expanded to: "), exp["final_url"], F.lit(" ("),
                _s(exp["redirect_count"]), F.lit(" redirects)"),
            ),
        ).when(
            has_text(exp["error"]),
            F.concat(F.lit("  Expansion: failed ("), exp["error"], F.lit(")")),
        )
        pairs = F.transform(
            F.slice(F.map_entries(vt["categories"]), 1, 3),
            lambda e: F.concat(e["key"], F.lit(": "), e["value"]),
        )
        found = lines(
            F.concat(
                F.lit("  VirusTotal: "), _s(vt["malicious_count"]), F.lit("/"),
                _s(vt["total_engines"]), F.lit(" engines flagged as malicious"),
            ),
            _first_seen(vt),
            _if_text("  VT threat names: ", F.array_join(vt["threat_names"], ", ")),
            _if_text("  VT categories: ", F.array_join(pairs, ", ")),
        )
        return lines(
            F.concat(F.lit("URL #"), number, F.lit(":")),
            _line("  Original: ", f["url"]),
            expanded,
            F.when(vt.isNotNull(), found).otherwise("  VirusTotal: not found in database"),
        )

    findings = url_findings(intel)
    return text_or(_numbered(findings, one), fv.PROMPT_NO_URLS)


def _first_seen(vt: Column) -> Column:
    return F.when(
        F.coalesce(vt["first_submission_date"], F.lit(0)) != 0,
        _line("  VT first seen (epoch): ", _s(vt["first_submission_date"])),
    )


def attachment_block(attachments: Column, intel: Column) -> Column:
    def one(a: Column, number: Column) -> Column:
        vt = _first(intel["file_results"], lambda r: r["target"] == a["sha256"])
        found = lines(
            F.concat(
                F.lit("  VirusTotal: "), _s(vt["malicious_count"]), F.lit("/"),
                _s(vt["total_engines"]), F.lit(" engines flagged"),
            ),
            _if_text("  VT type description: ", vt["type_description"]),
            _first_seen(vt),
            _if_text("  VT threat label: ", vt["threat_label"]),
        )
        hashed = lines(
            _line("  SHA-256: ", a["sha256"]),
            F.when(vt.isNotNull(), found).otherwise("  VirusTotal: hash not found in database"),
        )
        return lines(
            F.concat(F.lit("Attachment #"), number, F.lit(":")),
            _line("  Filename: ", a["filename"]),
            _line("  MIME type: ", text_or(a["mime_type"], "unknown")),
            F.when(
                a["size"].isNotNull(),
                F.concat(F.lit("  Size: "), _s(a["size"]), F.lit(" bytes")),
            ),
            F.when(has_text(a["sha256"]), hashed).otherwise("  SHA-256: (not provided by client)"),
        )

    return F.when(F.size(attachments) > 0, _numbered(attachments, one)).otherwise(
        fv.PROMPT_NO_ATTACHMENTS
    )


def prompts(rows: DataFrame) -> DataFrame:
    """``message_id, prompt``.

    ``rows`` carry the flags, ``prompt_body``, ``intel``, ``sender_history``,
    ``recent_emails_from_sender`` and the header columns.
    """
    head = {k: F.lit(v) for k, v in fv.PROMPT_HEADINGS.items()}
    blank = F.lit("")
    intel = F.col("intel")
    document = lines(
        head["metadata"], metadata_block(), blank,
        head["history"], history_block(F.col("sender_history")), blank,
        head["recent"], recent_block(F.col("recent_emails_from_sender")), blank,
        head["ip"], ip_block(intel["abuse_result"]), blank,
        head["findings"], findings_block(), blank,
        head["content"], text_or(text_or_empty(F.col("prompt_body")), "(empty body)"),
        head["content_end"], blank,
        head["urls"], url_block(intel), blank,
        head["reputation"], reputation_block(intel), blank,
        head["attachments"], attachment_block(F.col("attachments"), intel), blank,
        head["task"], F.lit(fv.PROMPT_TASK),
    )
    return rows.select("message_id", document.alias("prompt"))
