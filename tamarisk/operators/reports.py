"""Texts for people: explanation, findings, card data, alert and notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk.functions.text import has_text, lines, non_null, string_array, text_or, text_or_empty
from tamarisk.operators.history import iso_utc
from tamarisk.params import RiskParams


def signal_groups(codes: Column) -> Column:
    """The groups present among the signal codes."""
    known = F.create_map(*[F.lit(x) for pair in fv.SIGNAL_GROUPS.items() for x in pair])
    return F.array_distinct(
        F.transform(codes, lambda c: F.coalesce(F.try_element_at(known, c), F.lit("other")))
    )


def damage_narrative(groups: Column) -> Column:
    """One paragraph per group of danger, a general one when none applies."""
    has = lambda g: F.array_contains(groups, g)
    text = {k: F.lit(v) for k, v in fv.NARRATIVE.items()}
    paragraphs = non_null(
        F.array(
            F.when(has("attachment"), text["attachment"]),
            F.when(has("url") & has("social"), text["url_social"]).when(has("url"), text["url"]),
            F.when(has("identity") & has("auth"), text["identity_auth"])
            .when(has("identity"), text["identity"])
            .when(has("auth"), text["auth"]),
            F.when(has("social") & ~has("url") & ~has("attachment"), text["social_only"]),
        )
    )
    return F.when(F.size(paragraphs) > 0, F.array_join(paragraphs, "\n\n")).otherwise(text["other"])


def user_explanation(signals: Column, narrative: Column) -> Column:
    listed = F.array_join(
        F.transform(
            signals, lambda s: F.concat(F.lit("  • "), s["title"], F.lit(" — "), s["explanation"])
        ),
        "\n",
    )
    return F.when(F.size(signals) == 0, F.lit(fv.NO_SIGNALS_TEXT)).otherwise(
        F.concat(F.lit(fv.FINDINGS_HEADING), listed, F.lit(fv.MEANING_HEADING), narrative)
    )


def with_explanation(scored: DataFrame) -> DataFrame:
    """Add ``damage_narrative`` and ``user_explanation``."""
    told = scored.withColumn("damage_narrative", damage_narrative(signal_groups(F.col("signal_codes"))))
    return told.withColumn(
        "user_explanation", user_explanation(F.col("signals"), F.col("damage_narrative"))
    )


# --- findings and advice ----------------------------------------------------


def top_findings(scored: DataFrame, params: RiskParams = RiskParams()) -> Column:
    """Up to five findings: the model's own, else the gravest signals.

    Signals run high, medium, low and keep their order within a level; with
    ``observed_severity_order`` the high ones come last.
    """
    last = 3 if params.observed_severity_order else 0
    rank = lambda s: F.when(s == "high", last).when(s == "medium", 1).otherwise(2)
    ranked = F.array_sort(
        F.transform(
            F.col("signals"),
            lambda s, i: F.struct(
                rank(s["severity"]).alias("rank"), i.alias("pos"),
                F.concat(s["title"], F.lit(" — "), s["explanation"]).alias("text"),
            ),
        )
    )
    own = F.slice(F.transform(ranked, lambda r: r["text"]), 1, 5)
    if "analysis" not in scored.columns:
        return own
    found = F.col("analysis")["main_findings"]
    return F.when(F.col("ai_available") & (F.size(found) > 0), F.slice(found, 1, 5)).otherwise(own)


def advice(scored: DataFrame) -> tuple[Column, Column]:
    """Up to three things to do and not to do.

    An available model answer decides, even with an empty list.
    """
    do, dont = F.slice("actions", 1, 3), string_array([])
    if "analysis" in scored.columns:
        a = F.col("analysis")
        do = F.when(F.col("ai_available"), F.slice(a["do"], 1, 3)).otherwise(do)
        dont = F.when(F.col("ai_available"), F.slice(a["do_not"], 1, 3)).otherwise(dont)
    return do, dont


def ai_damage(scored: DataFrame) -> Column:
    """Damage text of the model answer; null when there is none."""
    if "analysis" not in scored.columns:
        return F.lit(None).cast("string")
    damage = F.col("analysis")["potential_damage"]
    return F.when(F.col("ai_available") & has_text(damage), damage)


def verdict_cards(
    scored: DataFrame, params: RiskParams = RiskParams(), already_quarantined: Column | None = None
) -> DataFrame:
    """What a verdict card shows; a Safe card shows level and score only."""
    do, dont = advice(scored)
    done = F.lit(False) if already_quarantined is None else already_quarantined
    shown = lambda c: F.when(F.col("risk_level") != "Safe", c)
    status = F.when(
        F.col("risk_level") == "Malicious",
        F.when(done, fv.CARD_STILL_IN_TRASH).when(
            F.col("action_taken") == "MOVE_TO_TRASH",
            F.concat(F.lit(fv.CARD_MOVED), text_or_empty(F.col("quarantine_reason"))),
        ),
    )
    return scored.select(
        "message_id", "risk_level", "score",
        shown(ai_damage(scored)).alias("potential_damage"),
        shown(dont).alias("what_not_to_do"),
        shown(do).alias("what_to_do"),
        shown(top_findings(scored, params)).alias("main_findings"),
        status.alias("status_line"),
    )


# --- security-team alerts ---------------------------------------------------


def _by_level(texts: dict) -> Column:
    return F.when(F.col("risk_level") == "Malicious", F.lit(texts["Malicious"])).otherwise(
        F.lit(texts["Suspicious"])
    )


def _engine_lines(results: Column, label: str, extra) -> Column:
    return F.array_join(
        F.transform(
            results,
            lambda r: lines(
                F.concat(F.lit(label), r["target"]),
                F.concat(
                    F.lit("  VirusTotal: "), r["malicious_count"].cast("string"), F.lit("/"),
                    r["total_engines"].cast("string"), F.lit(" engines"),
                ),
                extra(r),
            ),
        ),
        "\n",
    )


def _non_empty(text: Column) -> Column:
    return F.when(has_text(text), text)


def _intel_lines(intel: Column) -> Column:
    a = intel["abuse_result"]
    abuse = F.when(
        a.isNotNull(),
        lines(
            F.lit("AbuseIPDB:"),
            F.concat(F.lit("  Confidence: "), a["abuse_confidence"].cast("string"), F.lit("%")),
            F.concat(
                F.lit("  Reports: "), a["total_reports"].cast("string"), F.lit(" ("),
                a["distinct_reporters"].cast("string"), F.lit(" reporters)"),
            ),
            F.when(has_text(a["country_name"]), F.concat(F.lit("  Country: "), a["country_name"])),
            F.when(has_text(a["isp"]), F.concat(F.lit("  ISP: "), a["isp"])),
        ),
    )
    threat_names = lambda r: F.when(
        F.size(r["threat_names"]) > 0,
        F.concat(F.lit("  VT threats: "), F.array_join(r["threat_names"], ", ")),
    )
    type_line = lambda r: F.when(
        has_text(r["type_description"]), F.concat(F.lit("  Type: "), r["type_description"])
    )
    return lines(
        F.lit(fv.ALERT_INTEL),
        _non_empty(_engine_lines(intel["url_results"], "URL: ", threat_names)),
        _non_empty(_engine_lines(intel["file_results"], "Attachment hash: ", type_line)),
        abuse,
        F.lit(""),
    )


def _ai_lines(scored: DataFrame) -> Column:
    absent = lines(*[F.lit(t) for t in fv.ALERT_NO_AI], F.lit(""))
    if "analysis" not in scored.columns:
        return absent
    findings = F.array_join(
        F.transform(F.col("analysis")["main_findings"], lambda f: F.concat(F.lit("  - "), f)), "\n"
    )
    damage = ai_damage(scored)
    present = lines(
        F.lit(fv.ALERT_AI_HEADING), F.lit(fv.ALERT_FINDINGS), _non_empty(findings), F.lit(""),
        F.when(
            damage.isNotNull(),
            lines(F.lit(fv.ALERT_DAMAGE), F.concat(F.lit("  "), damage), F.lit("")),
        ),
    )
    return F.when(F.col("ai_available"), present).otherwise(absent)


def security_alerts(
    scored: DataFrame, params: RiskParams = RiskParams(), detected_at: str = "received_at"
) -> DataFrame:
    """Alert rows (subject and body) of Suspicious and Malicious messages.

    Needs ``alert_snippet`` (start of the body text), ``mailbox_id`` and the
    header columns next to the verdict.
    """
    sender = text_or(F.col("from_email"), fv.UNKNOWN_SENDER)
    level, points = F.col("risk_level"), F.col("score").cast("string")
    has_intel = "intel" in scored.columns
    field = lambda name, c: F.concat(F.lit(fv.ALERT_FIELDS[name].ljust(20)), c)
    subject = F.concat(
        F.lit(params.subject_tag + " "), _by_level(fv.ALERT_MARK), F.lit(" "), F.upper(level),
        F.lit(" ["), F.col("threat_category"), F.lit("] from "), sender, F.lit(" — "), points,
        F.lit("/100 — "), _by_level(fv.ALERT_TAG),
    )
    opening = _by_level({k: "\n".join(v) for k, v in fv.ALERT_OPENING.items()})
    ip = F.col("intel")["sender_ip"] if has_intel else F.lit(None).cast("string")
    raised = F.array_join(
        F.transform(F.col("signals"), lambda s: F.concat(F.lit("- "), s["title"])), "\n"
    )
    body = lines(
        *[F.lit(t) for t in fv.ALERT_HEAD], opening, F.lit(""),
        F.lit(fv.ALERT_METADATA),
        field("detected", iso_utc(F.col(detected_at))),
        field("recipient", text_or(F.col("mailbox_id"), "(unknown)")),
        field("rate", F.concat(points, F.lit(" / 100"))),
        field("level", level),
        field("category", F.col("threat_category")),
        field("action", _by_level(fv.ALERT_ACTION)), F.lit(""),
        F.lit(fv.ALERT_SENDER),
        field("from", sender),
        field("reply_to", text_or(F.col("reply_to_email"), "(none)")),
        field("domain", text_or_empty(F.col("from_domain"))),
        F.when(has_text(ip), field("ip", ip)), F.lit(""),
        _ai_lines(scored),
        F.lit(fv.ALERT_CONTENT),
        field("subject", text_or_empty(F.col("subject"))),
        F.lit(fv.ALERT_SNIPPET), text_or_empty(F.col("alert_snippet")), F.lit(""),
        *([_intel_lines(F.col("intel"))] if has_intel else []),
        F.lit(fv.ALERT_SIGNALS), _non_empty(raised), F.lit(""),
        F.lit(fv.ALERT_END), F.lit(""),
        F.lit(f"This is an automated alert from {params.product_name}."),
    )
    return scored.filter(level != "Safe").select(
        "message_id", "mailbox_id", "risk_level",
        F.lit(params.soc_address).alias("recipient"),
        subject.alias("alert_subject"), body.alias("alert_body"),
    )


# --- recipient notices ------------------------------------------------------


def recipient_notices(scored: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Notice rows of Malicious messages, for the owner of the mailbox."""
    sender = text_or(F.col("from_email"), fv.UNKNOWN_SENDER)
    reason = F.lit(fv.NOTICE_DEFAULT_REASON)
    if "analysis" in scored.columns:
        found = F.col("analysis")["main_findings"]
        reason = F.when(
            F.col("ai_available") & (F.size(found) > 0), F.get(found, F.lit(0))
        ).otherwise(reason)
    damage = ai_damage(scored)
    body = lines(
        F.lit(fv.NOTICE_TITLE), F.lit(""), F.lit(fv.NOTICE_GREETING), F.lit(""),
        F.concat(F.lit(fv.NOTICE_OPENING), sender, F.lit(".")), F.lit(""),
        F.lit(fv.NOTICE_DID), F.lit(fv.NOTICE_ACTION), F.lit(""),
        F.lit(fv.NOTICE_WHY), reason, F.lit(""),
        F.when(
            damage.isNotNull(), lines(F.lit(fv.NOTICE_COULD), damage, F.lit(""))
        ),
        F.lit(fv.NOTICE_SHOULD), *[F.lit(t) for t in fv.NOTICE_ADVICE], F.lit(""),
        F.lit(f"Your SOC team ({params.soc_address}) has been notified with full incident details."),
        F.lit(""), F.lit(f"— {params.product_name}"),
    )
    return scored.filter(
        (F.col("risk_level") == "Malicious") & has_text(F.col("mailbox_id"))
    ).select(
        "message_id", "mailbox_id",
        F.concat(F.lit(fv.NOTICE_SUBJECT), sender).alias("notice_subject"),
        body.alias("notice_body"),
    )
