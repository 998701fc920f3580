"""Layer scores, composite, verdict and threat category.

All of it is one projection over the flag columns and the two optional structs
``intel`` (reputation gathered for the message) and ``analysis`` (language-model
answer), built up in a few named stages so that no expression is written twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk import schemas
from tamarisk.functions.text import has_text, non_null, sql_text, string_array, text_or
from tamarisk.operators.features import ALL_FLAGS
from tamarisk.params import RiskParams

LAYERS = list(fv.LAYER_WEIGHTS)


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read but never repeat.

    A filter on the verdict would be pushed below the projections by copying
    their expressions into it, and the copies multiply from stage to stage.  A
    one-row ``inline`` is where such copying ends; it adds no rows, no shuffle.
    The expressions are projected before, so that the generator itself reads
    plain columns only (field access inside a generator confuses pruning).
    """
    kept = [c for c in df.columns if c not in columns]
    staged = df.withColumns({f"_once_{n}": e for n, e in columns.items()})
    packed = F.array(F.struct(*[F.col(f"_once_{n}").alias(n) for n in columns]))
    return staged.select(*kept, F.inline(packed))


def signal(code, layer: str, points, severity, title, explanation) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(code).alias("code"),
        F.lit(layer).alias("layer"),
        as_col(points).cast("int").alias("score"),
        as_col(severity).alias("severity"),
        as_col(title).alias("title"),
        as_col(explanation).alias("explanation"),
    )


def flag_signals(layer: str) -> list[Column]:
    """One nullable signal per flag of the layer, in report order."""
    made = []
    for lay, flag, code, points, severity, _raw, title, text in fv.FLAG_SIGNALS:
        if lay == layer:
            fields = {
                "code": sql_text(code), "layer": sql_text(lay), "score": str(points),
                "severity": sql_text(severity), "title": sql_text(title),
                "explanation": sql_text(text),
            }
            packed = ", ".join(f"'{name}', {value}" for name, value in fields.items())
            made.append(F.expr(f"CASE WHEN {flag} THEN named_struct({packed}) END"))
    return made


def flag_points(layer: str) -> Column:
    """Sum of the raw points of the layer's raised flags."""
    terms = [
        f"IF({flag}, {raw}, 0)" for lay, flag, _c, _p, _s, raw, *_ in fv.FLAG_SIGNALS if lay == layer
    ]
    return F.expr(" + ".join(terms))


def auth_score() -> Column:
    s, d, m = F.col("spf_fail"), F.col("dkim_fail"), F.col("dmarc_fail")
    return F.when(s & d & m, 100).when(m, 80).when(s & d, 55).when(s | d, 30).otherwise(0)


def worst(results: Column, field: str = "malicious_count") -> Column:
    """Largest value of the field over an array of results; 0 for none."""
    return F.coalesce(F.array_max(results[field]), F.lit(0))


def _counted(code: str, n: Column, points: Column, severity) -> Column:
    title, text = fv.INTEL_TEXTS[code]
    shown = n.cast("string")
    return signal(
        code, "threat_intel", points, severity,
        F.format_string(title, shown), F.format_string(text, shown),
    )


def _intel_signals(intel: Column) -> Column:
    """Array of the signals raised by reputation, in report order."""
    url_n, file_n = F.col("max_url_engines"), F.col("max_file_engines")
    dom_n, ip_n, conf = F.col("max_domain_engines"), F.col("max_ip_engines"), F.col("abuse_confidence")
    grade = lambda n, high: F.when(n >= high, "high").otherwise("medium")
    single = F.array(
        F.when(url_n > 0, _counted("VT_URL_FLAGGED", url_n, F.least(F.lit(35), url_n * 5), grade(url_n, 5))),
        F.when(file_n > 0, _counted("VT_FILE_FLAGGED", file_n, F.least(F.lit(40), file_n * 6), grade(file_n, 5))),
        F.when(conf >= 50, _counted("ABUSEIPDB_FLAGGED", conf, F.least(F.lit(30), F.floor(conf / 4)), grade(conf, 75))),
        F.when(dom_n > 0, _counted("VT_DOMAIN_FLAGGED", dom_n, F.least(F.lit(20), dom_n * 4), "medium")),
        F.when(ip_n > 0, _counted("VT_IP_FLAGGED", ip_n, F.least(F.lit(20), ip_n * 4), "medium")),
    )
    gsb_title, gsb_text = fv.INTEL_TEXTS["GSB_FLAGGED"]
    feed_title, feed_text = fv.INTEL_TEXTS["URLHAUS_FLAGGED"]
    browsing = F.transform(
        threats(intel),
        lambda r: signal(
            "GSB_FLAGGED", "threat_intel", 35, "high", gsb_title,
            F.format_string(gsb_text, F.array_join(r["threat_types"], ", ")),
        ),
    )
    feed = F.transform(
        feed_hits(intel),
        lambda r: signal(
            "URLHAUS_FLAGGED", "threat_intel", 30, "high", feed_title,
            F.format_string(feed_text, text_or(F.array_join(r["tags"], ", "), "malware")),
        ),
    )
    return F.concat(non_null(single), browsing, feed)



def threats(intel: Column) -> Column:
    """Safe-browsing results that are threats (never null)."""
    hits = F.filter(intel["safe_browsing_results"], lambda r: F.coalesce(r["is_threat"], F.lit(False)))
    return F.coalesce(hits, F.array().cast(f"array<{schemas.SAFE_BROWSING}>"))


def feed_hits(intel: Column) -> Column:
    """Malware-feed results that are listed (never null)."""
    hits = F.filter(intel["malware_feed_results"], lambda r: F.coalesce(r["in_database"], F.lit(False)))
    return F.coalesce(hits, F.array().cast(f"array<{schemas.MALWARE_FEED}>"))


INTEL_MEASURES = [
    "max_url_engines", "max_file_engines", "abuse_confidence", "max_domain_engines",
    "max_ip_engines", "gsb_threats", "feed_hits",
]


def with_intel_measures(df: DataFrame, intel: str | None = "intel") -> DataFrame:
    """Worst engine counts, abuse confidence and hit counts per message."""
    if intel is None:
        return df.withColumns({m: F.lit(0) for m in INTEL_MEASURES})
    i = F.col(intel)
    return df.withColumns(
        {
            "max_url_engines": worst(i["url_results"]),
            "max_file_engines": worst(i["file_results"]),
            "abuse_confidence": F.coalesce(i["abuse_result"]["abuse_confidence"], F.lit(0)),
            "max_domain_engines": worst(i["domain_results"]),
            "max_ip_engines": worst(i["ip_results"]),
            "gsb_threats": F.size(threats(i)),
            "feed_hits": F.size(feed_hits(i)),
        }
    )


def external_score() -> Column:
    """Score from reputation alone, over the measures."""
    capped = lambda n, by: F.least(F.lit(100), F.col(n) * by)
    hit = lambda n: F.when(F.col(n) > 0, 90).otherwise(0)
    return F.greatest(
        capped("max_url_engines", 15), capped("max_file_engines", 15),
        F.col("abuse_confidence"),
        capped("max_domain_engines", 10), capped("max_ip_engines", 10),
        hit("gsb_threats"), hit("feed_hits"),
    )


def ai_severity(score: Column) -> Column:
    return F.when(score < 35, "low").when(score < 70, "medium").otherwise("high")


def with_layers(
    df: DataFrame,
    params: RiskParams = RiskParams(),
    intel: str | None = "intel",
    analysis: str | None = "analysis",
) -> DataFrame:
    """Add ``<layer>_score``, ``<layer>_confidence``, ``signals`` and ``evidence``.

    ``intel=None`` means reputation was not gathered at all (confidence 0.7 of
    the threat layer); a gathered but empty record keeps confidence 1.0.
    """
    df = with_intel_measures(df, intel)
    if analysis is None:
        available, raw_ai = F.lit(False), F.lit(0)
    else:
        available = F.coalesce(F.col(analysis)["available"], F.lit(False))
        raw_ai = F.coalesce(F.col(analysis)["score"], F.lit(0))
    df = evaluate_once(
        df,
        {
            **{name: F.col(name) for name in ALL_FLAGS + INTEL_MEASURES},
            "ai_available": available,
            "ai_raw_score": raw_ai,
        },
    )
    df = df.withColumns(
        {
            "identity_points": flag_points("identity"),
            "heuristic_points": flag_points("threat_intel"),
            "content_points": flag_points("content"),
        }
    )
    heuristic = F.least(F.lit(100), F.col("heuristic_points"))
    df = df.withColumns(
        {
            "auth_score": auth_score(),
            "identity_score": F.least(F.lit(100), F.col("identity_points")),
            "heuristic_score": heuristic,
            "external_score": external_score(),
            "content_score": F.least(F.lit(100), F.col("content_points")),
            "claude_score": F.when(
                F.col("ai_available"), F.greatest(F.lit(0), F.least(F.lit(100), "ai_raw_score"))
            ).otherwise(0),
            "threat_intel_confidence": F.lit(0.7 if intel is None else 1.0),
            "claude_confidence": F.when(F.col("ai_available"), 1.0).otherwise(0.0),
        }
    )
    return df.withColumns(
        {
            "threat_intel_score": F.greatest("heuristic_score", "external_score"),
            "signals": _all_signals(intel, analysis),
            "signal_codes": _signal_codes(),
            "evidence": _evidence(analysis),
        }
    )


def _signal_codes() -> Column:
    """The distinct codes of ``signals``, without building their texts."""
    raised = [
        F.expr(f"CASE WHEN {flag} THEN {sql_text(code)} END") for _l, flag, code, *_ in fv.FLAG_SIGNALS
    ]
    measured = {
        "VT_URL_FLAGGED": F.col("max_url_engines") > 0,
        "VT_FILE_FLAGGED": F.col("max_file_engines") > 0,
        "ABUSEIPDB_FLAGGED": F.col("abuse_confidence") >= 50,
        "VT_DOMAIN_FLAGGED": F.col("max_domain_engines") > 0,
        "VT_IP_FLAGGED": F.col("max_ip_engines") > 0,
        "GSB_FLAGGED": F.col("gsb_threats") > 0,
        "URLHAUS_FLAGGED": F.col("feed_hits") > 0,
        fv.AI_SIGNAL_CODE: F.col("ai_available"),
    }
    raised += [F.when(holds, F.lit(code)) for code, holds in measured.items()]
    return non_null(F.array(*raised))


def _ai_signal(analysis: str) -> Column:
    a, score = F.col(analysis), F.col("claude_score")
    first = F.get(a["main_findings"], F.lit(0))
    told = (
        F.when(has_text(first), first)
        .when(has_text(a["potential_damage"]), a["potential_damage"])
        .otherwise(F.lit(fv.AI_SIGNAL_FALLBACK))
    )
    return F.when(
        F.col("ai_available"),
        signal(
            fv.AI_SIGNAL_CODE, "claude",
            F.greatest(F.lit(1), F.floor(score / 5)), ai_severity(score),
            F.format_string(fv.AI_SIGNAL_TITLE, score.cast("string"), a["threat_category"]),
            told,
        ),
    )


def _all_signals(intel: str | None, analysis: str | None) -> Column:
    kind = f"array<{schemas.SIGNAL}>"
    groups = [
        non_null(
            F.array(*flag_signals("auth"), *flag_signals("identity"), *flag_signals("threat_intel"))
        ).cast(kind)
    ]
    if intel is not None:
        groups.append(_intel_signals(F.col(intel)).cast(kind))
    last = flag_signals("content")
    if analysis is not None:
        last = last + [_ai_signal(analysis)]
    groups.append(non_null(F.array(*last)).cast(kind))
    return F.concat(*groups)


def _evidence(analysis: str | None) -> Column:
    category = F.lit(None).cast("string")
    if analysis is not None:
        category = F.when(F.col("ai_available"), F.col(analysis)["threat_category"])
    return F.struct(
        F.struct("spf_fail", "dkim_fail", "dmarc_fail").alias("auth"),
        F.struct(F.col("identity_points").alias("raw_sum")).alias("identity"),
        F.struct("heuristic_score", "external_score", *INTEL_MEASURES).alias("threat_intel"),
        F.struct(F.col("content_points").alias("raw_sum")).alias("content"),
        F.struct(
            "claude_score", category.alias("threat_category"),
            F.col("ai_available").alias("available"),
        ).alias("claude"),
    )


def layer_records() -> Column:
    """``layer_scores``: one record per layer, in report order."""
    confidence = {
        "threat_intel": F.col("threat_intel_confidence"),
        "claude": F.col("claude_confidence"),
    }
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.col(f"{name}_score").alias("score"),
                confidence.get(name, F.lit(1.0)).alias("confidence"),
                F.lit(weight).alias("weight"),
            )
            for name, weight in fv.LAYER_WEIGHTS.items()
        ]
    )


def composite() -> Column:
    """Weighted sum of the layers, rounded half to even, within 0..100."""
    total = (
        F.col("auth_score") * F.lit(fv.LAYER_WEIGHTS["auth"])
        + F.col("identity_score") * F.lit(fv.LAYER_WEIGHTS["identity"])
        + F.col("threat_intel_score") * F.lit(fv.LAYER_WEIGHTS["threat_intel"])
        * F.col("threat_intel_confidence")
        + F.col("content_score") * F.lit(fv.LAYER_WEIGHTS["content"])
        + F.col("claude_score") * F.lit(fv.LAYER_WEIGHTS["claude"]) * F.col("claude_confidence")
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(total).cast("int")))


def proven_triggers(intel: Column, params: RiskParams) -> Column:
    """Triggers of single sources; the reputation of the sending IP is no trigger."""
    n_min = params.proven_engines

    def engines(field: str, code: str) -> Column:
        hits = F.filter(intel[field], lambda r: F.coalesce(r["malicious_count"] >= n_min, F.lit(False)))
        names = F.transform(
            hits,
            lambda r: F.concat(F.lit(code + ":"), r["malicious_count"].cast("string"), F.lit("_engines")),
        )
        return F.coalesce(names, F.array().cast("array<string>"))

    conf = intel["abuse_result"]["abuse_confidence"]
    abuse = non_null(
        F.array(
            F.when(
                conf >= params.proven_abuse_confidence,
                F.concat(F.lit("ABUSEIPDB_FLAGGED:"), conf.cast("string"), F.lit("%")),
            )
        )
    )
    browsing = F.transform(
        threats(intel),
        lambda r: F.concat(
            F.lit("GSB_FLAGGED:"), text_or(F.array_join(r["threat_types"], ","), "threat")
        ),
    )
    feed = F.transform(
        feed_hits(intel),
        lambda r: F.concat(F.lit("URLHAUS_FLAGGED:"), text_or(r["threat"], "malware")),
    )
    return F.concat(
        engines("url_results", "VT_URL_FLAGGED"),
        engines("file_results", "VT_FILE_FLAGGED"),
        engines("domain_results", "VT_DOMAIN_FLAGGED"),
        abuse, browsing, feed,
    )


def combination_triggers() -> Column:
    """Triggers of flag combinations."""
    names = []
    for trigger, flags in fv.COMBINATIONS.items():
        holds = F.lit(True)
        for flag in flags:
            holds = holds & F.col(flag)
        names.append(F.when(holds, F.lit(trigger)))
    return non_null(F.array(*names))


def with_verdict(
    df: DataFrame, params: RiskParams = RiskParams(), intel: str | None = "intel"
) -> DataFrame:
    """Composite, level and quarantine decision over the layer scores."""
    triggers = combination_triggers()
    if intel is not None:
        triggers = F.concat(proven_triggers(F.col(intel), params), triggers)
    threshold = F.when(F.col("ai_available"), params.high_risk_threshold).otherwise(
        min(params.high_risk_threshold, params.no_ai_high_risk_threshold)
    )
    df = evaluate_once(
        df,
        {
            "composite_score": composite(),
            "effective_threshold": threshold,
            "override_triggers": triggers,
        },
    )
    comp, limit = F.col("composite_score"), F.col("effective_threshold")
    overridden = F.size("override_triggers") > 0
    df = df.withColumns(
        {
            "score": F.when(overridden, F.greatest(comp, F.lit(90))).otherwise(comp),
            "risk_level": F.when(overridden | (comp >= limit), "Malicious")
            .when(comp >= params.alert_threshold, "Suspicious")
            .otherwise("Safe"),
            "action_taken": F.when(overridden | (comp >= limit), "MOVE_TO_TRASH").otherwise("NONE"),
            "quarantine_reason": F.when(overridden, F.lit(fv.OVERRIDE_REASON))
            .when(comp >= limit, F.lit(fv.COMPOSITE_REASON))
            .otherwise(""),
            "triggered_by": F.when(overridden, F.col("override_triggers"))
            .when(
                comp >= limit,
                F.array(F.concat(F.lit("composite_score>="), limit.cast("string"))),
            )
            .otherwise(F.array().cast("array<string>")),
        }
    )
    return df.withColumns(
        {
            "alert": F.col("score") >= params.alert_threshold,
            "threshold": F.lit(params.alert_threshold),
            "quarantine_action": F.struct(
                "action_taken", F.col("quarantine_reason").alias("reason"), "triggered_by"
            ),
        }
    )


def fallback_category(codes: Column, risk_level: Column) -> Column:
    """Category from the codes of the raised signals, for when no model answer
    is there; pass ``signals["code"]`` or ``signal_codes``."""
    any_of = lambda group: F.arrays_overlap(codes, string_array(group))
    impersonation = any_of(fv.IMPERSONATION_CODES)
    return (
        F.when(F.size(codes) == 0, "SAFE")
        .when(risk_level == "Safe", "SUSPICIOUS")
        .when(any_of(fv.MALWARE_CODES), "MALWARE_DELIVERY")
        .when(F.array_contains(codes, "FINANCIAL_REQUEST") & impersonation, "BEC")
        .when(any_of(fv.PHISHING_CODES), "PHISHING")
        .when(impersonation, "IMPERSONATION")
        .when(any_of(fv.SOCIAL_CODES), "SOCIAL_ENGINEERING")
        .otherwise("SUSPICIOUS")
    )


def category_actions(category: Column, risk_level: Column) -> Column:
    """Recommended actions of a category; none for Safe."""
    known = F.create_map(
        *[
            x
            for name, texts in fv.CATEGORY_ACTIONS.items()
            for x in (F.lit(name), string_array(texts))
        ]
    )
    listed = F.coalesce(
        F.try_element_at(known, category), string_array(fv.CATEGORY_ACTIONS["SUSPICIOUS"])
    )
    return F.when(risk_level == "Safe", string_array([])).otherwise(listed)


def with_category(df: DataFrame, analysis: str | None = "analysis") -> DataFrame:
    """Threat category and actions; an available model answer wins."""
    category = fallback_category(F.col("signal_codes"), F.col("risk_level"))
    if analysis is not None:
        category = F.when(F.col("ai_available"), F.col(analysis)["threat_category"]).otherwise(category)
    df = df.withColumn("threat_category", category)
    actions = category_actions(F.col("threat_category"), F.col("risk_level"))
    if analysis is not None:
        advised = F.col(analysis)["do"]
        actions = F.when(F.col("ai_available") & (F.size(advised) > 0), advised).otherwise(actions)
    return df.withColumns({"actions": actions, "reasons": F.col("signals")["title"]})


def score(
    flagged: DataFrame,
    params: RiskParams = RiskParams(),
    intel: str | None = "intel",
    analysis: str | None = "analysis",
) -> DataFrame:
    """Verdict columns for rows that carry the 27 flags.

    Pass ``intel=None`` and ``analysis=None`` to score from the flags alone.
    """
    layered = with_layers(flagged, params, intel, analysis)
    judged = with_verdict(layered, params, intel)
    return with_category(judged, analysis).withColumn("layer_scores", layer_records())
