"""Feature and offline-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk.operators import features as ft
from tamarisk.operators import scoring as sc
from tamarisk.params import RiskParams
from tamarisk.plans.verdicts import flagged_messages
from workload import duck
from workload.mail import literal_table, messages
from workload.registry import query


def offline_flags(spark, sf):
    flagged = flagged_messages(messages(spark, sf))
    return ft.without_flags(flagged, ft.INTEL_FLAGS + ft.HISTORY_FLAGS)


def offline_scored(spark, sf):
    return sc.score(offline_flags(spark, sf), intel=None, analysis=None)


_FEATURES = duck.with_mail(duck.FEATURES)
_OFFLINE = duck.with_mail(duck.FEATURES, duck.OFFLINE_G, duck.SCORED)


@query("features", _FEATURES + "SELECT message_id, " + ", ".join(ft.BODY_FLAGS) + " FROM f")
def features(spark, sf):
    return flagged_messages(messages(spark, sf)).select("message_id", *ft.BODY_FLAGS)


@query(
    "flag_counts",
    _FEATURES
    + "SELECT count(*) AS n_messages, "
    + ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in ft.BODY_FLAGS)
    + " FROM f",
)
def flag_counts(spark, sf):
    return flagged_messages(messages(spark, sf)).agg(
        F.count("*").alias("n_messages"), *[F.count_if(f).alias(f) for f in ft.BODY_FLAGS]
    )


@query(
    "layer_scores_offline",
    _OFFLINE
    + " UNION ALL ".join(
        f"SELECT message_id, {pos} AS pos, '{name}' AS layer, CAST({name}_score AS INTEGER) AS score,"
        f" {conf} AS confidence_pct FROM l"
        for pos, (name, conf) in enumerate(
            [("auth", 100), ("identity", 100), ("threat_intel", 70), ("content", 100), ("claude", 0)]
        )
    ),
)
def layer_scores_offline(spark, sf):
    from tamarisk.sources.sinks import layer_score_rows

    return layer_score_rows(offline_scored(spark, sf)).select(
        "message_id", "pos", F.col("name").alias("layer"), "score",
        F.round(F.col("confidence") * 100).cast("int").alias("confidence_pct"),
    )


@query(
    "verdicts_offline",
    _OFFLINE
    + "SELECT message_id, score, risk_level, threat_category, action_taken, triggered_by FROM v",
)
def verdicts_offline(spark, sf):
    return offline_scored(spark, sf).select(
        "message_id", "score", "risk_level", "threat_category", "action_taken",
        F.array_join("triggered_by", ";").alias("triggered_by"),
    )


@query(
    "verdicts_by_parameters",
    _OFFLINE.replace("THEN 70 ELSE 60 END AS lim", "THEN 50 ELSE 22 END AS lim").replace("comp >= 35 THEN", "comp >= 0 THEN")
    + "SELECT message_id, score, risk_level, threat_category, score >= 0 AS alert, 0 AS threshold, triggered_by FROM v",
)
def verdicts_by_parameters(spark, sf):
    """Thresholds of one's own; an alert threshold of 0 is a threshold."""
    params = RiskParams(alert_threshold=0, high_risk_threshold=50, no_ai_high_risk_threshold=22)
    return sc.score(offline_flags(spark, sf), params, intel=None, analysis=None).select(
        "message_id", "score", "risk_level", "threat_category", "alert", "threshold",
        F.array_join("triggered_by", ";").alias("triggered_by"),
    )


_FLAG_SIGNAL_ROWS = " UNION ALL ".join(
    f"SELECT d, message_id, {i} AS ord, '{code}' AS code, '{layer}' AS layer, {points} AS points,"
    f" '{severity}' AS severity, {duck.text(title)} AS title, {duck.text(told)} AS explanation"
    f" FROM g WHERE {flag}"
    for i, (layer, flag, code, points, severity, _raw, title, told) in enumerate(fv.FLAG_SIGNALS)
)


@query(
    "signals_long",
    _OFFLINE
    + f"SELECT message_id, row_number() OVER (PARTITION BY d ORDER BY ord) - 1 AS pos, code, layer, points,"
    f" severity, title, explanation FROM ({_FLAG_SIGNAL_ROWS})",
)
def signals_long(spark, sf):
    from tamarisk.sources.sinks import signal_rows

    return signal_rows(offline_scored(spark, sf)).select(
        "message_id", F.col("pos").cast("long").alias("pos"), "code", "layer",
        F.col("score").alias("points"), "severity", "title", "explanation",
    )


@query(
    "category_fallback",
    _OFFLINE
    + "SELECT threat_category, risk_level, count(*) AS n_messages FROM v GROUP BY ALL",
)
def category_fallback(spark, sf):
    return (
        offline_scored(spark, sf)
        .groupBy("threat_category", "risk_level")
        .agg(F.count("*").alias("n_messages"))
    )


_ACTIONS = ", ".join(
    f"({duck.text(cat)}, {pos}, {duck.text(t)})"
    for cat, texts in fv.CATEGORY_ACTIONS.items()
    for pos, t in enumerate(texts)
)


@query(
    "recommended_actions",
    _OFFLINE
    + f"SELECT message_id, a.pos AS pos, a.action AS action FROM v JOIN (VALUES {_ACTIONS}) a(cat, pos, action)"
    " ON a.cat = v.threat_category WHERE risk_level <> 'Safe'",
)
def recommended_actions(spark, sf):
    return offline_scored(spark, sf).select(
        "message_id", F.posexplode("actions").alias("pos", "action")
    )


@query(
    "combination_triggers",
    _OFFLINE + "SELECT unnest(trig) AS trig, count(*) AS n FROM c GROUP BY 1",
)
def combination_triggers(spark, sf):
    return (
        offline_scored(spark, sf)
        .select(F.explode("override_triggers").alias("trig"))
        .groupBy("trig")
        .agg(F.count("*").alias("n"))
    )


@query(
    "brand_table",
    _FEATURES + f"SELECT message_id, coalesce(dn <> '' AND ({duck._brand_rule()}), false) AS brand_spoofing FROM mt",
)
def brand_table(spark, sf):
    pairs = [(b, d) for b, own in fv.BRAND_DOMAINS.items() for d in own]
    brands = literal_table(spark, ["brand", "domain"], pairs)
    return ft.brand_spoofed_by_table(messages(spark, sf), brands).drop("mailbox_id")
