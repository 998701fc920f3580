"""Layer scores over all flag combinations, goldens, rounding, parameters."""

import itertools
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk import schemas
from tamarisk.operators import features as ft
from tamarisk.operators import scoring as sc
from tamarisk.params import RiskParams
from tests.test_features import one_message

# fixed values: layer points of the flags, written down again on purpose
IDENTITY = {
    "display_name_spoofing": 50, "reply_to_mismatch": 30, "free_provider_spoofing": 30,
    "suspicious_sender_domain": 20, "domain_recently_registered": 30, "is_first_time_sender": 20,
    "sender_has_spam_history": 25,
}
THREAT = {
    "has_executable_attachment": 50, "has_macro_attachment": 40, "has_archive_attachment": 15,
    "has_double_extension_attachment": 35, "has_mime_extension_mismatch": 35,
    "recently_seen_attachment": 20, "has_login_or_verification_url": 20,
    "has_link_text_href_mismatch": 30, "has_url_shortener": 20, "has_suspicious_url_keywords": 15,
}
CONTENT = {
    "financial_request_language": 35, "credential_request_language": 35, "urgent_language": 25,
    "generic_greeting": 15,
}


def flags_frame(spark, raised):
    """One row per set of raised flags."""
    data = [(str(i), *[f in r for f in ft.ALL_FLAGS]) for i, r in enumerate(raised)]
    ddl = "message_id string, " + ", ".join(f"{f} boolean" for f in ft.ALL_FLAGS)
    return spark.createDataFrame(data, ddl)


@pytest.mark.parametrize("layer,points", [("identity", IDENTITY), ("threat_intel", THREAT), ("content", CONTENT)])
def test_every_combination(spark, layer, points):
    names = list(points)
    raised = [
        {n for n, on in zip(names, bits) if on}
        for bits in itertools.product([False, True], repeat=len(names))
    ]
    got = sc.score(flags_frame(spark, raised), intel=None, analysis=None).select(
        F.col("message_id").cast("int").alias("i"), f"{layer}_score"
    ).collect()
    for i, value in got:
        assert value == min(100, sum(points[n] for n in raised[i]))


def test_auth_layer(spark):
    names = ["spf_fail", "dkim_fail", "dmarc_fail"]
    want = {(): 0, (0,): 30, (1,): 30, (2,): 80, (0, 1): 55, (0, 2): 80, (1, 2): 80, (0, 1, 2): 100}
    combos = list(want)
    got = sc.score(
        flags_frame(spark, [{names[i] for i in c} for c in combos]), intel=None, analysis=None
    ).select("message_id", "auth_score").collect()
    for i, value in got:
        assert value == want[combos[int(i)]]


def test_composite_is_half_even(spark):
    values = [0, 5, 15, 20, 25, 35, 50, 55, 70, 85, 90, 95, 100]
    grid = list(itertools.product([0, 30, 55, 80, 100], values, values, [0, 25, 35, 60, 100], [0, 33, 85]))[::7]
    df = spark.createDataFrame(
        grid, "auth_score int, identity_score int, threat_intel_score int, content_score int, claude_score int"
    ).withColumns({"threat_intel_confidence": F.lit(1.0), "claude_confidence": F.lit(1.0)})
    for a, i, t, c, ai, got in df.select("*", sc.composite().alias("c")).drop(
        "threat_intel_confidence", "claude_confidence"
    ).collect():
        exact = Decimal(a) / 10 + Decimal(i) * 15 / 100 + Decimal(t) * 25 / 100 + Decimal(c) / 10 + Decimal(ai) * 4 / 10
        assert got == int(exact.quantize(Decimal(1), ROUND_HALF_EVEN))


def test_golden_message(spark):
    m = one_message(
        spark, subject="Urgent: verify your account password",
        from_email="Security Team <security@example-login.com>", from_domain="example-login.com",
        reply_to_email="attacker@gmail.com", reply_to_domain="gmail.com",
        authentication_results="spf=fail dkim=fail dmarc=fail",
        body_text="Urgent action required. Login now to verify your password.",
        urls=[("https://bit.ly/fake-login", "bit.ly", None)],
        attachments=[("invoice.xlsm", None, None, None)],
    )
    flagged = ft.without_flags(ft.with_body_flags(m), ft.INTEL_FLAGS + ft.HISTORY_FLAGS)
    row = sc.score(flagged, RiskParams(alert_threshold=60, high_risk_threshold=75), None, None).first()
    assert (row["auth_score"], row["identity_score"], row["threat_intel_score"], row["content_score"]) == (100, 50, 80, 60)
    assert row["composite_score"] == 38 and row["score"] == 90
    assert row["risk_level"] == "Malicious" and row["action_taken"] == "MOVE_TO_TRASH"
    assert row["threat_category"] == "MALWARE_DELIVERY" and row["alert"] is True
    assert row["triggered_by"] == ["COMBO_MACRO_SPF_DKIM_FAIL"]
    assert row["actions"] == fv.CATEGORY_ACTIONS["MALWARE_DELIVERY"]


@pytest.mark.parametrize("trigger", list(fv.COMBINATIONS))
def test_combination(spark, trigger):
    needed = fv.COMBINATIONS[trigger]
    sets = [set(needed)] + [set(needed) - {n} for n in needed]
    out = {r["message_id"]: r for r in sc.score(flags_frame(spark, sets), intel=None, analysis=None).collect()}
    assert trigger in out["0"]["override_triggers"] and out["0"]["score"] >= 90
    for i in range(1, len(sets)):
        assert trigger not in out[str(i)]["override_triggers"]


def test_a_raised_flag_never_lowers_a_layer(spark):
    base = [set(), {"spf_fail"}, {"dkim_fail"}, {"is_first_time_sender", "has_archive_attachment"}]
    sets = [s for b in base for s in [b] + [b | {f} for f in ft.ALL_FLAGS]]
    out = {int(r["message_id"]): r for r in sc.score(flags_frame(spark, sets), intel=None, analysis=None).collect()}
    step = len(ft.ALL_FLAGS) + 1
    for k in range(len(base)):
        for j in range(1, step):
            for layer in sc.LAYERS:
                assert out[k * step + j][f"{layer}_score"] >= out[k * step][f"{layer}_score"]


CATEGORIES = [
    (set(), "Safe", "SAFE"), ({"SPF_FAIL"}, "Safe", "SUSPICIOUS"),
    ({"URLHAUS_FLAGGED", "FINANCIAL_REQUEST"}, "Malicious", "MALWARE_DELIVERY"),
    ({"FINANCIAL_REQUEST", "DMARC_FAIL"}, "Suspicious", "BEC"),
    ({"FINANCIAL_REQUEST", "LOGIN_URL"}, "Suspicious", "PHISHING"),
    ({"REPLY_TO_MISMATCH"}, "Suspicious", "IMPERSONATION"),
    ({"URGENT_LANGUAGE"}, "Suspicious", "SOCIAL_ENGINEERING"),
    ({"SPF_FAIL", "FINANCIAL_REQUEST"}, "Suspicious", "SUSPICIOUS"),
]


def test_categories(spark):
    df = spark.createDataFrame(
        [(i, sorted(c), lv) for i, (c, lv, _) in enumerate(CATEGORIES)], "i int, codes array<string>, lv string"
    )
    got = dict(df.select("i", sc.fallback_category(F.col("codes"), F.col("lv"))).collect())
    assert [got[i] for i in range(len(CATEGORIES))] == [c[2] for c in CATEGORIES]


def with_answer(spark, flags, score, category="PHISHING", available=True, do=()):
    answer = (score, category, ["why"], "harm", list(do), [], available)
    extra = spark.createDataFrame([("0", answer)], f"message_id string, analysis {schemas.ANSWER}")
    return flags_frame(spark, [flags]).join(extra, "message_id")


def test_model_answer_sets_threshold_category_and_actions(spark):
    heavy = {"spf_fail", "dkim_fail", "dmarc_fail", "display_name_spoofing", "reply_to_mismatch",
             "free_provider_spoofing", "has_executable_attachment", "has_double_extension_attachment",
             "has_mime_extension_mismatch", "financial_request_language", "credential_request_language",
             "urgent_language", "generic_greeting"}
    off = sc.score(with_answer(spark, heavy, 100, available=False), intel=None).first()
    assert (off["effective_threshold"], off["claude_score"]) == (60, 0)
    assert off["composite_score"] == 52  # 10 + 15 + 17.5 + 10, half to even
    on = sc.score(with_answer(spark, heavy, 100, do=["call"]), intel=None).first()
    assert (on["effective_threshold"], on["composite_score"]) == (70, 92)
    assert on["threat_category"] == "PHISHING" and on["actions"] == ["call"]
    assert on["triggered_by"] == ["composite_score>=70"]
    assert on["signals"][-1]["title"] == "AI analysis: 100/100 (PHISHING)"


def test_zero_is_a_threshold(spark):
    row = sc.score(flags_frame(spark, [set()]), RiskParams(alert_threshold=0), None, None).first()
    assert row["risk_level"] == "Suspicious" and row["alert"] is True


def test_no_python_and_no_cartesian_in_the_plan(spark):
    plan = sc.score(flags_frame(spark, [set()]), intel=None, analysis=None)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "CartesianProduct" not in plan
