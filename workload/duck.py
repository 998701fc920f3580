"""SQL building blocks of the DuckDB twins."""

from __future__ import annotations

from tamarisk import fixed_values as fv
from workload.mail import DUCK_MAIL


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def has_word(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w.lower())})" for w in words) + ")"


def ends(column: str, endings) -> str:
    return "(" + " OR ".join(f"ends_with({column}, {text(e)})" for e in endings) + ")"


def one_of(column: str, values) -> str:
    return f"{column} IN (" + ", ".join(text(v) for v in values) + ")"


def _brand_rule() -> str:
    rules = []
    for brand, own in fv.BRAND_DOMAINS.items():
        ours = " OR ".join(
            f"lower(from_domain) = {text(o)} OR ends_with(lower(from_domain), {text('.' + o)})" for o in own
        )
        rules.append(f"(contains(dn, {text(brand)}) AND NOT ({ours}))")
    return " OR ".join(rules)


def _mime_rule() -> str:
    kinds = []
    for mime, own in fv.MIME_ENDINGS.items():
        good = " OR ".join(
            f"regexp_extract(lower(filename), '[.][^.]*$') = {text(e)}" for e in own
        )
        kinds.append(f"(lower(trim(mime_type)) = {text(mime)} AND NOT ({good}))")
    return "(" + " OR ".join(kinds) + ")"


def _double_rule() -> str:
    decoys = "|".join(e[1:] for e in fv.DECOY_ENDINGS)
    risky = "|".join(
        e[1:] for e in fv.EXECUTABLE_ENDINGS + fv.MACRO_ENDINGS + fv.ARCHIVE_ENDINGS
    )
    return f"regexp_matches(lower(filename), '[.]({decoys})[.]({risky})$')"


# one row per (message, URL, claim in its visible text)
CLAIMS = """claims AS (
  SELECT d, rtrim(lower(c), '.') AS claim, ltrim(lower(domain), '.') AS target
  FROM (SELECT d, domain, unnest(regexp_extract_all(visible_text,
        '(?i)(?:https?://)?([a-z0-9][a-z0-9\\-]*\\.[a-z0-9\\-.]+)', 1)) AS c
        FROM mu WHERE visible_text <> '' AND domain <> ''))"""

FEATURES = f"""
uf AS (SELECT d, count(*) AS n,
  bool_or({has_word('lower(url)', fv.LOGIN_URL_WORDS)}) AS login,
  bool_or({has_word('lower(url)', fv.RISKY_URL_WORDS)}) AS risky,
  bool_or(coalesce({one_of('domain', fv.SHORTENERS)}, false)) AS short FROM mu GROUP BY d),
{CLAIMS},
cf AS (SELECT d, bool_or(length(claim) >= 4 AND claim <> target
  AND NOT ends_with(target, '.' || claim) AND NOT ends_with(claim, '.' || target)) AS bad
  FROM claims GROUP BY d),
af AS (SELECT d, count(*) AS n,
  bool_or({ends('lower(filename)', fv.EXECUTABLE_ENDINGS)}) AS exe,
  bool_or({ends('lower(filename)', fv.MACRO_ENDINGS)}) AS macro,
  bool_or({ends('lower(filename)', fv.ARCHIVE_ENDINGS)}) AS archive,
  bool_or({_double_rule()}) AS dbl,
  bool_or({_mime_rule()}) AS mis FROM ma GROUP BY d),
mt AS (SELECT *, lower(coalesce(subject, '') || ' ' || coalesce(body_text, '') || ' ' ||
  regexp_replace(coalesce(body_html, ''), '<[^>]+>', ' ', 'g')) AS t,
  coalesce(lower(trim(regexp_extract(from_email, '^"?([^"<]*)"?[ ]*<', 1))), '') AS dn FROM m),
f AS (SELECT mt.d, message_id, from_domain, received_at,
  coalesce(regexp_matches(authentication_results, '(?i)spf\\s*=\\s*fail'), false) AS spf_fail,
  coalesce(regexp_matches(authentication_results, '(?i)dkim\\s*=\\s*fail'), false) AS dkim_fail,
  coalesce(regexp_matches(authentication_results, '(?i)dmarc\\s*=\\s*fail'), false) AS dmarc_fail,
  coalesce(from_domain <> '' AND reply_to_domain <> '' AND from_domain <> reply_to_domain, false) AS reply_to_mismatch,
  coalesce(({has_word('from_domain', fv.SENDER_DOMAIN_WORDS)} AND NOT {ends('from_domain', fv.SENDER_DOMAIN_EXEMPT_ENDINGS)})
    OR contains(lower(from_domain), 'xn--') OR {ends('lower(from_domain)', fv.BAD_TLDS)}, false) AS suspicious_sender_domain,
  coalesce(dn <> '' AND ({_brand_rule()}
    OR (regexp_matches(dn, '[\\w.+\\-]+@[\\w\\-]+\\.[\\w.\\-]+')
        AND rtrim(regexp_extract(dn, '[\\w.+\\-]+@([\\w\\-]+\\.[\\w.\\-]+)', 1), '.') <> lower(from_domain))), false) AS display_name_spoofing,
  coalesce({one_of('lower(from_domain)', fv.FREE_PROVIDERS)} AND {has_word('dn', fv.ROLE_WORDS)}, false) AS free_provider_spoofing,
  coalesce(uf.n, 0) > 0 AS has_urls,
  coalesce(uf.login, false) AS has_login_or_verification_url,
  coalesce(uf.short, false) AS has_url_shortener,
  coalesce(uf.risky, false) AS has_suspicious_url_keywords,
  coalesce(cf.bad, false) AS has_link_text_href_mismatch,
  {has_word('t', fv.URGENT_PHRASES)} AS urgent_language,
  {has_word('t', fv.FINANCIAL_PHRASES)} AS financial_request_language,
  {has_word('t', fv.CREDENTIAL_PHRASES)} AS credential_request_language,
  {has_word('t', fv.GREETING_PHRASES)} AS generic_greeting,
  coalesce(af.n, 0) > 0 AS has_attachments,
  coalesce(af.exe, false) AS has_executable_attachment,
  coalesce(af.macro, false) AS has_macro_attachment,
  coalesce(af.archive, false) AS has_archive_attachment,
  coalesce(af.dbl, false) AS has_double_extension_attachment,
  coalesce(af.mis, false) AS has_mime_extension_mismatch
  FROM mt LEFT JOIN uf ON uf.d = mt.d LEFT JOIN cf ON cf.d = mt.d LEFT JOIN af ON af.d = mt.d)"""


def _raw(layer: str) -> str:
    terms = [
        f"CASE WHEN {flag} THEN {raw} ELSE 0 END"
        for lay, flag, _c, _p, _s, raw, _t, _e in fv.FLAG_SIGNALS
        if lay == layer
    ]
    return " + ".join(terms)


# Scoring over a CTE ``g`` that has all flags, the seven intel measures, the
# gathered proven triggers ``proven`` (text[]), ai_ok, ai_score, ai_category
# and ``tc`` (confidence of the threat layer).
SCORED = f"""
l AS (SELECT *,
  CASE WHEN spf_fail AND dkim_fail AND dmarc_fail THEN 100 WHEN dmarc_fail THEN 80
       WHEN spf_fail AND dkim_fail THEN 55 WHEN spf_fail OR dkim_fail THEN 30 ELSE 0 END AS auth_score,
  least(100, {_raw('identity')}) AS identity_score,
  greatest(least(100, {_raw('threat_intel')}), least(100, max_url_engines * 15), least(100, max_file_engines * 15),
    abuse_confidence, least(100, max_domain_engines * 10), least(100, max_ip_engines * 10),
    CASE WHEN gsb_threats > 0 OR feed_hits > 0 THEN 90 ELSE 0 END) AS threat_intel_score,
  least(100, {_raw('content')}) AS content_score,
  CASE WHEN ai_ok THEN least(100, greatest(0, ai_score)) ELSE 0 END AS claude_score FROM g),
c AS (SELECT *,
  CAST(least(100, greatest(0, round_even(CAST(auth_score * 0.10 + identity_score * 0.15 + threat_intel_score * 0.25 * tc
    + content_score * 0.10 + CASE WHEN ai_ok THEN claude_score * 0.40 ELSE 0 END AS DECIMAL(18, 6)), 0))) AS INTEGER) AS comp,
  CASE WHEN ai_ok THEN 70 ELSE 60 END AS lim,
  list_concat(proven, list_filter([
    CASE WHEN display_name_spoofing AND has_login_or_verification_url AND free_provider_spoofing THEN 'COMBO_BRAND_SPOOF_LOGIN_FREE_PROVIDER' END,
    CASE WHEN dmarc_fail AND has_executable_attachment AND is_first_time_sender THEN 'COMBO_DMARC_FAIL_EXE_FIRST_TIME' END,
    CASE WHEN has_double_extension_attachment AND is_first_time_sender THEN 'COMBO_DOUBLE_EXTENSION_FIRST_TIME' END,
    CASE WHEN display_name_spoofing AND has_link_text_href_mismatch THEN 'COMBO_BRAND_SPOOF_LINK_MISMATCH' END,
    CASE WHEN has_macro_attachment AND spf_fail AND dkim_fail THEN 'COMBO_MACRO_SPF_DKIM_FAIL' END],
    lambda x: x IS NOT NULL)) AS trig FROM l),
s AS (SELECT *,
  CASE WHEN len(trig) > 0 THEN greatest(comp, 90) ELSE comp END AS score,
  CASE WHEN len(trig) > 0 OR comp >= lim THEN 'Malicious' WHEN comp >= 35 THEN 'Suspicious' ELSE 'Safe' END AS risk_level,
  CASE WHEN len(trig) > 0 OR comp >= lim THEN 'MOVE_TO_TRASH' ELSE 'NONE' END AS action_taken,
  CASE WHEN len(trig) > 0 THEN array_to_string(trig, ';')
       WHEN comp >= lim THEN 'composite_score>=' || CAST(lim AS STRING) ELSE '' END AS triggered_by FROM c),
k AS (SELECT *,
  (has_executable_attachment OR has_macro_attachment OR has_double_extension_attachment OR has_mime_extension_mismatch
    OR recently_seen_attachment OR max_file_engines > 0 OR feed_hits > 0) AS k_malware,
  (credential_request_language OR has_login_or_verification_url OR max_url_engines > 0 OR gsb_threats > 0
    OR has_link_text_href_mismatch) AS k_phish,
  (display_name_spoofing OR dmarc_fail OR reply_to_mismatch OR free_provider_spoofing OR domain_recently_registered
    OR max_domain_engines > 0 OR max_ip_engines > 0 OR abuse_confidence >= 50 OR is_first_time_sender
    OR sender_has_spam_history) AS k_imp,
  (urgent_language OR generic_greeting) AS k_soc,
  (financial_request_language OR spf_fail OR dkim_fail OR suspicious_sender_domain OR has_archive_attachment
    OR has_url_shortener OR has_suspicious_url_keywords) AS k_rest FROM s),
v AS (SELECT *,
  CASE WHEN ai_ok THEN ai_category
       WHEN NOT (k_malware OR k_phish OR k_imp OR k_soc OR k_rest) THEN 'SAFE'
       WHEN risk_level = 'Safe' THEN 'SUSPICIOUS'
       WHEN k_malware THEN 'MALWARE_DELIVERY'
       WHEN financial_request_language AND k_imp THEN 'BEC'
       WHEN k_phish THEN 'PHISHING' WHEN k_imp THEN 'IMPERSONATION'
       WHEN k_soc THEN 'SOCIAL_ENGINEERING' ELSE 'SUSPICIOUS' END AS threat_category FROM k)"""

OFFLINE_G = """
g AS (SELECT *, false AS is_first_time_sender, false AS has_user_replied_to_sender,
  false AS sender_has_spam_history, false AS domain_recently_registered,
  false AS recently_seen_attachment, 0 AS max_url_engines, 0 AS max_file_engines,
  0 AS abuse_confidence, 0 AS max_domain_engines, 0 AS max_ip_engines, 0 AS gsb_threats,
  0 AS feed_hits, CAST([] AS VARCHAR[]) AS proven, false AS ai_ok, 0 AS ai_score,
  CAST(NULL AS VARCHAR) AS ai_category, 0.7 AS tc FROM f)"""


def with_mail(*ctes: str) -> str:
    return "WITH " + ",\n".join([DUCK_MAIL, *[c.strip() for c in ctes]]) + "\n"
