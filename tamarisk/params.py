"""Job parameters (thresholds, limits, dictionaries)."""

from __future__ import annotations

from dataclasses import dataclass, field

from tamarisk import fixed_values as fv


@dataclass(frozen=True)
class Dictionaries:
    """Rule dictionaries; replace any of them to adapt the rules."""

    brands: dict = field(default_factory=lambda: dict(fv.BRAND_DOMAINS))
    free_providers: tuple = tuple(fv.FREE_PROVIDERS)
    role_words: tuple = tuple(fv.ROLE_WORDS)
    bad_tlds: tuple = tuple(fv.BAD_TLDS)
    shorteners: tuple = tuple(fv.SHORTENERS)
    login_url_words: tuple = tuple(fv.LOGIN_URL_WORDS)
    risky_url_words: tuple = tuple(fv.RISKY_URL_WORDS)
    urgent: tuple = tuple(fv.URGENT_PHRASES)
    financial: tuple = tuple(fv.FINANCIAL_PHRASES)
    credential: tuple = tuple(fv.CREDENTIAL_PHRASES)
    greetings: tuple = tuple(fv.GREETING_PHRASES)


@dataclass(frozen=True)
class RiskParams:
    """Thresholds of the verdict and limits of the lookups.

    Every value is taken as given (0 is a real threshold, not "unset").
    """

    alert_threshold: int = 35
    high_risk_threshold: int = 70
    no_ai_high_risk_threshold: int = 60
    proven_engines: int = 5
    proven_abuse_confidence: int = 75
    recent_domain_days: int = 30
    recent_file_hours: int = 72
    spam_history_count: int = 3
    spam_history_ratio: float = 0.30
    max_urls: int = fv.MAX_URLS_LOOKED_UP
    max_hashes: int = fv.MAX_HASHES_LOOKED_UP
    max_history_threads: int = fv.MAX_HISTORY_THREADS
    max_redirects: int = fv.MAX_REDIRECTS
    include_current_thread: bool = False
    observed_severity_order: bool = False
    # a key with at least this many rows is spread over `hot_key_slots` tasks
    hot_key_rows: int = 1_000_000
    hot_key_limit: int = 1_000
    hot_key_slots: int = 64
    product_name: str = "Mail Risk Analytics"
    subject_tag: str = "[MAIL RISK]"
    soc_address: str = "soc@example.com"
    dictionaries: Dictionaries = field(default_factory=Dictionaries)
