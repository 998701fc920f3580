"""Messages to verdicts, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk.functions.text import text_or_empty
from tamarisk.operators.answers import parse_answers, with_analysis
from tamarisk.operators.features import (
    HISTORY_FLAGS,
    INTEL_FLAGS,
    with_body_flags,
    with_history_flags,
    with_intel_flags,
    without_flags,
)
from tamarisk.operators.history import with_sender_history
from tamarisk.operators.intel import Snapshots, with_intel
from tamarisk.operators.layout import spread
from tamarisk.operators.prompts import prompt_body, prompts
from tamarisk.operators.reports import with_explanation
from tamarisk.operators.scoring import score
from tamarisk.params import RiskParams

BODIES = ["body_text", "body_html"]


def flagged_messages(messages: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Flags of the message itself; the bodies end here, nothing wide moves on.

    Two short excerpts stay for the reports; a plan that writes no report does
    not compute them.
    """
    excerpts = {
        "alert_snippet": F.substring(text_or_empty(F.col("body_text")), 1, fv.ALERT_SNIPPET_CHARS),
        "prompt_body": prompt_body(F.col("body_text")),
    }
    return with_body_flags(spread(messages), params).withColumns(excerpts).drop(*BODIES)


def prompt_rows(
    messages: DataFrame,
    snapshots: Snapshots,
    mailbox: DataFrame,
    params: RiskParams = RiskParams(),
) -> DataFrame:
    """``message_id, prompt`` of every message, for batch inference."""
    rows = flagged_messages(messages, params)
    rows = with_sender_history(rows, mailbox, params, recent=True, messages=messages)
    return prompts(with_intel(rows, snapshots, params, messages))


def offline_verdicts(messages: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Score from the message alone: no reputation, history or model answer."""
    flagged = without_flags(flagged_messages(messages, params), INTEL_FLAGS + HISTORY_FLAGS)
    return with_explanation(score(flagged, params, intel=None, analysis=None))


def verdicts(
    messages: DataFrame,
    snapshots: Snapshots,
    mailbox: DataFrame | None = None,
    raw_answers: DataFrame | None = None,
    params: RiskParams = RiskParams(),
    recent: bool = False,
) -> DataFrame:
    """Verdict of every message.

    Order of work: flags from the text (map side only), then the narrow rows
    meet history, reputation and answers, all keyed by mailbox and message, then one
    projection scores.  Without ``mailbox`` the messages' own ``sender_history``
    is used if they have one.
    """
    rows = flagged_messages(messages, params)
    if mailbox is not None:
        rows = with_sender_history(rows, mailbox, params, recent=recent, messages=messages)
    if raw_answers is not None:
        dated = [c for c in ("answered_at",) if c in raw_answers.columns]
        rows = with_analysis(rows, parse_answers(raw_answers, *dated))
    return judged(rows, snapshots, params, messages)


def judged(
    rows: DataFrame, snapshots: Snapshots, params: RiskParams = RiskParams(), messages: DataFrame | None = None
) -> DataFrame:
    """Verdict of flagged messages that have, where it is known, ``sender_history`` and ``analysis``.

    Give the plain ``messages`` where ``rows`` is a longer plan.
    """
    if "sender_history" in rows.columns:
        rows = with_history_flags(rows, params)
    else:
        rows = without_flags(rows, HISTORY_FLAGS)
    rows = with_intel_flags(with_intel(rows, snapshots, params, messages), params)
    analysis = "analysis" if "analysis" in rows.columns else None
    return with_explanation(score(rows, params, analysis=analysis))
