"""Redaction of personal data in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk.functions.text import bind, has_text, text_or_empty


# What a text must hold before a pattern can match at all.  Each check is a plain
# scan, far cheaper than the pattern, and most texts hold none of it.
_HAS_DIGIT = r"\p{Nd}"
_HAS_GROUP = r"\p{Nd}{3}"
# without any of these no pattern can match
_MAY_HOLD = r"[@=\p{Nd}]"


# How every match of a pattern starts.  Looked for first, so that the pattern itself is
# tried at few places; it matches the same.
_STARTS = {
    fv.IBAN_PATTERN: r"(?=[A-Z]{2}\p{Nd}{2})",
    fv.ID_NUMBER_PATTERN: r"(?=\p{Nd}{3}-)",
    fv.CARD_PATTERN: r"(?=\p{Nd})",
    fv.PHONE_PATTERN: r"(?=[+(\p{Nd}])",
}
_PHONE = _STARTS[fv.PHONE_PATTERN] + fv.PHONE_PATTERN


def redact_structured(text: Column) -> Column:
    """Addresses, account, identity and card numbers and long URL tokens."""
    out = text_or_empty(text)
    for pattern, mark, needed in (
        (fv.EMAIL_PATTERN, "[EMAIL]", lambda t: t.contains("@")),
        (fv.IBAN_PATTERN, "[IBAN]", lambda t: t.rlike(_HAS_DIGIT)),
        (fv.ID_NUMBER_PATTERN, "[ID_NUMBER]", lambda t: t.contains("-") & t.rlike(_HAS_GROUP)),
        (fv.CARD_PATTERN, "[CARD]", lambda t: t.rlike(_HAS_DIGIT)),
        (fv.URL_TOKEN_PATTERN, "$1[TOKEN]", lambda t: t.contains("=")),
    ):
        out = bind(out, _step(pattern, mark, needed))
    return out


def _step(pattern: str, mark: str, needed):
    quick = _STARTS.get(pattern, "") + pattern
    return lambda t: F.when(needed(t), F.regexp_replace(t, quick, mark)).otherwise(t)


def redact_phones(text: Column) -> Column:
    """Digit groups become ``[PHONE]`` only when they hold 7 to 15 digits."""

    def marked(hit: Column) -> Column:
        digits = F.length(F.regexp_replace(hit, r"(?U)\D", ""))
        return F.when(
            digits.between(fv.PHONE_MIN_DIGITS, fv.PHONE_MAX_DIGITS), F.lit("[PHONE]")
        ).otherwise(hit)

    def replaced(t: Column) -> Column:
        between = F.split(t, _PHONE, -1)
        found = F.regexp_extract_all(t, F.lit(_PHONE), F.lit(0))
        pieces = F.zip_with(
            between, found, lambda b, h: F.concat(b, F.coalesce(marked(h), F.lit("")))
        )
        return F.when(t.rlike(_HAS_GROUP), F.array_join(pieces, "")).otherwise(t)

    return bind(text, replaced)


def redact(text: Column) -> Column:
    """Full redaction; null gives the empty string.

    Most texts hold nothing that any pattern needs and are scanned once only.
    """
    return bind(
        text_or_empty(text),
        lambda t: F.when(t.rlike(_MAY_HOLD), redact_phones(redact_structured(t))).otherwise(t),
    )


def redact_local_part(address: Column) -> Column:
    """Keep the domain only; text without ``@`` stays as it is."""
    return F.when(
        F.instr(address, "@") > 0,
        F.concat(F.lit("[REDACTED]@"), F.substring_index(address, "@", -1)),
    ).otherwise(address)


def redact_each(texts: Column) -> Column:
    return F.transform(F.filter(texts, has_text), redact)
