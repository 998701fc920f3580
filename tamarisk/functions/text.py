"""Text helpers shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_array(values) -> Column:
    """Literal ``array<string>``; typed also when it is empty."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def any_true(conditions) -> Column:
    """OR of the conditions; codegen stops at the first true one."""
    return reduce(or_, list(conditions), F.lit(False))


def sql_text(value: str) -> str:
    """The string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_any(conditions) -> str:
    """OR of SQL conditions.

    The long dictionary rules are built as SQL text: the same expressions, but
    one call to the JVM instead of one per word.
    """
    return "(" + (" OR ".join(conditions) or "false") + ")"


def contains_any(lowered: str, words) -> Column:
    """True when the lower-cased text (a column name) holds one of the words."""
    return F.expr(sql_any(f"contains({lowered}, {sql_text(w.lower())})" for w in words))


def ends_with_any(lowered: Column, endings) -> Column:
    return any_true(lowered.endswith(e) for e in endings)


def bind(value: Column, use) -> Column:
    """``use(x)`` with ``x`` bound to the value, which is then computed once
    however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def has_text(value: Column) -> Column:
    """True for a string that is neither null nor empty (never null)."""
    return text_or_empty(value) != ""


def text_or(value: Column, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.when(has_text(value), value).otherwise(F.lit(default))


def non_null(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def strip_tags(html: Column) -> Column:
    """Each tag becomes one space; script and style text stays."""
    return F.regexp_replace(html, "<[^>]+>", " ")


def trim_space(value: Column) -> Column:
    """Trim of all Unicode white space, not of blanks only."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def escape_html(value: Column) -> Column:
    text = text_or_empty(value.cast("string"))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def cut(value: Column, limit: int, marker: str) -> Column:
    """First ``limit`` characters plus the marker; shorter text unchanged."""
    return bind(
        text_or_empty(value),
        lambda t: F.when(
            F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(marker))
        ).otherwise(t),
    )


def lines(*parts: Column) -> Column:
    """Join with line feeds; null parts vanish, empty ones give empty lines."""
    return F.concat_ws("\n", *parts)
