"""Stored language-model answers: from raw text to a checked record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk import fixed_values as fv
from tamarisk import schemas
from tamarisk.functions.text import string_array, text_or_empty, trim_space
from tamarisk.operators.asof import one_per_key
from tamarisk.operators.keys import join_on_message, message_key

MAX_FINDINGS, MAX_ADVICE = 5, 3


def strip_code_fences(raw: Column) -> Column:
    return trim_space(F.regexp_replace(trim_space(raw), fv.CODE_FENCE_PATTERN, ""))


def score_of(v: Column) -> Column:
    """Whole number within 0..100, also of numbers beyond int; anything that is none gives 0."""
    number = F.try_variant_get(v, "$.claude_score", "int")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.claude_score", "variant"))
    wide = F.try_variant_get(v, "$.claude_score", "double")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), wide)).cast("int")
    number = F.coalesce(number, F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), clipped))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(number, F.lit(0))))


def texts_of(v: Column, path: str, limit: int) -> Column:
    """List of texts: empty entries go first, the cap applies to the rest.

    Emptiness is judged on the JSON value, before the number 0 or the word
    false turns into text.
    """
    items = F.try_variant_get(v, path, "array<variant>")
    kept = F.filter(items, lambda x: F.coalesce(_filled(x), F.lit(False)))
    return F.coalesce(F.slice(F.transform(kept, _shown), 1, limit), string_array([]))


def _filled(x: Column) -> Column:
    """False for null, "", false, 0, [] and {}; null where there is no value."""
    kind = F.schema_of_variant(x)
    number = F.try_variant_get(x, "$", "double")
    return (
        F.when(kind == "VOID", False)
        .when(kind == "STRING", F.try_variant_get(x, "$", "string") != "")
        .when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        .when(kind.like("ARRAY<%"), F.size(F.try_variant_get(x, "$", "array<variant>")) > 0)
        .when(
            kind.like("OBJECT<%"),
            F.size(F.try_variant_get(x, "$", "map<string,variant>")) > 0,
        )
        .otherwise(number != 0)
    )


def _shown(x: Column) -> Column:
    text = F.try_variant_get(x, "$", "string")
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(text)).otherwise(text)


def unavailable() -> Column:
    """The record of a missing or unusable answer."""
    return F.struct(
        F.lit(0).alias("score"), F.lit("SAFE").alias("threat_category"),
        string_array([]).alias("main_findings"), F.lit("").alias("potential_damage"),
        string_array([]).alias("do"), string_array([]).alias("do_not"),
        F.lit(False).alias("available"),
    ).cast(schemas.ANSWER)


_FIELDS = ("claude_score", "threat_category", "main_findings", "potential_damage", "what_to_do")


def answer_json(text: Column) -> Column:
    """The answer as a variant; null where it is no JSON.

    Of a key that an object repeats the last value counts.  The plain parser refuses such
    texts, so those alone are read again by field.
    """
    fields = ",".join(f"{n}:variant" for n in _FIELDS)
    # as the only element of a list, since the parsers stop at the end of the first value
    alone = F.concat(F.lit("["), text, F.lit("]"))
    again = F.get(F.from_json(alone, f"array<struct<{fields}>>"), F.lit(0))
    by_field = F.to_variant_object(F.struct(*[again[n].alias(n) for n in _FIELDS]))
    refused = F.when(text.startswith("{") & again.isNotNull(), by_field)
    return F.when(F.json_array_length(alone) == 1, F.coalesce(F.try_parse_json(text), refused))


def parse_answers(raw: DataFrame, *kept: str) -> DataFrame:
    """``message_id, raw_text`` -> key of the message, ``analysis`` and the kept columns."""
    key = message_key(raw)
    parsed = raw.select(
        *key, *kept, answer_json(strip_code_fences(text_or_empty(F.col("raw_text")))).alias("v")
    )
    v = F.col("v")
    category = F.try_variant_get(v, "$.threat_category", "string")
    damage = F.try_variant_get(v, "$.potential_damage", "variant")
    record = F.struct(
        score_of(v).alias("score"),
        F.when(category.isin(fv.THREAT_CATEGORIES), category)
        .otherwise("SUSPICIOUS").alias("threat_category"),
        texts_of(v, "$.main_findings", MAX_FINDINGS).alias("main_findings"),
        F.when(_filled(damage), _shown(damage)).otherwise("").alias("potential_damage"),
        texts_of(v, "$.what_to_do.do", MAX_ADVICE).alias("do"),
        texts_of(v, "$.what_to_do.do_not", MAX_ADVICE).alias("do_not"),
        F.lit(True).alias("available"),
    ).cast(schemas.ANSWER)
    usable = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return parsed.select(*key, *kept, F.when(usable, record).otherwise(unavailable()).alias("analysis"))


def with_analysis(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Add ``analysis``; a message without an answer gets the unavailable record.

    Of several answers to a message the latest by ``answered_at`` counts; without that
    column, or between answers of one moment, the greatest by its JSON text.
    """
    at = "answered_at" if "answered_at" in answers.columns else None
    key = message_key(messages, answers)
    kept = answers.select(*key, "analysis", *([at] if at else []))
    joined = join_on_message(messages, one_per_key(kept, key, at).select(*key, "analysis"))
    return joined.withColumn("analysis", F.coalesce("analysis", unavailable()))
