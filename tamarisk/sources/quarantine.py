"""Input rows that do not parse, kept beside those that do.

A check gives every row a ``reason``: null where the row is usable, else the first rule it
breaks.  ``Checked`` splits on it, so good and bad rows always add up to the input, and counts
both while the job that uses them runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tamarisk import schemas
from tamarisk.functions.text import has_text, text_or_empty
from tamarisk.operators.answers import answer_json, strip_code_fences
from tamarisk.sources.snapshots import KINDS, with_absent_lists

CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Checked:
    """``rows`` with ``raw`` (the row as it came) and ``reason``; ``counts`` is filled by any action on them.

    ``counts.get`` gives ``n_rows`` and ``n_bad`` after the first action on ``good`` or ``bad``.
    """

    rows: DataFrame
    counts: Observation

    @property
    def good(self) -> DataFrame:
        return self.rows.filter("reason IS NULL").drop("raw", "reason")

    @property
    def bad(self) -> DataFrame:
        return self.rows.filter("reason IS NOT NULL").select("raw", "reason")


def _checked(rows: DataFrame, reasons: dict[str, Column], raw: Column) -> Checked:
    broken = F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in reasons.items()])
    judged = rows.withColumns({"raw": raw, "reason": broken})
    counts = Observation()
    watched = judged.observe(counts, F.count(F.lit(1)).alias("n_rows"), F.count("reason").alias("n_bad"))
    return Checked(watched.drop(CORRUPT), counts)


def read_checked(
    spark: SparkSession, path: str, schema: str, fmt: str = "json", required: tuple[str, ...] = ("message_id",)
) -> Checked:
    """Read a table; JSON lines that do not fit the schema are bad, and rows without a required field.

    Every line is parsed whole, whatever columns are used later: a reader that skips unused
    columns would not see what is wrong with them.  Blank lines are no rows.  Formats with a
    schema of their own hold no misfits, there only the required fields are asked for.
    """
    reasons = {f"no {c}": ~has_text(F.col(c)) for c in required}
    if fmt != "json":
        rows = spark.read.schema(schema).format(fmt).load(path)
        return _checked(rows, reasons, F.to_json(F.struct(*rows.columns)))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("p")).select("p.*", "value")
    misfit = F.col(CORRUPT).isNotNull()
    found = _checked(parsed, {"does not fit the schema": misfit} | reasons, F.col("value"))
    return Checked(found.rows.drop("value"), found.counts)


def read_checked_messages(spark: SparkSession, path: str, fmt: str = "json") -> Checked:
    """Parsed messages; absent lists are filled in as ``read_messages`` does."""
    found = read_checked(spark, path, schemas.MESSAGE, fmt)
    return Checked(with_absent_lists(found.rows), found.counts)


def check_answers(raw: DataFrame) -> Checked:
    """Stored model answers (``message_id, raw_text``): those that give no record of their own are bad."""
    text = strip_code_fences(text_or_empty(F.col("raw_text")))
    v = answer_json(text)
    reasons = {
        "no message_id": ~has_text(F.col("message_id")),
        "empty": text == "",
        "not JSON": v.isNull(),
        "not an object": ~F.schema_of_variant(v).startswith("OBJECT"),
    }
    return _checked(raw, reasons, F.col("raw_text"))


def check_engine_bodies(raw: DataFrame) -> Checked:
    """Stored engine answers (``kind, target, body``): what ``normalise_engines`` leaves out is bad."""
    v = F.try_parse_json("body")
    stats = "$.data.attributes.last_analysis_stats"
    counted = F.try_variant_get(v, stats, "map<string,int>")
    reasons = {
        "not JSON": v.isNull(),
        "counts are no whole numbers": F.try_variant_get(v, stats, "variant").isNotNull()
        & ~F.coalesce(F.forall(F.map_values(counted), lambda n: n.isNotNull()), F.lit(False)),
        "unknown kind": ~F.coalesce("kind", F.lit("url")).isin(*KINDS),
    }
    return _checked(raw, reasons, F.col("body"))


def check_bodies(raw: DataFrame) -> Checked:
    """Stored answers of the other sources (``ip`` or ``url``, ``body``): what is no JSON is bad."""
    return _checked(raw, {"not JSON": F.try_parse_json("body").isNull()}, F.col("body"))
