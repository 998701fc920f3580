"""Registered domains by a public-suffix table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.operators.lookup import lookup_join
from tamarisk.params import RiskParams


def registered_domains(
    hosts: DataFrame, rules: DataFrame, params: RiskParams = RiskParams()
) -> DataFrame:
    """``host, registered_domain`` of every distinct ``host``.

    ``rules`` has one column ``suffix`` with plain rules (``co.uk``), wildcards
    (``*.ck``) and exceptions (``!www.ck``).  The longest rule wins, exceptions
    win over all; a host that is itself a suffix, or matches none, gives null.
    """
    distinct = hosts.select(F.lower("host").alias("host")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    tail = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")

    def matches(i: Column) -> Column:
        make = lambda rule, start, exact: F.struct(
            rule.alias("suffix"), start.cast("int").alias("start"), F.lit(exact).alias("exception")
        )
        return F.array(
            make(tail(i), i, False),
            make(F.concat(F.lit("*."), tail(i + 1)), i, False),
            make(F.concat(F.lit("!"), tail(i)), i + 1, True),
        )

    candidates = distinct.select(
        "host", F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), matches)))
    )
    known = rules.select(F.lower("suffix").alias("suffix"), F.lit(True).alias("_known")).distinct()
    hit = lookup_join(candidates, known, ["suffix"], ["host"], params).filter("_known")
    best = hit.groupBy("host").agg(
        F.max_by("start", F.struct(F.col("exception"), -F.col("start"))).alias("start")
    )
    found = F.when(F.col("start") >= 2, tail(F.col("start") - 1))
    return best.select("host", found.alias("registered_domain"))


def with_registered_domains(
    df: DataFrame,
    column: str,
    rules: DataFrame,
    spread_by: list,
    fallback: bool,
    params: RiskParams = RiskParams(),
) -> DataFrame:
    """Replace the host in ``column`` by its registered domain.

    Hosts without one keep their name (``fallback``, for addresses) or become
    null (for URLs).
    """
    named = df.withColumn("host", F.lower(column))
    domains = registered_domains(named.select("host"), rules, params)
    joined = lookup_join(named, domains, ["host"], spread_by, params)
    rest = F.col("host") if fallback else F.lit(None).cast("string")
    return joined.withColumn(column, F.coalesce("registered_domain", rest)).drop(
        "host", "registered_domain"
    )
