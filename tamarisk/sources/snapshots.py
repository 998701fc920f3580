"""Readers and normalisers of the input tables.

Reputation answers are stored as raw JSON, one row per looked-up target.  The
normalisers turn them into the declared columns with variant functions; a row
whose numbers are no numbers is dropped, it never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk import schemas
from tamarisk.functions.text import has_text

KINDS = ("url", "file", "domain", "ip")


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Read parquet, ORC or JSON lines with the declared schema."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_messages(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Parsed messages with the defaults of the absent lists filled in."""
    return with_absent_lists(read_table(spark, path, schemas.MESSAGE, fmt))


def with_absent_lists(df: DataFrame) -> DataFrame:
    """Messages with empty lists where they have none."""
    lists = {
        "urls": schemas.URL_INFO,
        "attachments": schemas.ATTACHMENT,
        "recent_emails_from_sender": schemas.RECENT_EMAIL,
    }
    return df.withColumns(
        {n: F.coalesce(n, F.array().cast(f"array<{ddl}>")) for n, ddl in lists.items()}
    )


def read_raw_messages(spark, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.RAW_MESSAGE, fmt)


def read_mailbox(spark, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.MAILBOX_MESSAGE, fmt)


def read_redirects(spark, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.REDIRECT, fmt)


def read_answers(spark, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.RAW_ANSWER, fmt)


def read_reputation_bodies(spark, path: str, fmt: str = "json") -> DataFrame:
    """Stored reputation answers, one per looked-up target: ``kind, target, body``."""
    return read_table(spark, path, schemas.REPUTATION_BODY, fmt)


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Public suffix rules from text files in the list's own format: one rule a line, up to the
    first blank; blank lines and lines that begin with ``//`` are none."""
    rule = F.regexp_extract("value", r"^\s*(\S+)", 1)
    rules = spark.read.text(path).select(F.lower(rule).alias("suffix"))
    return rules.filter((F.col("suffix") != "") & ~F.col("suffix").startswith("//")).distinct()


def read_attachment_files(spark: SparkSession, path: str) -> DataFrame:
    """Attachment bytes from files: ``path, size, content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), "content")


# --- engine reputation -----------------------------------------------------


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _texts(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<string>"), F.array().cast("array<string>"))


def total_engines(stats: Column) -> Column:
    """Sum over every entry of the statistics map, known to us or not."""
    return F.coalesce(
        F.aggregate(F.map_values(stats), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))),
        F.lit(0),
    )


def normalise_engines(raw: DataFrame) -> DataFrame:
    """``kind, target, body`` -> the columns of ``schemas.VT_RESULT``.

    ``body`` is the stored answer, ``{"data": {"attributes": {...}}}``.
    """
    a = "$.data.attributes."
    v = F.col("v")
    stats = _get(v, a + "last_analysis_stats", "map<string,int>")
    parsed = raw.select(
        F.coalesce("kind", F.lit("url")).alias("kind"),
        "target",
        F.try_parse_json("body").alias("v"),
    ).withColumn("stats", stats)
    count = lambda name: F.coalesce(F.try_element_at(F.col("stats"), F.lit(name)), F.lit(0))
    own_hash = _get(v, a + "sha256", "string")
    rows = parsed.select(
        "kind",
        F.coalesce(
            F.when(F.col("kind") == "file", F.when(has_text(own_hash), own_hash)),
            F.when(F.col("kind") != "file", F.col("target")),
            F.lit(""),
        ).alias("target"),
        count("malicious").alias("malicious_count"),
        count("suspicious").alias("suspicious_count"),
        count("harmless").alias("harmless_count"),
        count("undetected").alias("undetected_count"),
        count("timeout").alias("timeout_count"),
        total_engines(F.col("stats")).alias("total_engines"),
        *[
            _get(v, a + n, t).alias(alias)
            for n, t, alias in (
                ("reputation", "int", "reputation"),
                ("first_submission_date", "bigint", "first_submission_date"),
                ("last_analysis_date", "bigint", "last_analysis_date"),
                ("total_votes.harmless", "int", "total_votes_harmless"),
                ("total_votes.malicious", "int", "total_votes_malicious"),
                ("title", "string", "title"),
                ("last_final_url", "string", "last_final_url"),
            )
        ],
        _texts(v, a + "threat_names").alias("threat_names"),
        F.coalesce(
            _get(v, a + "categories", "map<string,string>"), F.create_map().cast("map<string,string>")
        ).alias("categories"),
        _texts(v, a + "tags").alias("tags"),
        *[_get(v, a + n, "string").alias(n) for n in ("meaningful_name", "type_description", "type_tag")],
        _get(v, a + "size", "bigint").alias("size"),
        *[_get(v, a + n, "string").alias(n) for n in ("sha256", "md5", "sha1")],
        _texts(v, a + "names").alias("names"),
        _get(v, a + "popular_threat_classification.suggested_threat_label", "string").alias("threat_label"),
        # free-form parts stay variants
        F.try_variant_get(v, a + "popular_threat_classification", "variant").alias("popular_threat_classification"),
        F.try_variant_get(v, a + "sandbox_verdicts", "variant").alias("sandbox_verdicts"),
        F.try_variant_get(v, a + "last_dns_records", "variant").alias("last_dns_records"),
        _get(v, a + "creation_date", "bigint").alias("creation_date"),
        *[_get(v, a + n, "string").alias(n) for n in ("registrar", "country")],
        _get(v, a + "asn", "bigint").alias("asn"),
        *[_get(v, a + n, "string").alias(n) for n in ("as_owner", "network")],
        (count("malicious") > 0).alias("is_malicious"),
        # an answer that is no JSON, or whose statistics are not all whole
        # numbers, does not fit the record
        (
            v.isNotNull()
            & (
                F.coalesce(F.forall(F.map_values("stats"), lambda n: n.isNotNull()), F.lit(False))
                | F.try_variant_get(v, a + "last_analysis_stats", "variant").isNull()
            )
        ).alias("_fits"),
    )
    return rows.filter(F.col("_fits") & F.col("kind").isin(*KINDS)).drop("_fits")


# --- the other sources -----------------------------------------------------


def normalise_abuse(raw: DataFrame) -> DataFrame:
    """``ip, body`` -> the columns of ``schemas.ABUSE_RESULT``.

    The first five reports are taken and those without categories dropped then.
    """
    parsed = raw.select("ip", F.try_parse_json("body").alias("v")).filter(F.col("v").isNotNull())
    v = F.col("v")
    zero = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    reports = F.slice(
        F.coalesce(
            _get(v, "$.data.reports", "array<struct<categories:array<int>>>"),
            F.array().cast("array<struct<categories:array<int>>>"),
        ),
        1, 5,
    )
    own = _get(v, "$.data.ipAddress", "string")
    return parsed.select(
        F.when(has_text(own), own).otherwise(F.col("ip")).alias("ip"),
        zero(_get(v, "$.data.abuseConfidenceScore", "int")).alias("abuse_confidence"),
        *[
            _get(v, "$.data." + n, "string").alias(alias)
            for n, alias in (
                ("countryCode", "country_code"), ("countryName", "country_name"),
                ("usageType", "usage_type"), ("isp", "isp"), ("domain", "domain"),
            )
        ],
        _texts(v, "$.data.hostnames").alias("hostnames"),
        zero(_get(v, "$.data.totalReports", "int")).alias("total_reports"),
        zero(_get(v, "$.data.numDistinctUsers", "int")).alias("distinct_reporters"),
        _get(v, "$.data.lastReportedAt", "string").alias("last_reported_at"),
        no(_get(v, "$.data.isWhitelisted", "boolean")).alias("is_whitelisted"),
        no(_get(v, "$.data.isTor", "boolean")).alias("is_tor"),
        F.filter(
            F.transform(reports, lambda r: r["categories"]), lambda c: F.size(c) > 0
        ).alias("recent_report_categories"),
    )


def normalise_safe_browsing(matches: DataFrame) -> DataFrame:
    """Match rows ``url, threat_type, platform_type`` -> one record per URL.

    The sets are small (the service knows a handful of types), and they are
    combined before the shuffle.
    """
    types = lambda c: F.sort_array(F.collect_set(F.when(has_text(F.col(c)), F.col(c))))
    return matches.groupBy("url").agg(
        F.lit(True).alias("is_threat"),
        types("threat_type").alias("threat_types"),
        types("platform_type").alias("platform_types"),
    )


def safe_browsing_matches(raw: DataFrame) -> DataFrame:
    """Stored answers ``url, body`` -> match rows."""
    body = F.try_parse_json("body")
    found = _get(body, "$.matches", "array<struct<threatType:string,platformType:string>>")
    return raw.select("url", F.explode(found).alias("m")).select(
        "url", F.col("m.threatType").alias("threat_type"), F.col("m.platformType").alias("platform_type")
    )


def normalise_malware_feed(raw: DataFrame) -> DataFrame:
    """Stored answers ``url, body`` -> the columns of ``schemas.MALWARE_FEED``."""
    parsed = raw.select("url", F.try_parse_json("body").alias("v")).filter(F.col("v").isNotNull())
    v = F.col("v")
    listed = F.coalesce(_get(v, "$.query_status", "string"), F.lit("")) == "ok"
    only = lambda c: F.when(listed, c)
    return parsed.select(
        "url",
        listed.alias("in_database"),
        only(_get(v, "$.threat", "string")).alias("threat"),
        F.when(listed, _texts(v, "$.tags")).otherwise(F.array().cast("array<string>")).alias("tags"),
        *[only(_get(v, "$." + n, "string")).alias(n) for n in ("url_status", "date_added", "reporter")],
    )
