"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Defined results: null texts are empty ones; rows of one id with different texts are documents
of their own, and rows without an id are never dropped as copies; equal rows share every
verdict, and near-duplicate removal leaves one of them; an empty table gives an empty
result; further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm.decontaminate import judge_leaks
from tamarisk.llm.minmax_dedup import near_duplicates
from tamarisk.llm.piece_sampling import encode, load_pieces
from tamarisk.llm.quality import fit_quality, judge
from tamarisk.llm.registry import table
from tamarisk.llm.secret_scan import corpus_samples, fit_secrets, scan_secrets
from tamarisk.operators.lineage import written

#: what stands in a text where a secret was
SECRET_MARK = "[secret]"
#: two models and sampled pieces: not expressible in SQL
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not use."""
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Rows with a key by which verdicts that follow from id and text find their row; key and text alone; the key's name."""
    key = _free(docs, "_row")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return rows, rows.select(F.col(key).alias("_row"), "text"), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules and the classifier keep."""
    rows, narrow, key = _keyed(docs)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    good = judge(narrow, model, id_col="_row").where("kept").select(F.col("doc_id").alias(key))
    return rows.join(good, key, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest by id, then text; rows without an id stay.

    Rows of one id are documents of their own where their texts differ.
    """
    rows, narrow, key = _keyed(docs.where("doc_id is not null"))
    group = near_duplicates(narrow, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    named = rows.select("doc_id", F.col(key).alias("_row"))
    ids = written(named.distinct().join(group.distinct(), "_row"), "near-ids")
    # texts are compared only where the smallest id of a group stands on several
    per_id = ids.groupBy("_group", "doc_id").agg(F.min("_row").alias("_row"), F.count("*").alias("n"))
    best = per_id.groupBy("_group").agg(F.min(F.struct("doc_id", "_row", "n")).alias("x")).select("_group", "x.*")
    tied = (
        best.where("n > 1").select("_group", "doc_id").join(ids, ["_group", "doc_id"]).select("_group", "_row")
        .join(narrow, "_row").groupBy("_group").agg(F.min(F.struct("text", "_row")).alias("x"))
    )
    kept = best.where("n = 1").select("_row").unionByName(tied.select("x._row"))
    one = rows.join(kept.withColumnRenamed("_row", key), key, "left_semi").dropDuplicates([key])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item; rows of one id, or without one, are judged by their own texts."""
    rows, narrow, key = _keyed(docs)
    bad = judge_leaks(narrow, table(spark, sf_dir, "benchmark"), id_col="_row").where("not kept")
    return rows.join(bad.select(F.col("doc_id").alias(key)), key, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text."""
    rows, narrow, key = _keyed(docs)
    model = fit_secrets(corpus_samples(docs))
    found = scan_secrets(narrow, model, id_col="_row", mark=SECRET_MARK).where("spans <> ''")
    new = _free(rows, "clean_text")
    clean = found.select(F.col("doc_id").alias(key), F.col("clean_text").alias(new)).dropDuplicates([key])
    out = rows.join(clean, key, "left")
    changed = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        length = F.char_length(new).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.coalesce(length, F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document."""
    return encode(docs, load_pieces())


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("sentencepiece", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
