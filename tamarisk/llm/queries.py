"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk.llm.decontaminate import judge_leaks
from tamarisk.llm.hard_negatives import mine_hard_negatives
from tamarisk.llm.line_dedup import drop_shared_lines
from tamarisk.llm.lm_scoring import fit_lm, score_lm
from tamarisk.llm.minmax_dedup import NearDupParams, near_duplicates
from tamarisk.llm.piece_sampling import encode, load_pieces
from tamarisk.llm.quality import fit_quality, judge
from tamarisk.llm.registry import QUERIES, query, table  # noqa: F401
from tamarisk.llm.sharding import shard_rows
from tamarisk.llm.secret_scan import corpus_samples, fit_secrets, scan_secrets
from tamarisk.llm.suffix_dedup import remove_repeats
from tamarisk.llm.url_filter import Rule, filter_urls, fit_urls, host_path, rule_of
from tamarisk.llm.warc import read_archives, with_roles, write_archives
from tamarisk.llm.whitening import whiten
from tamarisk.operators.lineage import new_folder


@query("op8_minmax_near_dedup")
def op8(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), params=NearDupParams(percent=85))


@query("op6_quality_rules")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op1_lm_scoring")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = fit_lm(docs.where(~F.coalesce(held, F.lit(False))), seed_col=F.xxhash64("doc_id"))
    scored = score_lm(docs, model)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), *scored.columns[1:])


@query("op3_secret_scan")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, fit_secrets(corpus_samples(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


@query("op9_piece_sampling")
def op9(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), load_pieces())


@query("op7_ring_sharding")
def op7(spark, sf_dir):
    placed = shard_rows(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: fixed values: the rules of the URL query
URL_RULES = [
    Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"), Rule("block", "net/fr/"),
]


@query("op2_url_filter")
def op2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # what the rules decide labels the URLs that the trees learn from
    host, path = host_path(F.col("url"))
    labelled = pages.select("url", rule_of(host, path, URL_RULES)[1].alias("verdict"))
    return filter_urls(pages, URL_RULES, fit_urls(labelled))


@query("op4_warc_salvage")
def op4(spark, sf_dir):
    folder = new_folder(spark, "warc")
    write_archives(with_roles(table(spark, sf_dir, "pages")), folder)
    found = read_archives(spark, folder).where("gap_reason is null")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_template_decontamination")
def op5(spark, sf_dir):
    return judge_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_suffix_array_dedup")
def op10(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


@query(
    "op11_hard_negatives",
    """
    WITH entries AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), scores AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               list_dot_product(a.x, b.x)::BIGINT AS score
        FROM entries a JOIN entries b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
           other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved))


@query(
    "op12_line_dedup",
    """
    WITH lines AS (
        SELECT doc_id, pos, line,
               translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
    ), shared AS (
        SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
    FROM lines LEFT JOIN shared USING (key) GROUP BY doc_id
    """,
)
def op12(spark, sf_dir):
    kept = drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    # the exact deviation stays a decimal in the operator; beyond a long the query has null
    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))
