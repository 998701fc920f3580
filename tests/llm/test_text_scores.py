"""Model scoring, secrets and quality against plain Python."""

import brute
import pytest

from pyspark.sql import functions as F

import tamarisk.llm.queries  # noqa: F401  registers the queries
from tamarisk.llm.lm_scoring import fit_lm, score_lm
from tamarisk.llm.quality import fit_quality, judge
from tamarisk.llm.registry import QUERIES
from tamarisk.llm.secret_scan import corpus_samples, fit_secrets, random_strings, scan_secrets

SF = "/root/testdata/sf0.001"


def test_lm_query(spark, sf_docs):
    want = brute.lm_base(sf_docs)
    got = QUERIES["op1_lm_scoring"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    # held-out texts: the model beats the counts
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_odd(make, odd_docs):
    want = brute.lm_base(odd_docs)
    docs = make(odd_docs)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = score_lm(docs, fit_lm(docs.where(~held), seed_col=F.xxhash64("doc_id"))).collect()
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][1:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
        assert r.score < 0
    again = {r.doc_id: r.score for r in got}
    assert again[8] == pytest.approx(again[9]) == pytest.approx(again[10])


def test_lm_empty(make):
    assert score_lm(make([]), fit_lm(make([]))).collect() == []
    got = score_lm(make([(1, "a b"), (None, None)]), fit_lm(make([]))).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 0, 0), (3, 0, 0)]


def assert_secrets(got, docs):
    texts = dict(docs)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        *want, named = brute.secrets(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == want
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random")] == named
        places = [(int(s.split(":")[1]), int(s.split(":")[2])) for s in spans]
        assert places == sorted(places) and all(a < b <= len(texts[r.doc_id]) for a, b in places)
        assert r.n_random == sum(s.startswith("random") for s in spans)


def test_secret_query(spark, sf_docs):
    assert_secrets(QUERIES["op3_secret_scan"](spark, SF).collect(), sf_docs)


def test_secrets_odd(make, odd_docs):
    docs = make(odd_docs)
    assert_secrets(scan_secrets(docs, fit_secrets(corpus_samples(docs))).collect(), odd_docs)
    assert_secrets(scan_secrets(docs, None).collect(), odd_docs)


def test_secret_model(spark, make, sf_docs):
    model = fit_secrets(corpus_samples(make(sf_docs)))
    fresh = random_strings(400, seed=99)
    assert sum(model.score(s) >= 12 for s in fresh) >= 0.9 * len(fresh)
    plain = {w for _, t in sf_docs for w in brute.word_list(t) if len(w) >= 16 and w.isalpha() and w.isascii()}
    plain |= {"internationalization", "get_user_by_identifier", "responsibilities", "miscommunication"}
    assert sum(model.score(s) < 12 for s in plain) >= 0.9 * len(plain)
    assert fit_secrets(spark.createDataFrame([], "value string, secret boolean")) is None


def test_redaction(make):
    docs = make([(1, "\u00e9 password: hunter22 ok"), (2, None), (3, "plain")])
    got = {r.doc_id: r.clean_text for r in scan_secrets(docs, None, mark="[secret]").collect()}
    assert got == {1: "\u00e9 [secret] ok", 2: "", 3: "plain"}


def test_secret_inside_a_run(make, sf_docs):
    model = fit_secrets(corpus_samples(make(sf_docs)))
    drawn = [s for s in random_strings(200, seed=41)[2::4] if len(s) >= 20][:30]
    ways = ["/services/account/verification/{}", "customer_information_service_{}_and_responsibilities",
            "/management/{}/administration/information/{}/international", "password=hunter22.{}"]
    docs = [(100 * w + i, way.format(s, s)) for w, way in enumerate(ways) for i, s in enumerate(drawn)]
    got = {r.doc_id: r.clean_text for r in scan_secrets(make(docs), model, mark="[secret]").collect()}
    gone = sum(drawn[i % 100] not in t for i, t in got.items())
    assert gone >= 0.9 * len(docs)
    # the part of a run beside a fixed span is judged too
    key = "AKIA" + "Q" * 16
    got = scan_secrets(make([(i, f"{key}/{s}") for i, s in enumerate(drawn)]), model, mark="[secret]").collect()
    assert sum(r.n_access == 1 and r.n_random == 1 for r in got) >= 0.9 * len(got)


def test_samples_of_a_small_table(make):
    docs = make([(1, "ordinary words of one document with password=hunter22")])
    assert fit_secrets(corpus_samples(docs)) is not None


def assert_quality(got, docs):
    texts = dict(docs)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_query(spark, sf_docs):
    assert_quality(QUERIES["op6_quality_rules"](spark, SF).collect(), sf_docs)


def test_quality_odd(spark, make, odd_docs):
    assert_quality(judge(make(odd_docs), None).collect(), odd_docs)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_quality(make(odd_docs), labels) is None
    assert judge(make([]), None).collect() == []


def test_quality_held_out(spark):
    """Fitted on half of the labels, most of the other half is judged right."""
    base = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    got = judge(docs, fit_quality(docs, labels.where(half))).join(labels.where(~half), "doc_id").collect()
    right = sum((r.quality_probability >= 0.5) == (r.quality == 1) for r in got)
    assert right >= 0.8 * len(got)
