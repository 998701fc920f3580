"""Stages of the corpus pipeline where ids are null or repeat."""

import random

import pyarrow.parquet as pq

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def words(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def left(stage, spark, docs):
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=repr)


def test_decontaminate_null_and_repeated_ids(spark, make):
    items = [t for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist() if t and len(t.split()) >= 20]
    item = items[0].split()
    half = len(item) // 2 + 2
    clean = [(None, words(1)), (7, words(2)), (None, None), (8, " ".join(item[:half])), (8, " ".join(item[half - 4 :]))]
    got = left(cp.decontaminate, spark, make([*clean, (None, items[0]), (7, items[0])]))
    assert got == sorted(clean, key=repr)


def test_near_dedup_repeated_ids(spark, make):
    a, b, c = words(1), words(2), words(3)
    docs = [(1, a), (1, b), (1, b), (2, a + " more"), (3, b), (5, c + " x"), (5, c + " a"), (6, c), (None, a), (None, a)]
    got = left(cp.near_dedup, spark, make(docs))
    assert got == sorted([(1, a), (1, b), (5, c + " a"), (None, a), (None, a)], key=repr)
