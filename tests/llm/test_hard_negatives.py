"""Hard negatives against a brute-force search in plain Python."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tamarisk.llm import hard_negatives as hn
from tamarisk.llm.hard_negatives import MiningParams, mine_hard_negatives, packed_scores
from tamarisk.llm.queries import QUERIES

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("row", T.StringType()), T.StructField("score", T.StringType()),
])


def brute(rows, step=100):
    """Sorted result rows; rows are (id, vector, label) and told apart by their place."""
    used = []
    for at, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            used.append((math.inf if i is None else i, at, label, [math.floor(256 * float(np.float32(c))) for c in v]))
    out = []
    for i, at, label, x in used:
        if i == math.inf or i % step:
            continue
        near = sorted((-sum(a * b for a, b in zip(x, y)), j, k, other) for j, k, other, y in used if k != at)
        for s, j, _, _ in [p for p in near if p[3] == label][:5]:
            low, high = -30 * s, -90 * s
            fits = [p for p in near if p[3] != label and low <= -100 * p[0] <= high][:10]
            out += [(i, None if j == math.inf else j, rank, None if p[1] == math.inf else p[1], -s, -p[0])
                    for rank, p in enumerate(fits, start=1)]
    return sorted(out, key=repr)


def got(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    rows = [(i, v, (lab + 1) % 10 if i % 7 == 0 else lab)
            for i, v, lab in zip(*(t.column(c).to_pylist() for c in ("vec_id", "embedding", "label")), strict=True)]
    assert got(QUERIES["op11_hard_negatives"](spark, SF)) == brute(rows)


@pytest.fixture(scope="module")
def odd_rows():
    """Ties, copies, repeated and null ids, nulls, short and empty vectors."""
    rng = random.Random(3)
    base = [[rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)] for _ in range(12)]
    rows = [(i, rng.choice(base), rng.randint(0, 2)) for i in range(1, 160)]
    rows += [(i, base[0], 0) for i in range(200, 290)]  # one vector holds a third of the rows
    rows += [(100, base[1], 1), (100, base[1], 1), (200, base[1], None), (200, None, 1), (200, [float("nan")] * 6, 1),
             (100, [1.0, None, 0.0], 2), (100, [float("inf")] * 6, 2), (None, base[2], 0), (None, base[2], 1),
             (0, [1.0, 0.5], 0), (-100, [], 0), (-100, base[3], 1)]
    return rows


@pytest.mark.parametrize("params", [MiningParams(), MiningParams(block_bytes=600, block_rows=7, floor_share=2)])
def test_odd_rows(spark, odd_rows, params):
    df = spark.createDataFrame([(*r, "a", "b") for r in odd_rows], SCHEMA).repartition(5)
    assert got(mine_hard_negatives(df, params)) == brute(odd_rows)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(mine_hard_negatives(empty)) == []
    assert got(mine_hard_negatives(spark.createDataFrame([(100, None, 1, "", "")], SCHEMA))) == []
    assert got(mine_hard_negatives(spark.createDataFrame([(100, [1.0], 1, "", "")], SCHEMA))) == []


def test_wide_components(spark):
    """Scores too wide for two fields of a double, and components beyond 32 bits."""
    rng = random.Random(8)
    for top in (3e4, 2e6):
        rows = [(i, [rng.uniform(-top, top) for _ in range(5)], i % 3) for i in range(95, 205)]
        assert got(mine_hard_negatives(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))) == brute(rows)


def test_packed_scores():
    rng = np.random.default_rng(1)
    for top in (1, 9, 200, 1 << 16, 1 << 29):
        a, r = rng.integers(-top, top, (7, 24)), rng.integers(-top, top // 2 + 1, (31, 24))
        assert (packed_scores(a, r) == a.astype(object) @ r.T.astype(object)).all()
    assert packed_scores(np.zeros((3, 4), np.int64), np.full((2, 4), 7)).tolist() == [[0, 0]] * 3
    with pytest.raises(OverflowError):
        packed_scores(np.full((1, 2), 1 << 40), np.full((1, 2), 1 << 40))


def test_multiplications_are_shared(monkeypatch):
    """Small components go several candidates to an integer."""
    seen = []
    real = np.zeros
    monkeypatch.setattr(hn.np, "zeros", lambda shape, dtype=float: seen.append(shape) or real(shape, dtype=dtype))
    packed_scores(np.arange(4 * 64).reshape(4, 64) % 100, np.arange(64 * 100).reshape(100, 64) % 200)
    assert (50, 64) in seen
