"""Whitened embeddings against exact rational arithmetic and numpy."""

import random
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq

from tamarisk.llm.queries import QUERIES
from tamarisk.llm.whitening import WhitenParams, fit_whitening, integer_rows, polarised, squares, whiten

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("x", T.StringType()), T.StructField("id", T.StringType()),
])


def exact(vectors):
    """(integer rows, sums, covariance by fractions)"""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in centred), n**3) for j in range(d)] for i in range(d)]
    return x, centred, np.array([[float(c) for c in line] for line in cov])


def check(got, ids, vectors, k=8):
    x, centred, cov = exact(vectors)
    n = len(x)
    k = min(k, len(x[0]))
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    want = (np.array(centred, dtype=float) / n) @ basis[:, :k] / np.sqrt(values[:k])
    assert len(got) == n * k and {r.n for r in got} == {n}
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i in ids for c in range(1, k + 1))
    at = {i: j for j, i in enumerate(ids)}
    mine = np.empty((n, k))
    for r in got:
        mine[at[r.vec_id], r.component - 1] = r.whitened
        assert int(r.deviation) == sum(v * v for v in centred[at[r.vec_id]])
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-12
    signs = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine - want * signs).max() < 1e-8
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-9


def test_query(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    df = QUERIES["op13_embedding_whitening"](spark, SF)
    assert dict(df.dtypes)["deviation"] == "bigint"
    check(df.collect(), t.column("vec_id").to_pylist(), t.column("embedding").to_pylist())


def test_dropped_rows_and_lengths(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(5)]) for i in range(400)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("-inf")] * 5),
           (904, []), (905, [1.0]), (906, [1.0] * 9)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows + bad], SCHEMA).repartition(6)
    check(whiten(df).collect(), [i for i, _ in rows], [v for _, v in rows])


def test_repeated_and_null_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2]), [rng.gauss(0, 1), rng.gauss(0, 2)], "", "") for _ in range(50)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 100
    assert sorted(str(r.vec_id) for r in got) == sorted(2 * [str(r[0]) for r in rows])


def test_no_variance_and_empty(spark):
    def of(vectors):
        return whiten(spark.createDataFrame([(i, v, "", "") for i, v in enumerate(vectors)], SCHEMA)).collect()

    assert of([]) == [] and of([None, []]) == []
    one = of([[1.0, 2.0]])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # the second dimension follows the first
    flat = of([[float(i), 2.0 * i, 7.0] for i in range(30)])
    assert all((r.whitened is None) == (r.component > 1) for r in flat)
    assert {r.identity_error < 1e-9 for r in flat} == {True}


def test_large_entries_stay_exact(spark):
    rng = random.Random(4)
    vectors = [[rng.uniform(-1, 1) * 1e9, rng.uniform(-1, 1) * 1e5, rng.gauss(0, 1)] for _ in range(60)]
    rows = spark.createDataFrame([(i, v, "", "") for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    model = fit_whitening(integer_rows(rows, WhitenParams(), "vec_id", "embedding"))
    x, centred, cov = exact(vectors)
    assert [c * 60 + r for c, r in zip(model.centre, model.rest, strict=True)] == [sum(r[j] for r in x) for j in range(3)]
    assert model.trace == np.trace(cov)
    for r in whiten(rows).collect():
        assert int(r.deviation) == sum(v * v for v in centred[r.vec_id])


def test_polarisation():
    y = np.random.default_rng(5).integers(-900, 900, (500, 7))
    n, rest = len(y), [int(v) for v in y.sum(axis=0)]
    got = polarised(n, rest, [int(v) for v in squares(y)])
    assert np.abs(got - np.cov(y.T, bias=True)).max() < 1e-6
