"""Whitening of embeddings by a covariance from polarisation.

Entries are integers ``floor(scale * c) + offset``.  All statistics are exact: sums per
dimension first; then, centred at the integer nearest to each mean, the squares of every
dimension and of the sum of every pair of dimensions are added up.  By polarisation
``2 cov(d, e) = var(d + e) - var(d) - var(e)``, taken in whole numbers (what the integer
centre lacks is made up for exactly) and divided once.  The matrix goes to ``eigh``.

A task sends one row of limbs per statistic, never a vector; the driver gets
``d * (d + 1) / 2`` numbers, whatever the number of rows.

Defined results:

* Rows whose vector is null or holds null or non-finite entries are dropped, and so are
  vectors of another length than the most common one (of equally common ones the longest).
* Each remaining row gives its own result rows, also where ids are null or repeated.
* Components without variance (up to rounding) are returned with a null ``whitened`` and left
  out of ``identity_error``; vectors with fewer dimensions than components give fewer rows.
* ``deviation`` is null where 38 digits do not hold it.
* Empty tables, and vectors without entries, give an empty result.
* Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIMB = 32
#: rows whose squares are added at once; so many squares of numbers below _SMALL fit into 64 bits
_ROWS = 4096
_SMALL = 1 << 24
_DIGITS = 38


@dataclass(frozen=True)
class WhitenParams:
    scale: int = 1024
    offset: int = 100_000
    components: int = 8


@dataclass
class Whitening:
    """What the fit list says; ``centre + rest / n`` is the mean."""

    n: int
    centre: list[int]
    rest: list[int]
    components: np.ndarray  # (dimensions, k), unit columns
    eigenvalues: np.ndarray  # (k,), falling
    trace: float

    @property
    def usable(self) -> np.ndarray:
        return self.eigenvalues > self.trace * len(self.centre) * np.finfo(float).eps


def integer_rows(rows: DataFrame, params: WhitenParams, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the vectors without null or non-finite entries."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * params.scale) + F.lit(params.offset).cast("long"))
    return (
        rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
        .where(F.col("v").isNotNull() & finite).select("id", whole.alias("x"))
    )


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _limbs(values: list[int]) -> pa.RecordBatch:
    """Integers of any size as rows (stat, limb, value); limbs of all but the sign are not negative."""
    stat, limb, part = [], [], []
    for i, v in enumerate(values):
        at = 0
        while v not in (0, -1):
            stat.append(i), limb.append(at), part.append(v & ((1 << _LIMB) - 1))
            v, at = v >> _LIMB, at + 1
        if v:
            stat.append(i), limb.append(at), part.append(-1)
    return pa.RecordBatch.from_arrays(
        [pa.array(stat, pa.int32()), pa.array(limb, pa.int32()), pa.array(part, pa.int64())], names=["stat", "limb", "value"]
    )


def exact_sums(rows: DataFrame, width: int, statistics) -> list[int]:
    """Sums over all rows of the integer statistics (object array) that a matrix of rows gives."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                total = total + statistics(_matrix(batch.slice(first, _ROWS).column("x"), width))
        if not isinstance(total, int):
            yield _limbs([int(v) for v in total])

    limbs = rows.mapInArrow(partial, "stat int, limb int, value long").groupBy("stat", "limb").agg(F.sum("value").alias("value"))
    out: dict[int, int] = {}
    for stat, limb, value in limbs.collect():
        out[stat] = out.get(stat, 0) + (value << (_LIMB * limb))
    return [out.get(i, 0) for i in range(len(statistics(np.zeros((0, width), dtype=np.int64))))]


def column_sums(x: np.ndarray) -> np.ndarray:
    if len(x) and max(-int(x.min()), int(x.max())) >= 1 << 50:
        x = x.astype(object)
    return x.sum(axis=0).astype(object) if len(x) else np.zeros(x.shape[1], dtype=object)


def squares(y: np.ndarray) -> np.ndarray:
    """Sums of squares of each column, then of the sum of each pair of columns (first the pairs of column 0)."""
    d = y.shape[1]
    if not len(y):
        return np.zeros(d * (d + 1) // 2, dtype=object)
    if y.dtype != object and np.abs(y).max() >= _SMALL:
        y = y.astype(object)
    out = [(y * y).sum(axis=0)]
    for i in range(d - 1):
        both = y[:, i + 1 :] + y[:, i : i + 1]
        out.append((both * both).sum(axis=0))
    return np.concatenate(out).astype(object)


def polarised(n: int, rest: list[int], sums: list[int]) -> np.ndarray:
    """The covariance matrix from exact sums of squares about the integer centre."""
    d = len(rest)
    # n * n times the variance of each dimension, a whole number
    var = [n * sums[i] - rest[i] ** 2 for i in range(d)]
    out = np.empty((d, d))
    at = d
    for i in range(d):
        out[i, i] = var[i] / n**2
        for j in range(i + 1, d):
            both = n * sums[at] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - var[i] - var[j]) / (2 * n**2)
            at += 1
    return out


def fit_whitening(rows: DataFrame, params: WhitenParams = WhitenParams()) -> Whitening | None:
    """The model of integer rows (``integer_rows``); None where there are none."""
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head()
    if common is None or not common["width"]:
        return None
    width, n = common["width"], common["count"]
    rows = rows.where(F.size("x") == width)
    sums = exact_sums(rows, width, column_sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    shift = _shift(centre)
    covariance = polarised(n, rest, exact_sums(rows, width, lambda x: squares(x - shift if len(x) else x)))
    values, vectors = np.linalg.eigh(covariance)
    k = min(params.components, width)
    return Whitening(n, centre, rest, vectors[:, ::-1][:, :k], values[::-1][:k], float(np.trace(covariance)))


def _shift(centre: list[int]) -> np.ndarray:
    return np.array(centre, dtype=np.int64)


def _deviations(y: np.ndarray, model: Whitening) -> pa.Array:
    """Sums over the dimensions of (n * x - S) ** 2."""
    n, rest = model.n, model.rest
    if np.abs(y).max(initial=0) >= _SMALL or n >= 1 << 31:
        y = y.astype(object)
    own, cross, square = (y * y).sum(axis=1), (y * np.array(rest, dtype=y.dtype)).sum(axis=1), sum(r * r for r in rest)
    values = [n * n * int(a) - 2 * n * int(b) + square for a, b in zip(own, cross, strict=True)]
    return pa.array([Decimal(v) if v < 10**_DIGITS else None for v in values], pa.decimal128(_DIGITS, 0))


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(rows, k) whitened entries; NaN in components without variance."""
    y = (x - _shift(model.centre)).astype(float) - np.array([r / model.n for r in model.rest])
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (y @ model.components) / np.sqrt(model.eigenvalues)
    out[:, ~model.usable] = np.nan
    return out


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, added up over all rows."""
    width, used = len(model.centre), np.flatnonzero(model.usable)
    k = len(used)
    if not k:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = projected(_matrix(batch.column("x"), width), model)[:, used]
            sums += w.sum(axis=0)
            products += w.T @ w
        values = np.concatenate([sums, products.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["stat", "value"])

    total = np.zeros(k + k * k)
    for stat, value in rows.mapInArrow(partial, "stat int, value double").groupBy("stat").agg(F.sum("value")).collect():
        total[stat] = value
    mean = total[:k] / model.n
    return float(np.abs(total[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    vectors: DataFrame, params: WhitenParams = WhitenParams(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row per vector and component."""
    kind = vectors.schema[id_col].dataType
    out = T.StructType([
        T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(_DIGITS, 0)), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    rows = integer_rows(vectors, params, id_col, vector_col)
    model = fit_whitening(rows, params)
    if model is None:
        return vectors.sparkSession.createDataFrame([], out)
    width, k = len(model.centre), model.components.shape[1]
    rows = rows.where(F.size("x") == width)
    error = identity_error(rows, model)
    explained = [float(e) / model.trace if model.trace else None for e in model.eigenvalues]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                x = _matrix(batch.column("x"), width)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, model.n)), _deviations(x - _shift(model.centre), model).take(each),
                     pa.array(projected(x, model).reshape(-1), from_pandas=True), pa.array(explained * m, pa.float64()),
                     pa.array([error] * (m * k), pa.float64())],
                    names=out.names,
                )

    return rows.mapInArrow(score, out)
