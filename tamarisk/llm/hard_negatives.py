"""Hard negatives by exact integer inner products, several candidates in one wide integer.

Components are integers ``floor(scale * x)``.  Kronecker packing: the components that a few
candidates have in one dimension are biased to be non-negative and laid into separate
fields of one integer, wide enough for a whole inner product.  One multiplication per
anchor component then serves all candidates of the integer; the fields of the sum over the
dimensions are unpacked, the biases taken off again, and the scores are exact.  Integers of
up to 53 bits go through a matrix product of doubles, where they are exact in any order of
summation; wider ones are Python integers.

Anchors are dealt in blocks of bounded size; each block is held against all rows, a block
of rows at a time, once for the positives and once for the negatives.  A task sends on the
best few rows per anchor and window.  What those have to beat is found first on a share of
the rows (``floor_share``, in as small a share of the tasks), so that most tasks send nothing
for most anchors.  No group of one label, id or vector is ever gathered.

Defined results:

* Rows with a null label, a null vector, or any null or non-finite component take no part.
  A vector shorter than others counts as 0 in the places it lacks; an empty one is all 0.
* Rows are told apart as rows: of two rows with one id, each may be the other's positive.
  Equal scores go by the smaller id, rows without an id last; without one, no row is an anchor.
* An anchor without positives, or with none that has a negative in its range, gives no row.
  Empty tables give an empty result.  Scores beyond 61 bits raise OverflowError.
* Columns other than the three named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarisk.operators.lineage import new_folder, written

#: integers of so many bits are exact in a double
WORD = 53
#: fields of an integer wider than that
WIDE_FIELDS = 32
_NONE = -(1 << 62)
_NO_ID = (1 << 63) - 1
_TILE = 512


@dataclass(frozen=True)
class MiningParams:
    anchor_step: int = 100
    positives: int = 5
    negatives: int = 10
    low_percent: int = 30
    high_percent: int = 90
    scale: int = 256
    #: bytes of the anchors that are sent to the tasks at once
    block_bytes: int = 1 << 24
    #: rows that are held against a tile of anchors at once
    block_rows: int = 2048
    #: one row in so many is scored first, to find what the others must beat
    floor_share: int = 16


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors, rows) of two integer matrices of one width."""
    if not len(anchors) or not len(rows) or not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), dtype=np.int64)
    if max(abs(int(m.min())) | abs(int(m.max())) for m in (anchors, rows)) >= 1 << 30:
        anchors, rows = anchors.astype(object), rows.astype(object)
    low_a, low_r = anchors.min(), rows.min()
    a, r = anchors - low_a, rows - low_r
    most = sum(int(x) * int(y) for x, y in zip(a.max(axis=0), r.max(axis=0), strict=True))
    width = max(1, most.bit_length())
    fields, kind = (WORD // width, np.float64) if 2 * width <= WORD else (WIDE_FIELDS, object)
    n = len(rows)
    groups = -(-n // fields)
    laid = np.zeros((groups * fields, r.shape[1]), dtype=r.dtype)
    laid[:n] = r
    wide = np.zeros((groups, r.shape[1]), dtype=kind)
    for j in range(fields):
        wide += laid[j::fields].astype(kind) * (1 << (width * j))
    product = a.astype(kind) @ wide.T
    if kind is np.float64:
        product = product.astype(np.int64)
    sums = np.empty((len(a), groups * fields), dtype=product.dtype)
    for j in range(fields):
        sums[:, j::fields] = (product >> (width * j)) & ((1 << width) - 1)
    bias = a.sum(axis=1)[:, None] * low_r + (r.sum(axis=1) * low_a)[None, :] + a.shape[1] * low_a * low_r
    out = sums[:, :n] + bias
    if out.dtype == object:
        if max(abs(int(out.min())), abs(int(out.max()))) >= -_NONE // 2:
            raise OverflowError("inner products beyond 61 bits")
        out = out.astype(np.int64)
    return out


@dataclass
class Anchors:
    """A block of anchors and, for each, the windows of scores whose best rows are asked for."""

    row: np.ndarray  # (n,)
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray  # (n, dimensions)
    low: np.ndarray  # (n, windows)
    high: np.ndarray


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of a matrix, filled up with 0."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy()[ends[0] : ends[-1]] if len(column) else np.empty(0, np.int64)
    sizes = np.diff(ends)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def _best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line the k best (score, column), equal scores by the smaller column; _NONE where there are fewer."""
    k_ = min(k, scores.shape[1])
    kth = np.partition(scores, -k_, axis=1)[:, -k_][:, None]
    above = scores > kth
    tied = scores == kth
    take = above | (tied & (np.cumsum(tied, axis=1) <= k_ - above.sum(axis=1)[:, None]))
    line, column = np.nonzero(take)
    column = column.reshape(len(scores), k_)
    out = np.full((len(scores), k), _NONE, dtype=np.int64)
    out[:, :k_] = np.take_along_axis(scores, column, axis=1)
    where = np.zeros((len(scores), k), dtype=np.int64)
    where[:, :k_] = column
    return out, where


class Best:
    """The best k rows so far of every anchor and window: scores, ids, row numbers."""

    def __init__(self, anchors: Anchors, k: int, same_label: bool):
        n, windows = anchors.low.shape
        self.anchors, self.k, self.same = anchors, k, same_label
        self.score = np.full((n, windows, k), _NONE, dtype=np.int64)
        self.id = np.full((n, windows, k), _NO_ID, dtype=np.int64)
        self.row = np.full((n, windows, k), _NO_ID, dtype=np.int64)

    def add(self, row: np.ndarray, id_: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        order = np.lexsort((row, id_))
        row, id_, label, x = row[order], id_[order], label[order], x[order]
        for first in range(0, len(self.anchors.row), _TILE):
            tile = slice(first, first + _TILE)
            scores = packed_scores(self.anchors.x[tile], x)
            fits = (self.anchors.label[tile, None] == label[None, :]) == self.same
            fits &= self.anchors.row[tile, None] != row[None, :]
            for w in range(self.anchors.low.shape[1]):
                least = np.maximum(self.anchors.low[tile, w], self.score[tile, w, -1])
                good = fits & (scores >= least[:, None]) & (scores <= self.anchors.high[tile, w][:, None])
                lines = np.flatnonzero(good.any(axis=1))
                if len(lines):
                    self._merge(first + lines, w, np.where(good[lines], scores[lines], _NONE), row, id_)

    def _merge(self, lines, w, scores, row, id_) -> None:
        new, column = _best_of(scores, self.k)
        none = new == _NONE
        score = np.concatenate([self.score[lines, w], new], axis=1)
        ids = np.concatenate([self.id[lines, w], np.where(none, _NO_ID, id_[column])], axis=1)
        rows = np.concatenate([self.row[lines, w], np.where(none, _NO_ID, row[column])], axis=1)
        order = np.lexsort((rows, ids, -score), axis=1)[:, : self.k]
        for out, values in ((self.score, score), (self.id, ids), (self.row, rows)):
            out[lines, w] = np.take_along_axis(values, order, axis=1)

    def found(self) -> pa.RecordBatch:
        n, w, _ = np.nonzero(self.score != _NONE)
        some = self.score != _NONE
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchors.row[n]), pa.array(w.astype(np.int32)), pa.array(self.score[some]),
             pa.array(self.id[some]), pa.array(self.row[some])],
            names=["anchor", "window", "score", "id", "row"],
        )


_FOUND = "anchor long, window int, score long, id long, row long"


def best_rows(rows: DataFrame, anchors: Anchors, k: int, same_label: bool, block_rows: int) -> DataFrame:
    """(anchor, window, score, id, row, rank): the best k rows in each window of the block's anchors."""
    width = anchors.x.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(anchors, k, same_label)
        for batch in batches:
            for first in range(0, batch.num_rows, block_rows):
                part = batch.slice(first, block_rows)
                row, id_, label = (part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "label"))
                best.add(row, id_, label, matrix(part.column("x"), width))
        yield best.found()

    found = rows.mapInArrow(search, _FOUND)
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _with_floors(rows: DataFrame, anchors: Anchors, k: int, same: bool, p: MiningParams) -> Anchors:
    """The windows cut at the k-th best of a share of the rows; at most k rows a window reach the driver."""
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(p.floor_share)) == 0)
    some = some.coalesce(max(1, rows.rdd.getNumPartitions() // p.floor_share))
    kth = best_rows(some, anchors, k, same, p.block_rows).where(F.col("rank") == k).select("anchor", "window", "score")
    low = anchors.low.copy()
    at = {int(r): i for i, r in enumerate(anchors.row)}
    for anchor, window, score in kth.collect():
        low[at[anchor], window] = max(low[at[anchor], window], score)
    return replace(anchors, low=low)


def usable_rows(rows: DataFrame, params: MiningParams, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, x) of the rows that take part; row is a number of their own."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    picked = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")
    ).where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return picked.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(_NO_ID)).alias("id"), "label",
        F.transform("v", lambda c: F.floor(c.cast("double") * params.scale)).alias("x"),
    )


def _block(table: pa.Table, width: int) -> Anchors:
    row, id_, label = (table.column(c).to_numpy() for c in ("row", "id", "label"))
    x = matrix(table.column("x").combine_chunks(), width) if len(table) else np.zeros((0, width), np.int64)
    any_ = np.full((len(row), 1), _NONE // 2, dtype=np.int64)
    return Anchors(row, id_, label, x, any_, -any_)


def mine_hard_negatives(
    rows: DataFrame, params: MiningParams = MiningParams(), id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``anchor_step``.  Positives are an anchor's
    best other rows of its label; negatives of a pair are the best rows of other labels with
    low_percent * positive_score <= 100 * score <= high_percent * positive_score.
    """
    p = params
    spark = rows.sparkSession
    rows = written(usable_rows(rows, p, id_col, vector_col, label_col), "vectors")
    asked = rows.where((F.col("id") % p.anchor_step == 0) & (F.col("id") != _NO_ID))
    n, width = asked.count(), rows.agg(F.max(F.size("x"))).head()[0] or 0
    # hashed blocks: a block is a quarter larger than the mean only far beyond chance
    blocks = max(1, -(-n * 8 * (width + 8) * 5 // (4 * p.block_bytes)))
    out = new_folder(spark, "negatives")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        anchors = _block(block.toArrow(), width)
        _negatives_of(rows, anchors, p).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def _negatives_of(rows: DataFrame, anchors: Anchors, p: MiningParams) -> DataFrame:
    """The result rows of one block; its positives, ``positives`` an anchor, pass through the driver."""
    anchors = _with_floors(rows, anchors, p.positives, True, p)
    positives = best_rows(rows, anchors, p.positives, True, p.block_rows).collect()
    at = {int(r): i for i, r in enumerate(anchors.row)}
    score, ids = (np.full((len(anchors.row), p.positives), _NONE, dtype=np.int64) for _ in range(2))
    for r in positives:
        score[at[r.anchor], r["rank"] - 1], ids[at[r.anchor], r["rank"] - 1] = r.score, r.id
    low, high = np.full_like(score, 1), np.full_like(score, 0)
    for i, w in zip(*np.nonzero(score != _NONE), strict=True):
        s = int(score[i, w])
        low[i, w], high[i, w] = -(-p.low_percent * s // 100), p.high_percent * s // 100
    anchors = _with_floors(rows, replace(anchors, low=low, high=high), p.negatives, False, p)
    found = best_rows(rows, anchors, p.negatives, False, p.block_rows)
    pairs = pa.table({
        "anchor": np.repeat(anchors.row, p.positives), "window": np.tile(np.arange(p.positives, dtype=np.int32), len(anchors.row)),
        "anchor_id": np.repeat(anchors.id, p.positives), "positive_id": ids.reshape(-1), "positive_score": score.reshape(-1),
    })
    named = rows.sparkSession.createDataFrame(pairs)
    no_id = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    return found.join(F.broadcast(named), ["anchor", "window"]).select(
        "anchor_id", no_id("positive_id").alias("positive_id"), "rank", no_id("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
