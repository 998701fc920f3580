"""Near-duplicates by min-max hashing.

A document's set holds its distinct shingles of five words.  Each of ``n_hashes``
permutations gives two signature values, the smallest and the largest permuted
shingle, so half the hash evaluations fill a signature; a band joins two minima and
two maxima.  Documents that agree in a band meet in a bucket, and inside a bucket
every pair is compared on the full sets.

What moves, in order: texts with equal word sequences become one class (a grouped
minimum, so a hot text costs one row per task); only class heads are banded; buckets
with the same members are compared once; only heads in a shared bucket have their
sets built and shipped.  A bucket above ``block_rows`` is cut into blocks and each
pair of blocks is a task of its own, so no task holds a whole hot bucket; inside a
task shared-shingle counts are one matrix product, and what comes out is a spanning
set of links, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.components import components
from tamarisk.llm.skew import join_statistics
from tamarisk.llm.textbytes import Chunk, chunks, mix, signed, words
from tamarisk.operators.lineage import written

_U = np.uint64
_COLUMNS = 4096  # shingles per matrix product


@dataclass(frozen=True)
class NearDupParams:
    """Two documents link when ``100 * |A & B| >= percent * |A | B|``.

    At percent 85 a linked pair misses one band of two permutations with
    probability 1 - 0.85**4 = 0.48, and all 24 with 2e-8.
    """

    percent: int = 80
    shingle_words: int = 5
    bands: int = 24
    seed: int = 7
    block_rows: int = 1024

    @property
    def n_hashes(self) -> int:
        return 2 * self.bands


def _multipliers(p: NearDupParams) -> np.ndarray:
    return np.random.default_rng(p.seed).integers(1, 2**62, p.n_hashes, dtype=np.uint64) * _U(2) + _U(1)


def _weights(k: int) -> np.ndarray:
    return np.random.default_rng(k).integers(1, 2**62, k, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(chunk: Chunk, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: hashes of its words, and its sorted set of shingle hashes."""
    found = words(chunk)
    weights = _weights(k)
    h = found.hashes
    rolled = np.zeros(max(len(h) - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        rolled += h[j : j + len(rolled)] * weights[j]
    rolled = mix(rolled)
    for i in range(len(chunk)):
        lo, hi = found.first[i], found.first[i + 1]
        own = h[lo:hi]
        if hi - lo >= k:
            yield own, np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            yield own, mix(np.sum(own * weights[: hi - lo], keepdims=True) + _U(hi - lo))
        else:
            yield own, own


def min_max(shingles: np.ndarray, multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of the set under each permutation."""
    low = np.full(len(multipliers), 2**64 - 1, dtype=np.uint64)
    high = np.zeros(len(multipliers), dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        permuted = multipliers[:, None] * shingles[None, at : at + 4096]
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    return low, high


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _banded(p: NearDupParams):
    multipliers = _multipliers(p)
    salt = _weights(64)[: p.bands] if p.bands <= 64 else _weights(p.bands)

    def run(batches):
        for batch in batches:
            ids, n, digest, bands = batch.column(0), [], [], []
            for chunk in chunks(batch.column(1)):
                for own, shingles in shingle_sets(chunk, p.shingle_words):
                    n.append(len(shingles))
                    digest.append(_digest(own))
                    if not len(shingles):
                        bands.append([])
                        continue
                    low, high = min_max(shingles, multipliers)
                    key = (low[::2] * _U(3) + mix(low[1::2])) ^ mix(high[::2] * _U(5) + mix(high[1::2] + _U(1)))
                    bands.append(signed(mix(key + salt)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            digest, sets = [], []
            for chunk in chunks(batch.column(1)):
                for own, shingles in shingle_sets(chunk, k):
                    digest.append(_digest(own))
                    sets.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(sets, pa.large_binary())],
                ["head", "digest", "shingles"],
            )

    return run


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Index of the smallest member each set is connected to by links among these sets."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(m), sizes)
    if m == 2:
        shared = np.zeros((2, 2))
        shared[0, 1] = shared[1, 0] = sizes.sum() - len(np.unique(np.concatenate(sets)))
    else:
        order = np.argsort(flat := np.concatenate(sets), kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.append(True, flat[1:] != flat[:-1])
        column = np.cumsum(new) - 1
        keep = np.bincount(column)[column] > 1
        owner, column = owner[keep], column[keep]
        if len(column):
            column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
        shared = np.zeros((m, m), dtype=np.float64)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + _COLUMNS])
            part = np.zeros((m, min(_COLUMNS, int(column[hi - 1]) - at + 1)), dtype=np.float32)
            part[owner[lo:hi], column[lo:hi] - at] = 1
            shared += part @ part.T
    link = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(link, False)
    least = np.arange(m)
    seen = np.zeros(m, dtype=bool)
    for i in np.flatnonzero(link.any(axis=1)):
        if seen[i]:
            continue
        reached, edge = np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
        reached[i] = edge[i] = True
        while edge.any():
            edge = link[edge].any(axis=0) & ~reached
            reached |= edge
        seen |= reached
        least[reached] = i
    return least


def _confirm(percent: int):
    """Rows (bucket, part, head, node, shingles), sorted by bucket and part, to links of heads in each group."""

    def run(batches):
        key, heads, sets, seen = None, [], [], set()

        def flush():
            if len(heads) > 1:
                order = np.argsort(heads)
                ids = np.array(heads)[order]
                least = linked([sets[i] for i in order], percent)
                far = np.flatnonzero(least != np.arange(len(ids)))
                return ids[far], ids[least[far]]
            return np.empty(0, np.int64), np.empty(0, np.int64)

        for batch in batches:
            bucket, part, head, node = (batch.column(i).to_numpy() for i in range(4))
            out = []
            for i in range(len(batch)):
                now = (bucket[i], part[i])
                if now != key:
                    out.append(flush())
                    key, heads, sets, seen = now, [], [], set()
                # texts of one id may differ and have the same words
                if (head[i], node[i]) in seen:
                    continue
                seen.add((head[i], node[i]))
                heads.append(int(head[i]))
                sets.append(np.frombuffer(batch.column(4)[i].as_buffer(), dtype=np.uint64).copy())
            if out:
                yield _links(out)
        yield _links([flush()])

    def _links(pairs):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([x[i] for x in pairs]), pa.int64()) for i in (0, 1)], ["a", "b"]
        )

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    params: NearDupParams = NearDupParams()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links, kept whether it is the
    row's own.  A text without words (or null) has n_shingles 0 and links with nothing.
    A text of fewer words than a shingle is one shingle.  Rows that share an id are one
    node: their texts are connected.  A row with a null id links with nothing: its
    component_id is null and it is kept.  Other columns are not looked at.
    """
    p = params
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = written(
        texts.mapInArrow(_banded(p), "doc_id long, n_shingles long, digest binary, bands array<long>"), "near-base"
    )
    live = base.where("doc_id is not null and n_shingles > 0")
    total = live.count()
    heads = written(live.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")), "near-heads")
    placed = written(
        join_statistics(live, heads, "digest", "n", total).select(
            "doc_id", "head", F.xxhash64("digest").alias("node"),
            F.when(F.col("doc_id") == F.col("head"), F.col("bands")).alias("bands"),
        ),
        "near-placed",
    )
    # a node is a class of texts; its head may stand on several
    banded = placed.where("bands is not null").dropDuplicates(["head", "node"])
    member = banded.select("head", "node", F.explode("bands").alias("bucket"))
    shape = (
        member.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min("head").alias("least"),
             F.bit_xor(F.xxhash64("head", "node")).alias("x"),
             F.bit_xor(F.xxhash64(F.lit("near"), "head", "node")).alias("y"))
        .where("n > 1")
    )
    # buckets with the same members are one
    chosen = shape.groupBy("n", "least", "x", "y").agg(F.min("bucket").alias("bucket")).select(
        "bucket", F.ceil(F.col("n") / p.block_rows).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("head", "node", "bucket"), F.col("blocks")).cast("int")
    inside = written(
        member.join(chosen.hint("merge"), "bucket").select(
            "bucket", "head", "node",
            F.explode(F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda j: F.least(j, block) * F.col("blocks") + F.greatest(j, block),
            )).alias("part"),
        ),
        "near-inside",
    )
    asked = inside.select("head").distinct()
    head_texts = texts.join(asked.hint("merge"), texts["doc_id"] == asked["head"]).select("head", "text").distinct()
    sets = head_texts.mapInArrow(_sets(p.shingle_words), "head long, digest binary, shingles binary").select(
        "head", F.xxhash64("digest").alias("node"), "shingles"
    )
    links = (
        inside.join(sets.hint("merge"), ["head", "node"]).select("bucket", "part", "head", "node", "shingles")
        .repartition("bucket", "part").sortWithinPartitions("bucket", "part")
        .mapInArrow(_confirm(p.percent), "a long, b long")
    )
    # one id on several texts connects their classes
    shared = placed.groupBy("doc_id").agg(F.min("head").alias("b"), F.max("head").alias("most")).where("b < most")
    tied = placed.join(shared, "doc_id").select(F.col("head").alias("a"), "b")
    found = components(links.unionByName(tied), "a", "b")
    answer = (
        placed.select("doc_id", "head").distinct()
        .join(found, F.col("head") == F.col("node"), "left")
        .groupBy("doc_id").agg(F.min(F.coalesce("component", "head")).alias("component_id"))
    )
    return (
        base.select("doc_id", "n_shingles").join(answer, "doc_id", "left")
        .select(
            "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
            (F.col("doc_id").isNull() | (F.coalesce("component_id", "doc_id") == F.col("doc_id"))).alias("kept"),
        )
    )
