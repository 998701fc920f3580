"""Language-model scores of whole documents.

Learning: every training token is counted (64-bit hashes stand for words); the
``vocabulary`` most frequent tokens become outputs of a gated recurrent model, all
others share one.  The model learns from every training document: a round's documents are
dealt by hash to learners of about ``learner_tokens`` tokens, each in a fixed order; all
start from the same weights, and their weights are averaged by Spark as grouped sums.  The
number of learners follows from the number of tokens, so what is learned does not depend on
how the rows are laid out, and more data makes more learners, not longer ones.

Scoring: a task scores its documents in lanes.  Counts of the ``frequent`` most
frequent tokens (a fixed number) travel with the task; those of rarer tokens are
joined by token, so no count table grows on any machine.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.gru import Model, Shape, initial, shape_for
from tamarisk.llm.textbytes import HashTable, chunks, signed, words
from tamarisk.operators.lineage import written

_U = np.uint64
#: stands for the end of a text; hashes of words are spread over 64 bits
END = np.uint64(1)
_LN10 = float(np.log(10))


@dataclass(frozen=True)
class LmParams:
    vocabulary: int = 2047
    classes: int = 32
    hidden: int = 16
    rounds: int = 4
    learner_tokens: int = 1_000_000
    rate: float = 0.6
    frequent: int = 1 << 18
    lane_tokens: int = 4_000_000  # tokens a task lays out at a time
    seed: int = 5


@dataclass
class LanguageModel:
    """What scoring needs: totals, the frequent tokens, and the recurrent model."""

    total: int  # N
    distinct: int  # V
    keys: np.ndarray  # frequent tokens, most frequent first
    counts: np.ndarray
    output: np.ndarray  # model output of each frequent token
    rest: int  # output shared by all other tokens
    rest_total: int
    rest_distinct: int
    shape: Shape
    weights: np.ndarray
    tokens: DataFrame  # (token, n), every training token


def _tokens(text_column):
    """Per text: hashes of its words, then the end."""
    for chunk in chunks(text_column):
        found = words(chunk)
        for i in range(len(chunk)):
            yield np.append(found.of(i), END)


def _counted(batches, most: int = 1 << 20):
    """Token counts of a task, merged in memory up to a fixed number of tokens."""
    held, size = [], 0

    def merged():
        keys = np.concatenate([k for k, _ in held])
        uniq, at = np.unique(keys, return_inverse=True)
        return uniq, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def out(pair):
        return pa.RecordBatch.from_arrays([pa.array(signed(pair[0])), pa.array(pair[1])], ["token", "n"])

    for batch in batches:
        for chunk in chunks(batch.column(0)):
            h = np.concatenate([words(chunk).hashes, np.full(len(chunk), END)])
            held.append(np.unique(h, return_counts=True))
            size += len(held[-1][0])
            if size > 2 * most:
                held = [merged()]
                size = len(held[0][0])
                if size > most:
                    yield out(held[0])
                    held, size = [], 0
    if held:
        yield out(merged())


def _groups(batches, column: int, most: int):
    """Lists of (place, token hashes) of about ``most`` tokens, with the batches' other columns."""
    ids, docs, size = [], [], 0
    for batch in batches:
        other = batch.column(1 - column).to_pylist() if batch.num_columns > 1 else [None] * len(batch)
        for key, h in zip(other, _tokens(batch.column(column)), strict=True):
            ids.append(key)
            docs.append(h)
            size += len(h)
            if size >= most:
                yield ids, docs
                ids, docs, size = [], [], 0
    if docs:
        yield ids, docs


def _trained(table: HashTable, output: np.ndarray, rest: int, shape: Shape, flat: np.ndarray, rate: float, most: int):
    """Rows (learner, text), a learner's rows together, to each learner's weights by tokens seen."""

    def learned(docs):
        model, past, seen, held, size = Model(shape, flat.copy()), None, 0, [], 0
        for h in docs:
            at = table.find(h)
            held.append(np.where(at < 0, rest, output[at]).astype(np.int32))
            seen, size = seen + len(h), size + len(h)
            if size >= most:
                past, held, size = model.train(held, rate, past), [], 0
        if held:
            model.train(held, rate, past)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(shape.size, dtype=np.int32)), pa.array(model.flat.astype(np.float64) * seen),
             pa.array(np.full(shape.size, float(seen)))], ["i", "weighted", "seen"])

    def run(batches):
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), _tokens(batch.column(1)), strict=True))
        for _, own in groupby(rows, key=lambda row: row[0]):
            yield learned(h for _, h in own)

    return run


def _most_frequent(tokens: DataFrame, most: int) -> list:
    """Tokens above the lowest count step that leaves at most ``most`` of them, most frequent first.

    Steps are sixteenths of powers of two, so about a thousand numbers decide, and
    never more than ``most`` rows reach the driver.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(tokens.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True)
    taken, least = 0, None
    for at, n in sizes:
        if taken + n > most:
            break
        taken, least = taken + n, at
    if least is None:
        return []
    return sorted(tokens.where(step >= least).collect(), key=lambda r: (-r["n"], r["token"]))


def fit_lm(docs: DataFrame, text_col: str = "text", seed_col: Column | None = None,
           params: LmParams = LmParams()) -> LanguageModel:
    """Learn from every row of ``docs``; ``seed_col`` decides a row's round and learner (default: hash of the text)."""
    p = params
    text = F.col(text_col).cast("string")
    seed = F.coalesce(seed_col if seed_col is not None else F.xxhash64(text), F.lit(0))
    texts = docs.select(text.alias("text"), seed.alias("seed"))
    tokens = written(
        texts.select("text").mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")),
        "lm-tokens",
    )
    total, distinct = (int(x or 0) for x in tokens.agg(F.sum("n"), F.count("*")).first())
    top = _most_frequent(tokens, p.frequent)
    keys = np.array([r["token"] for r in top], dtype=np.int64).view(np.uint64)
    counts = np.array([r["n"] for r in top], dtype=np.int64)
    chosen = np.arange(min(p.vocabulary, len(keys)))
    end = np.flatnonzero(keys == END)
    if len(chosen) and len(end) and end[0] >= len(chosen):
        chosen[-1] = end[0]
    inside = int(counts[chosen].sum())
    frequency = np.append(counts[chosen], max(total - inside, 1)).astype(np.float64)
    order = np.argsort(-frequency, kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    rest = int(place[-1])
    output = np.full(len(keys), rest, dtype=np.int32)
    output[chosen] = place[:-1]
    frequency = frequency[order]
    shape = shape_for(frequency, p.classes, p.hidden)
    flat = initial(shape, frequency, p.seed)
    table = HashTable(keys[output != rest])
    learned = output[output != rest]
    learners = max(1, -(-total // (p.rounds * p.learner_tokens)))
    dealt = texts.select(
        F.pmod("seed", F.lit(p.rounds)).alias("turn"), F.pmod(F.xxhash64("seed", "text"), F.lit(learners)).alias("learner"),
        F.xxhash64(F.lit(1), "seed", "text").alias("place"), "text",
    )
    for r in range(p.rounds if len(keys) else 0):
        mean = (
            dealt.where(F.col("turn") == r).repartition("learner").sortWithinPartitions("learner", "place", "text")
            .select("learner", "text").mapInArrow(_trained(table, learned, rest, shape, flat, p.rate, p.lane_tokens),
                        "i int, weighted double, seen double")
            .groupBy("i").agg((F.sum("weighted") / F.sum("seen")).alias("w"))
            .collect()  # as many rows as the model has weights
        )
        if mean:
            flat = np.empty(shape.size, dtype=np.float32)
            flat[[x["i"] for x in mean]] = [x["w"] for x in mean]
    return LanguageModel(total, distinct, keys, counts, output, rest, total - inside, distinct - len(chosen),
                         shape, flat, tokens)


_PART = ("row long, doc_id long, n_tokens long, n_known long, base_score double, score double, "
         "rare array<long>, rare_n array<long>")


def _scored(m: dict, most: int):
    def run(batches):
        table = HashTable(m["keys"])
        base = np.log10((m["counts"] + 1) / (m["total"] + m["distinct"] + 1))
        output = np.append(m["output"], m["rest"]).astype(np.int32)  # its last place, -1, is for tokens not found
        # a token outside the vocabulary: the shared output, then its share of the rest
        extra = np.where(m["output"] == m["rest"], np.log10((m["counts"] + 1) / m["norm"]), 0.0)
        model = Model(m["shape"], m["weights"])
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for ids, docs in _groups(batches, 1, most):
            out = {k: [] for k in ("n", "known", "base", "extra", "rare", "rare_n")}
            tokens = []
            for h in docs:
                at = table.find(h)
                hit = at[at >= 0]
                tokens.append(output[at])
                rare, n = np.unique(h[at < 0], return_counts=True)
                out["n"].append(len(h))
                out["known"].append(len(hit))
                out["base"].append(base[hit].sum())
                out["extra"].append(extra[hit].sum())
                out["rare"].append(signed(rare))
                out["rare_n"].append(n)
            score = model.score(tokens) / _LN10 + np.array(out["extra"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.int64()), pa.array(out["n"], pa.int64()),
                 pa.array(out["known"], pa.int64()), pa.array(out["base"], pa.float64()), pa.array(score, pa.float64()),
                 pa.array(out["rare"], pa.list_(pa.int64())), pa.array(out["rare_n"], pa.list_(pa.int64()))],
                ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "rare_n"],
            )
            row += len(ids)

    return run


def score_lm(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
             params: LmParams = LmParams()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row.

    A null or empty text is the end token alone.  Rows are scored one by one, so null
    and repeated ids are rows like others.  A model without training tokens gives every
    token probability 1 in the base score.
    """
    norm = model.rest_total + model.rest_distinct + 1
    plain = {
        "keys": model.keys, "counts": model.counts, "output": model.output, "rest": model.rest, "total": model.total,
        "distinct": model.distinct, "norm": norm, "shape": model.shape, "weights": model.weights,
    }
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    part = written(texts.mapInArrow(_scored(plain, params.lane_tokens), _PART), "lm-part")
    rare = part.where(F.size("rare") > 0).select("row", F.inline(F.arrays_zip("rare", "rare_n")))
    # tokens beyond the frequent ones, so none is hot
    known = rare.join(model.tokens.hint("merge"), F.col("rare") == F.col("token"), "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = known.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("rare_n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("rare_n") * F.log10((c + 1) / F.lit(model.total + model.distinct + 1))).alias("more_base"),
        F.sum(F.col("rare_n") * F.log10((c + 1) / F.lit(norm))).alias("more_score"),
    )
    zero = F.lit(0.0)
    return part.join(sums.hint("merge"), "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
