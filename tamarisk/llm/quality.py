"""Quality rules: counts of a text, and a calibrated n-gram classifier.

``fit_quality`` learns a logistic regression on hashed n-grams (words, word pairs and
strings of four code points, each as shares of its kind) from labelled rows, and fits the
probability on rows it did not learn from.  ``judge`` counts and scores whole texts in
Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.textbytes import Chunk, Words, chunks, mix, span_hash, prefix_hash, words

_U = np.uint64
BITS = 15
_SIZE = 1 << BITS
KINDS = 3
#: characters counted as symbols
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class QualityParams:
    """``sample_rows`` bounds the labelled rows the model is fitted on (taken by hash of the id)."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window_words: int = 8
    keep_at: float = 0.5
    sample_rows: int = 2000
    seed: int = 11


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # KINDS * 2**BITS
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _grams(chunk: Chunk, found: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind: bucket of every n-gram, and for each text its first and its end."""
    h, first = found.hashes, found.first
    single = (h >> _U(64 - BITS)).astype(np.int32)
    pair = np.zeros(len(h), dtype=np.int32)
    pair[:-1] = (mix(h[:-1] * _U(3) + h[1:]) >> _U(64 - BITS)).astype(np.int32)
    # windows of four code points, whatever number of bytes each takes
    data = chunk.data
    char = np.flatnonzero((data & 0xC0) != 0x80)
    four = np.zeros(len(char), dtype=np.int32)
    if len(char) > 3:
        ends = np.append(char[4:], len(data))
        four[:-3] = (span_hash(prefix_hash(data), char[:-3], ends) >> _U(64 - BITS)).astype(np.int32)
    at = np.searchsorted(char, chunk.offsets)
    return [
        (single, first[:-1], first[1:]),
        (pair + _SIZE, first[:-1], np.maximum(first[1:] - 1, first[:-1])),
        (four + 2 * _SIZE, at[:-1], np.maximum(at[1:] - 3, at[:-1])),
    ]


def margins(chunk: Chunk, found: Words, weights: np.ndarray) -> np.ndarray:
    """Sum of the mean weights of each kind, per text."""
    total = np.zeros(len(chunk))
    for bucket, lo, hi in _grams(chunk, found):
        sums = np.append(0.0, np.cumsum(weights[bucket], dtype=np.float64))
        total += (sums[hi] - sums[lo]) / np.maximum(hi - lo, 1)
    return total


def _features(batches):
    for batch in batches:
        index, value = [], []
        for chunk in chunks(batch.column(1)):
            grams = _grams(chunk, words(chunk))
            for i in range(len(chunk)):
                own = [np.unique(b[lo[i] : hi[i]], return_counts=True) for b, lo, hi in grams]
                index.append(np.concatenate([ids for ids, _ in own]).astype(np.int32))
                value.append(np.concatenate([n / max(n.sum(), 1) for _, n in own]).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([x.tobytes() for x in index], pa.binary()),
             pa.array([x.tobytes() for x in value], pa.binary())],
            ["doc_id", "label", "idx", "val"],
        )


def _descend(row, idx, val, y, n, rounds=150, rate=2.0, ridge=1e-6):
    """Adam on the logistic loss of sparse rows."""
    w, bias = np.zeros(KINDS * _SIZE), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        margin = np.bincount(row, weights=w[idx] * val, minlength=n) + bias
        miss = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y) / n
        g, gb = np.bincount(idx, weights=miss[row] * val, minlength=len(w)) + ridge * w, miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-9)
        bias -= 0.1 * fix * mb / (np.sqrt(vb) + 1e-9)
    return w.astype(np.float32), float(bias)


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability, by Newton steps with smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y > 0, hi, lo)
    x = np.stack([margin, np.ones(len(margin))])
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -50, 50)))
        hess = (x * (p * (1 - p) + 1e-9)) @ x.T + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(hess, x @ (p - target)), -2, 2)
    return (float(max(ab[0], 1e-3)), float(ab[1]))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", params: QualityParams = QualityParams()) -> QualityModel | None:
    """The model, from at most ``sample_rows`` labelled ids; None without rows of both classes.

    An id that is labelled both ways, or null, is left out, as are ids without a text.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most").select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most sample_rows rows of two numbers
    sample = texts.where("text is not null").join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")
    rows = sample.mapInArrow(_features, "doc_id long, label int, idx binary, val binary").collect()
    rows = {r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], r["idx"]))}
    rows = [rows[k] for k in sorted(rows)]
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    if len(set(y)) < 2:
        return None
    idx = [np.frombuffer(r["idx"], dtype=np.int32) for r in rows]
    val = [np.frombuffer(r["val"], dtype=np.float32) for r in rows]
    held = np.random.default_rng(params.seed).random(len(rows)) < 0.2

    def fit(take):
        which = np.flatnonzero(take)
        row = np.repeat(np.arange(len(which)), [len(idx[i]) for i in which])
        return _descend(row, np.concatenate([idx[i] for i in which]), np.concatenate([val[i] for i in which]),
                        y[which], len(which))

    slope, shift = 1.0, 0.0
    if len(set(y[held])) == 2 and len(set(y[~held])) == 2:
        w, bias = fit(~held)
        margin = np.array([float(w[idx[i]] @ val[i]) for i in np.flatnonzero(held)]) + bias
        slope, shift = _platt(margin, y[held])
    else:
        w, bias = fit(np.ones(len(rows), dtype=bool))
    return QualityModel(w, bias, slope, shift)


def _per_text(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return sums[hi] - sums[lo]


def counts(chunk: Chunk, found: Words, window: int) -> dict[str, np.ndarray]:
    """The rule counts of each text of a chunk."""
    data, at, first = chunk.data, chunk.offsets, found.first
    n_words = np.diff(first)
    lead = (data & 0xC0) != 0x80
    sums = np.append(0, np.cumsum(lead, dtype=np.int64))
    word_chars = _per_text(sums[found.ends] - sums[found.starts], first[:-1], first[1:])
    # lines: cut at \n and at the ends of texts
    text_of = np.repeat(np.arange(len(chunk)), np.diff(at))
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.concatenate([at[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(chunk)), text_of[breaks]])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    stop = np.append(begin[1:] - 1, 0)
    last = np.append(owner[1:] != owner[:-1], True)
    stop[last] = at[owner[last] + 1]
    with_word = np.searchsorted(found.starts, stop) > np.searchsorted(found.starts, begin)
    begin, stop, owner = begin[with_word], stop[with_word], owner[with_word]
    line = span_hash(prefix_hash(data), begin, stop)
    order = np.lexsort((line, owner))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    dup_lines = np.bincount(owner[order][again], minlength=len(chunk))
    # windows of words
    h = found.hashes
    rolled = np.zeros(max(len(h) - window + 1, 0), dtype=np.uint64)
    for j in range(window):
        rolled += h[j : j + len(rolled)] * _U(2 * j * j + 7919 * j + 1)
    of_word = np.repeat(np.arange(len(chunk)), n_words)
    inside = np.flatnonzero(of_word[: len(rolled)] == of_word[window - 1 :]) if len(rolled) else np.empty(0, dtype=np.int64)
    key = mix(rolled[inside]) ^ mix(of_word[inside].astype(np.uint64) + _U(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = inside[order[twice]]
    step = np.zeros(len(h) + 1, dtype=np.int64)
    step[start] += 1
    step[start + window] -= 1
    repeat = _per_text(np.cumsum(step[:-1]) > 0, first[:-1], first[1:])
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": _per_text(_SYMBOL[data], at[:-1], at[1:]),
        "n_dup_lines": dup_lines, "n_repeat_words": repeat,
    }


_OUT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, quality_probability double, kept boolean")


def _judged(model: QualityModel | None, p: QualityParams):
    def run(batches):
        for batch in batches:
            parts = []
            for chunk in chunks(batch.column(1)):
                found = words(chunk, lower=False)
                part = counts(chunk, found, p.window_words)
                if model is None:
                    part["p"] = np.ones(len(chunk))
                else:
                    # the classifier looks at lower-case words
                    part["p"] = model.probability(margins(chunk, words(chunk), model.weights) + model.bias)
                parts.append(part)
            if not parts:
                continue
            c = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
            failed = (c["n_words"] < p.min_words) | (100 * c["n_repeat_words"] > p.max_repeat_percent * c["n_words"])
            kept = ~failed & (c["p"] >= p.keep_at)
            numbers = [pa.array(c[k], pa.int64()) for k in
                       ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers, pa.array(failed), pa.array(c["p"]), pa.array(kept)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "quality_probability", "kept"],
            )

    return run


def judge(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text",
          params: QualityParams = QualityParams()) -> DataFrame:
    """Counts, probability of good quality and verdict of every row.

    A null or empty text has no words and fails.  Without a model the probability is 1
    and the counts alone decide.  Null and repeated ids are rows like others; other
    columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_judged(model, params), _OUT)
