"""Secrets in texts: fixed patterns, and strings that look drawn at random.

Two character Markov models, of random strings and of ordinary identifiers, are
counted from labelled samples and from identifiers made by rule.  In a run of identifier
characters, the stretches whose log-likelihood ratio favours the random model by
``least_ratio`` in all and ``least_mean`` a character are secrets, up to the next joiner on
either side; so a path keeps its ordinary parts.  Fixed spans are cut out of runs first.  Scanning is a map over Arrow batches; the models
are two small matrices.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.skew import hash_sample
from tamarisk.llm.textbytes import chunks
from tamarisk.operators.lineage import written

#: fixed values: kinds in their order, and the patterns of the first three
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_WORDS = re.compile(rb"[A-Za-z0-9+/_=-]{6,}")
#: fixed values: words of ordinary identifiers
IDENTIFIER_WORDS = (
    "account action address admin archive array assets backup base batch block body buffer build bundle button cache "
    "calendar cancel category change channel check class client cluster code column comment commit common component "
    "config connection container content context control controller count create current custom data database default "
    "delete detail device directory display document domain download driver element email enable entity entry error "
    "event example export factory field file filter folder format frame function gateway global group handler header "
    "history home image import index info input install instance interface internal item language layer layout library "
    "license list loader local location manager master memory message method model module network node notification "
    "number object option order output package page parameter parent payment plugin policy private process product "
    "profile project provider public query queue record release report request resource response result role schema "
    "search section security server service session setting source start state status storage string system table "
    "target template test text thread time type update upload user validation value version view window world"
).split()
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_N = len(ALPHABET)
_SYMBOL = np.full(256, _N, dtype=np.uint8)
_SYMBOL[list(ALPHABET)] = np.arange(_N)
_JOINER = np.zeros(256, dtype=bool)
_JOINER[list(b"+/_=-")] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True


@dataclass(frozen=True)
class SecretParams:
    """``sample_rows`` bounds the labelled strings of each class that the models count, ``made_rows``
    is how many strings of each class are made by rule besides."""

    least_value: int = 6
    least_access: int = 20
    least_hex: int = 24
    least_run: int = 16
    least_ratio: float = 12.0
    least_mean: float = 0.3
    sample_rows: int = 20_000
    made_rows: int = 6000
    smooth: float = 0.1


@dataclass(frozen=True)
class SecretModel:
    """Log-ratio of each character after each other; row ``len(ALPHABET)`` is the start."""

    ratio: np.ndarray

    def score(self, value: str) -> float:
        s = _SYMBOL[np.frombuffer(value.encode(), dtype=np.uint8)]
        s = s[s < _N]
        return float(self.ratio[np.append(_N, s[:-1]), s].sum()) if len(s) else 0.0


def _runs(mask: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a mask, cut at the edges of texts."""
    padded = np.concatenate([[False], mask, [False]])
    starts = np.flatnonzero(padded[1:-1] & (~padded[:-2] | edge[:-1]))
    ends = np.flatnonzero(padded[1:-1] & (~padded[2:] | edge[1:])) + 1
    return starts, ends


def random_strings(n: int, seed: int = 3) -> list[str]:
    """Labelled samples of the random class: hexadecimal, base-32, base-62 and base-64 strings."""
    rng = np.random.default_rng(seed)
    sets = (b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64])
    return [bytes(rng.choice(list(sets[i % 4]), rng.integers(16, 65)).astype(np.uint8)).decode() for i in range(n)]


def ordinary_strings(n: int, seed: int = 4) -> list[str]:
    """Labelled samples of the ordinary class: identifiers in the usual styles, paths, ids with dashes,
    dates, and one character or an alphabet repeated."""
    rng = np.random.default_rng(seed)
    hexes = lambda k: bytes(rng.choice(list(b"0123456789abcdef"), k).astype(np.uint8)).decode()
    out = []
    for i in range(n):
        words = [IDENTIFIER_WORDS[j] for j in rng.integers(0, len(IDENTIFIER_WORDS), rng.integers(2, 9))]
        number = str(rng.integers(0, 10_000))
        c = chr(ALPHABET[i // 10 % 66])
        out.append((
            lambda: words[0] + "".join(w.title() for w in words[1:]), lambda: "".join(w.title() for w in words),
            lambda: "_".join(words), lambda: "-".join(words) + "-" + number, lambda: "_".join(words).upper(),
            lambda: "/" + "/".join(words) + "/" + number, lambda: "".join(words),
            lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12)), lambda: c * int(rng.integers(6, 40)),
            lambda: f"{rng.integers(1990, 2040)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}" + "0123456789abcdefghijklmnopqrstuvwxyz"[: i % 36],
        )[i % 10]())
    return out


def fit_secrets(samples: DataFrame, value_col: str = "value", label_col: str = "secret",
                params: SecretParams = SecretParams()) -> SecretModel | None:
    """Both models, from labelled strings (``label_col`` true: random); None if a class is missing.

    Null, empty and repeated values count once or not at all; at most ``sample_rows``
    of each class are taken, by the hash of the value, and ``made_rows`` made by rule.
    """
    value, label = F.col(value_col).cast("string").alias("value"), F.col(label_col).cast("boolean").alias("secret")
    # counted and read, so the distinct values are not looked for twice
    known = written(
        samples.select(value, label).where("length(value) > 0 and secret is not null").distinct(), "secret-samples"
    )
    logs = []
    for secret, made in ((True, random_strings(params.made_rows, seed=5)), (False, ordinary_strings(params.made_rows))):
        rows = hash_sample(known.where(F.col("secret") == secret), ["value"], params.sample_rows).select("value").collect()
        if not rows:
            return None
        n = np.full((_N + 1, _N), params.smooth)
        for text in (*(r[0] for r in rows), *made):
            s = _SYMBOL[np.frombuffer(text.encode(), dtype=np.uint8)]
            s = s[s < _N].astype(np.int64)
            np.add.at(n, (np.append(_N, s[:-1])[: len(s)], s), 1)
        logs.append(np.log(n / n.sum(axis=1, keepdims=True)))
    return SecretModel((logs[0] - logs[1]).astype(np.float32))


def base_spans(text: bytes, p: SecretParams) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns other than hex."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= p.least_value]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= p.least_access]
    return out


def stretches(sums: np.ndarray, joiner: np.ndarray, p: SecretParams) -> list[tuple[int, int]]:
    """Secrets of a run, from the prefix sums of its ratios: its best stretches.

    A stretch has the largest sum of all with ``least_run`` characters or more; it is
    widened to the joiners around it, and what is left on either side is searched again.
    """
    n = len(joiner)
    out, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < p.least_run:
            continue
        least = np.minimum.accumulate(sums[lo : hi - p.least_run + 1])
        gain = sums[lo + p.least_run : hi + 1] - least
        k = int(np.argmax(gain))
        if gain[k] < p.least_ratio:
            continue
        b = lo + p.least_run + k
        a = lo + int(np.argmin(sums[lo : lo + k + 1]))
        if not joiner[a]:
            edges = np.flatnonzero(joiner[lo:a])
            a = lo + int(edges[-1]) + 1 if len(edges) else lo
        if not joiner[b - 1]:
            edges = np.flatnonzero(joiner[b:hi])
            b = b + int(edges[0]) if len(edges) else hi
        a, b = _trimmed(sums, joiner, a, b, p)
        if b - a >= p.least_run and sums[b] - sums[a] >= max(p.least_ratio, p.least_mean * (b - a)):
            out.append((a, b))
        if b > a:
            todo += [(lo, a), (b, hi)]
    return sorted(out)


def _trimmed(sums: np.ndarray, joiner: np.ndarray, a: int, b: int, p: SecretParams) -> tuple[int, int]:
    """A stretch without the parts between joiners at its ends that look ordinary by themselves."""
    ordinary = lambda lo, hi: sums[hi] - sums[lo] < p.least_mean * (hi - lo) or lo == hi
    marks = np.flatnonzero(joiner[a:b]) + a
    first, last = 0, len(marks)
    while first < last and ordinary(a, marks[first]):
        a, first = int(marks[first]) + 1, first + 1
    while last > first and ordinary(int(marks[last - 1]) + 1, b):
        b, last = int(marks[last - 1]), last - 1
    return a, b


def scan_chunk(chunk, model: SecretModel | None, p: SecretParams) -> list[list[tuple[int, int, int]]]:
    """Of each text its spans (start, kind, end) in bytes, sorted."""
    data, at = chunk.data, chunk.offsets
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    found: dict[int, list] = {}
    raw = data.tobytes()
    for i in range(len(chunk)):
        spans = base_spans(raw[at[i] : at[i + 1]], p)
        if spans:
            found[i] = spans
    starts, ends = _runs(_HEX[data], edge)
    long = ends - starts >= p.least_hex
    for s, e in zip(starts[long], ends[long], strict=True):
        i = int(np.searchsorted(at, s, side="right")) - 1
        found.setdefault(i, []).append((int(s - at[i]), 2, int(e - at[i])))
    if model is not None and len(data):
        symbol = _SYMBOL[data]
        free = symbol < _N
        for i, spans in found.items():
            for a, _, b in spans:
                free[at[i] + a : at[i] + b] = False
        starts, ends = _runs(free, edge)
        long = ends - starts >= p.least_run
        starts, ends = starts[long], ends[long]
        before = np.append(_N, symbol[:-1]).astype(np.uint8)
        before[starts] = _N
        wide = np.zeros((_N + 1, _N + 1), dtype=np.float32)
        wide[:, :_N] = model.ratio
        ratio = wide[before, symbol]
        sums = np.append(0.0, np.cumsum(ratio, dtype=np.float64))
        most = np.append(0.0, np.cumsum(np.maximum(ratio, 0), dtype=np.float64))
        # no stretch of a run scores more than its positive ratios
        for k in np.flatnonzero(most[ends] - most[starts] >= p.least_ratio):
            s, e = int(starts[k]), int(ends[k])
            i = int(np.searchsorted(at, s, side="right")) - 1
            own = stretches(sums[s : e + 1], _JOINER[data[s:e]], p)
            if own:
                found.setdefault(i, []).extend((int(s - at[i]) + a, 3, int(s - at[i]) + b) for a, b in own)
    return [sorted(found.get(i, ())) for i in range(len(chunk))]


def _points(text: np.ndarray, spans):
    """The spans in code points."""
    before = np.append(0, np.cumsum((text & 0xC0) != 0x80))
    return [(int(before[s]), kind, int(before[e])) for s, kind, e in spans]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scanned(model, p: SecretParams, mark: str | None):
    """Rows (doc_id, text) to counts and spans; with ``mark`` also the text with secrets replaced."""

    def run(batches):
        for batch in batches:
            counts, base, spans, clean = [[], [], [], []], [], [], []
            for chunk in chunks(batch.column(1)):
                for i, own in enumerate(scan_chunk(chunk, model, p)):
                    text = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]
                    points = _points(text, own) if own else []
                    for k in range(4):
                        counts[k].append(sum(kind == k for _, kind, _ in own))
                    base.append(hashlib.sha256(_joined([x for x in points if x[1] < 3]).encode()).hexdigest())
                    spans.append(_joined(points))
                    if mark is not None:
                        clean.append(redact(text.tobytes(), own, mark))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()),
                 pa.array(spans, pa.string()), pa.array(clean if mark is not None else [None] * len(batch), pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "clean_text"],
            )

    return run


def redact_bytes(text: bytes, spans, mark: bytes) -> bytes:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return b"".join([*out, text[at:]])


def redact(text: bytes, spans, mark: str) -> str:
    return redact_bytes(text, spans, mark.encode()).decode("utf-8", "replace")


_OUT = ("doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, "
        "clean_text string")


def scan_secrets(docs: DataFrame, model: SecretModel | None, id_col: str = "doc_id", text_col: str = "text",
                 mark: str | None = None, params: SecretParams = SecretParams()) -> DataFrame:
    """Spans of secrets of every row, and with ``mark`` the text with each replaced.

    Positions are code points, ends exclusive.  A null text is empty.  Without a model
    only the fixed patterns count.  What fixed spans cover is not listed again as
    random.  Null and repeated ids are rows like others.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scanned(model, params, mark), _OUT)


def _sampled(p: SecretParams):
    def run(batches):
        for batch in batches:
            secrets, words = set(), set()
            for chunk in chunks(batch.column(0)):
                data, at = chunk.data, chunk.offsets
                for i, own in enumerate(scan_chunk(chunk, None, p)):
                    text = data[at[i] : at[i + 1]].tobytes()
                    secrets.update(re.split(rb"[\"':= ]", text[s:e])[-1] for s, _, e in own)
                    words.update(_WORDS.findall(redact_bytes(text, own, b" ") if own else text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in (*secrets, *words)], pa.string()),
                 pa.array([True] * len(secrets) + [False] * len(words), pa.bool_())], ["value", "secret"])

    return run


def corpus_samples(docs: DataFrame, text_col: str = "text", params: SecretParams = SecretParams()) -> DataFrame:
    """Labelled strings of a corpus: values of fixed spans, and words of all texts outside them.

    Secrets that no fixed pattern finds are among the ordinary words; there are few of them.
    """
    spark = docs.sparkSession
    drawn = spark.createDataFrame([(v, True) for v in random_strings(2000)], "value string, secret boolean")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_sampled(params), "value string, secret boolean").unionByName(drawn)
