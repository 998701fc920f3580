"""URL filter: allow and block rules first, gradient-boosted trees for the rest.

The trees look at lexical features of a URL (lengths, depth, digit ratio, entropy,
parameters, labels) and at how often its host suffixes were blocked among all labelled
URLs.  Suffix statistics are grouped counts over ``BUCKETS`` hash buckets, so their
table has a fixed size; the trees are fitted on a bounded sample of labelled rows and
score in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.skew import hash_sample

BUCKETS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "query_length",
    "labels", "longest_label", "hyphens", "host_digits", "suffix1_rate", "suffix2_rate", "suffix1_seen", "suffix2_seen",
)


@dataclass(frozen=True)
class UrlParams:
    """``sample_rows`` bounds the labelled URLs the trees are fitted on, taken by hash of the URL."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    block_at: float = 0.5
    sample_rows: int = 20_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str  # host, then the path's beginning

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


@dataclass(frozen=True)
class UrlModel:
    trees: list
    prior: float
    suffix: np.ndarray  # BUCKETS x 2: blocked, all
    rate: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.prior)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            margin += self.rate * leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits, or nulls; of equal lengths the first given."""
    pattern = verdict = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        pattern = F.when(fits, F.lit(rule.pattern)).otherwise(pattern)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return pattern, verdict


def _suffix(host: Column, labels: int) -> Column:
    """Hash bucket of the host's last labels."""
    last = F.substring_index(host, ".", -labels)
    return F.pmod(F.xxhash64(F.lit(labels), last), F.lit(BUCKETS)).cast("int")


def lexical(urls: list[str | None], hosts: list[str]) -> np.ndarray:
    """The features of URLs that need no statistics."""
    out = np.zeros((len(urls), 12))
    for i, (url, host) in enumerate(zip(urls, hosts, strict=True)):
        url = url or ""
        raw = np.frombuffer(url.encode("utf-8", "replace"), dtype=np.uint8)
        if not len(raw):
            continue
        share = np.bincount(raw)
        share = share[share > 0] / len(raw)
        tail = url.split("://", 1)[-1][len(host) :]
        path, _, query = tail.split("#", 1)[0].partition("?")
        labels = host.split(".")
        out[i] = (
            len(url), len(host), len(path), sum(1 for s in path.split("/") if s), ((raw >= 48) & (raw < 58)).mean(),
            -(share * np.log2(share)).sum(), query.count("&") + 1 if query else 0, len(query), len(labels),
            max(map(len, labels)), host.count("-"), sum(c.isdigit() for c in host),
        )
    return out


def _matrix(batch, suffix: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Features of URLs; ``own`` are the labels of rows that the statistics count, which are left out for them."""
    x = lexical(batch.column("url").to_pylist(), batch.column("host").to_pylist())
    extra = []
    for name in ("suffix1", "suffix2"):
        n = suffix[np.asarray(batch.column(name))]
        if own is not None:
            n = n - np.column_stack([own, np.ones(len(own))])
        extra += [(n[:, 0] + 1) / (n[:, 1] + 2), n[:, 1] > 0]
    return np.column_stack([x, extra[0], extra[2], extra[1], extra[3]]) if len(x) else np.zeros((0, len(FEATURES)))


def grow(x: np.ndarray, y: np.ndarray, p: UrlParams) -> tuple[list, float]:
    """Boosted trees on the logistic loss: histogram splits, full binary trees of fixed depth."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, p.bins) / p.bins)) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    margin, trees = np.full(len(y), prior), []
    inner = 2**p.depth - 1
    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = y - q, q * (1 - q)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            best = (1e-9, 0, None)
            if len(mine):
                g, h = grad[mine], hess[mine]
                base = g.sum() ** 2 / (h.sum() + p.ridge)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[mine, f], g, len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[mine, f], h, len(c) + 1))[:-1]
                    gain = gl**2 / (hl + p.ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + p.ridge) - base
                    top = int(np.argmax(gain))
                    if gain[top] > best[0]:
                        best = (gain[top], f, c[top])
            if best[2] is not None:
                feature[k], cut[k] = best[1], best[2]
            node[mine] = 2 * k + 1 + (x[mine, feature[k]] > cut[k])
        at = node - inner
        leaf = np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + p.ridge)
        margin += p.rate * leaf[at]
        trees.append((feature, cut, leaf))
    return trees, prior


def fit_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "verdict",
             params: UrlParams = UrlParams()) -> UrlModel | None:
    """The model, from URLs labelled allow or block; None unless both occur.

    Suffix statistics count every labelled row; for a row that is learned from, all but itself,
    else they would tell it its own label where a host is rare.  Trees are grown on at most
    ``sample_rows`` rows, chosen by the hash of the URL.  Other labels and null URLs are left out.
    """
    host, _ = host_path(F.col(url_col))
    rows = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).alias("label")).where(
        "url is not null and label in ('allow', 'block')"
    ).select("url", host.alias("host"), (F.col("label") == "block").cast("int").alias("y"))
    rows = rows.select("*", _suffix(F.col("host"), 1).alias("suffix1"), _suffix(F.col("host"), 2).alias("suffix2"))
    suffix = np.zeros((BUCKETS, 2))
    both = rows.select(F.explode(F.array("suffix1", "suffix2")).alias("bucket"), "y")
    for r in both.groupBy("bucket").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect():
        suffix[r["bucket"]] = (r["y"], r["n"])
    sample = hash_sample(rows.select("url", "host", "y", "suffix1", "suffix2"), ["url", "y"], params.sample_rows)
    # one order, whatever the layout; at most sample_rows rows
    picked = sample.toArrow().sort_by([("url", "ascending"), ("y", "ascending")])
    y = picked.column("y").to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return None
    trees, prior = grow(_matrix(picked, suffix, y), y, params)
    return UrlModel(trees, prior, suffix, params.rate)


def _judged(model: UrlModel | None, block_at: float):
    def run(batches):
        for batch in batches:
            p = model.probability(_matrix(batch, model.suffix)) if model else np.zeros(len(batch))
            verdict = [given or ("block" if q >= block_at else "allow")
                       for given, q in zip(batch.column("given").to_pylist(), p, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), batch.column("rule"),
                 pa.array(verdict, pa.string()), pa.array(p, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "block_probability"],
            )

    return run


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel | None, id_col: str = "page_id",
                url_col: str = "url", params: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability of every row.

    The longest rule that fits decides, else the model; without a model such URLs are
    allowed.  A null URL has an empty host and path.  Null and repeated ids are rows
    like others.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"))
    host, path = host_path(F.col("url"))
    rows = rows.select("*", host.alias("host"), path.alias("path"))
    pattern, given = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(
        "*", pattern.alias("rule"), given.alias("given"),
        _suffix(F.col("host"), 1).alias("suffix1"), _suffix(F.col("host"), 2).alias("suffix2"),
    )
    return rows.mapInArrow(
        _judged(model, params.block_at),
        "page_id long, host string, path string, rule string, verdict string, block_probability double",
    )
