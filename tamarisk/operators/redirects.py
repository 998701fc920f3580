"""Redirect chains of shortened URLs over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.operators.lineage import written
from tamarisk.params import RiskParams

#: hops that are planned at once; after them the paths are written and those still open counted
HOPS_AT_ONCE = 10


def _follow(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop of every open path; a URL that the path has seen already closes it as a cycle."""
    # a closed path asks for a key of its own that no edge has, so closed paths meet in no task
    probe = F.expr("CASE WHEN open THEN element_at(path, -1) ELSE concat('\\0', src) END = _from")
    return paths.join(edges, probe, "left").selectExpr(
        "src", "CASE WHEN _to IS NULL OR array_contains(path, _to) THEN path ELSE concat(path, array(_to)) END AS path",
        "_to IS NOT NULL AND NOT array_contains(path, _to) AS open",
        "cycle OR coalesce(array_contains(path, _to), false) AS cycle",
    )


def expand_urls(
    urls: DataFrame, redirects: DataFrame, params: RiskParams = RiskParams()
) -> DataFrame:
    """Expansion record of every distinct ``url``; ``redirects`` is ``src, dst``.

    Only the asked URLs travel: each hop joins the ends of the paths that are still open with
    the edges, which never meet each other.  A path ends where no edge leaves, where it comes
    back to a URL of its own, or one hop beyond ``max_redirects``; the last two are "too many
    redirects".  Of several targets of a URL the smallest is taken.  Up to HOPS_AT_ONCE hops
    are one plan; for more, the paths so far are written to the shared folder and the work
    stops as soon as none is open.
    """
    edges = (
        redirects.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
        .groupBy(F.col("src").alias("_from")).agg(F.min("dst").alias("_to"))
    )
    asked = urls.select(F.coalesce("url", F.lit("")).alias("src")).distinct()
    paths = asked.select("src", F.array("src").alias("path"), F.lit(True).alias("open"), F.lit(False).alias("cycle"))
    for hop in range(params.max_redirects + 1):
        if hop and hop % HOPS_AT_ONCE == 0:
            paths = written(paths, "paths")
            if paths.filter("open").isEmpty():
                break
        paths = _follow(paths, edges)
    return paths.select(*_expansion(F.col("src"), F.col("path"), F.col("cycle"), params.max_redirects))


def _expansion(url: Column, path: Column, cycle: Column, limit: int) -> list[Column]:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    error = (
        F.when(url == "", "empty url")
        .when(~scheme.isin("http", "https"), F.concat(F.lit("unsupported scheme: "), scheme))
        .when(cycle | (F.size(path) > limit + 1), "too many redirects")
    )
    fine = error.isNull()
    hops = F.size(path) - 1
    return [
        url.alias("original_url"),
        F.when(fine, F.element_at(path, -1)).alias("final_url"),
        F.when(fine, path).otherwise(F.array().cast("array<string>")).alias("redirect_chain"),
        F.when(fine, hops).otherwise(0).cast("int").alias("redirect_count"),
        (fine & (hops > 0)).alias("expanded"),
        error.alias("error"),
    ]
