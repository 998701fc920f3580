"""Registry of queries and their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under the name, with its DuckDB twin."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
