"""All reference queries with their oracles; modules add theirs with ``query``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with oracle SQL if there is any."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} exists")
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add
