"""Every query of the engine's own operators: a callable and its DuckDB SQL.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) function under ``name``."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from loomtext.plans import aggregates, cleaning, corpus, relational, streams, strings, trees, vocabularies  # noqa: E402, F401
