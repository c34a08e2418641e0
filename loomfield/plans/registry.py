"""Query registry: name -> (spark, sf_dir) callable, and the DuckDB statement it must equal."""

from __future__ import annotations

import os
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _workers_find_package(spark) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle where SQL can state it."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: (_workers_find_package(spark), fn(spark, sf_dir))[1]
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _load() -> None:
    """Import the modules that register queries."""
    from loomfield.plans import corpus_queries, log_queries, text_queries  # noqa: F401


_load()
