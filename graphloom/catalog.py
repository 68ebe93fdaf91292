"""Registered queries over the driver's tables, each with its SQL twin.

``queries()`` and ``oracle_sql()`` collect what the modules of ``plans/`` register.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import graph_queries, retrieval_queries, stream_queries, text_queries

_MODULES = (graph_queries, text_queries, retrieval_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
