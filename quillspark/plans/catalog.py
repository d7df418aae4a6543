"""Queries of the library and the SQL that DuckDB runs for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compare_queries, job_queries, row_queries, source_queries, stream_queries, text_queries

_MODULES = (text_queries, row_queries, compare_queries, source_queries, job_queries, stream_queries)


def _all() -> dict[str, tuple]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _all().items() if v[1]}
