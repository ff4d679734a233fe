"""Queries outside llm by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hushframe.plans import queries_admission, queries_logs, queries_pages, queries_requests, queries_streams, queries_text

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (queries_text, queries_admission, queries_requests, queries_logs, queries_pages, queries_streams)


def queries() -> dict[str, Query]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
