"""All queries for the knowledge-base operators, with the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import composed, connector, conversation, extras, search, store, texts

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (composed, connector, conversation, extras, search, store, texts)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
