"""Collects the queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Core modules with ``queries()`` and ``oracle_sql()``.
MODULES: tuple[str, ...] = ("tesela.plans.retrieval", "tesela.plans.storage")


def collect(modules: tuple[str, ...] = MODULES) -> tuple[dict[str, Query], dict[str, str]]:
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in modules:
        module = importlib.import_module(name)
        found |= module.queries()
        sql |= module.oracle_sql()
    return found, sql
