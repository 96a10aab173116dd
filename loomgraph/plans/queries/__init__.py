"""The registered queries, one module per operator family."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = ["canonical", "analytics", "checks", "progress", "reporting", "sources", "python_source", "other_languages", "study"]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        found.update(import_module(f"{__name__}.{family}").QUERIES)
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found.update(import_module(f"{__name__}.{family}").SQL)
    return found
