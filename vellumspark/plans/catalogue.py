"""All queries of the core and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["text_queries", "layout_queries", "document_queries", "record_queries"]


def _modules():
    from importlib import import_module

    return [import_module(f"vellumspark.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.ORACLE
    return out
