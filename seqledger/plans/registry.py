"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.entities import Tables
from .views import PRELUDE, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


_built: dict[tuple[SparkSession, str], Tables] = {}


def _derived(spark: SparkSession, folder: str) -> Tables:
    """The derived tables as plans; building them once per folder saves planning time."""
    key = (spark, folder)
    if key not in _built:
        _built[key] = tables(spark, folder)
    return dict(_built[key])


def query(name: str, operators: str, sql: str | None = None):
    """Register a function of the derived tables under ``name``.

    ``operators`` names the inventory entries it covers; ``sql`` follows the common table
    expressions of the derived tables and may add its own, starting with a comma.
    """

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(_derived(spark, folder))
        OPERATORS[name] = operators
        if sql is not None:
            ORACLE[name] = PRELUDE + sql
        return build

    return register
