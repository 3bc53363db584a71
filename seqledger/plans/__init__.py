"""Registered queries over the derived tables."""

from . import (  # noqa: F401
    cleanup_queries,
    digest_queries,
    entity_queries,
    ingest_queries,
    modify_queries,
)
from .registry import OPERATORS, ORACLE, QUERIES  # noqa: F401
