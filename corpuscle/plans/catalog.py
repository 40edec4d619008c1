"""Imports every module that registers queries and hands out the registry."""

from __future__ import annotations

from . import index_queries, join_queries, metrics_queries, retrieval_queries, segment_queries, serving_queries, source_queries, streaming_queries, text_queries, workflow  # noqa: F401
from .registry import REGISTRY, Query


def queries() -> dict[str, Query]:
    return REGISTRY.queries


def oracle_sql() -> dict[str, str]:
    return REGISTRY.sql
