"""All queries and oracles of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.plans import item_queries, request_queries, search_queries, store_queries, text_queries, training_queries

GROUPS = [text_queries, item_queries, search_queries, request_queries, store_queries, training_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in GROUPS for name, query in group.queries().items()}


def oracles() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.oracles().items()}
