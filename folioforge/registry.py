"""All registered queries of the document engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.plans import chunks, facts, layouts, steps, streams

ALL = chunks.QUERIES | facts.QUERIES | layouts.QUERIES | steps.QUERIES | streams.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
