"""All queries of the relational face, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import cells, diffs, history

Query = Callable[[SparkSession, str], DataFrame]
_ALL = diffs.QUERIES | cells.QUERIES | history.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.diff_counts(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
