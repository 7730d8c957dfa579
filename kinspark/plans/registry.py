"""Driver queries for the engine's operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinspark.plans import curating, exchange, files, geometry, identification, models, parsing

_ALL = identification.QUERIES | curating.QUERIES | geometry.QUERIES | parsing.QUERIES | exchange.QUERIES | files.QUERIES | models.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
