"""Named queries over the driver tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import change, code, forms, lines

MODULES = [lines, code, change, forms]


def _all() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["exact_clusters_k5"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
