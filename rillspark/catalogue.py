"""Every query by name, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillspark.plans import retrieval, structure, updates
from rillspark.session import workers_find_us

ALL = structure.QUERIES | retrieval.QUERIES | updates.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_find_us(spark)
            return fn(spark, sf_dir)

        return run

    return {name: ready(fn) for name, (fn, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
