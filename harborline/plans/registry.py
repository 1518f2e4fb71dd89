"""Queries by name, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Tables = Callable[[str], DataFrame]


class Registry:
    """Collects plans; a plan gets a function from table names to DataFrames."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(plan: Callable[[Tables], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return plan(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            run.__name__, run.__doc__ = name, plan.__doc__
            self.queries[name] = run
            if sql is not None:
                self.oracle[name] = sql
            return plan

        return keep
