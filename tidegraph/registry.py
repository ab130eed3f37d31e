"""Queries by name, each with the SQL that says what its rows are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """A named set of queries and their oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register a function (spark, sf_dir) -> DataFrame under its own name, with its oracle where SQL has one."""

        def add(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"two queries are named {key}")
            self.queries[key] = f
            if oracle is not None:
                self.oracles[key] = oracle
            return f

        return add

    def sql(self, name: str, tables: list[str], spark_sql: str, oracle: str | None = None) -> None:
        """Register a query written in SQL over views of the named tables; the oracle is the same text unless given."""
        from tidegraph.io import view_prefix

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(spark_sql, **view_prefix(spark, sf_dir, tables))

        run.__name__ = name
        self.query(oracle, name)(run)
