"""Readers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view_prefix(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """The named tables as arguments of spark.sql, where {name} stands for a table."""
    return {n: table(spark, sf_dir, n) for n in names}
