"""Parquet tables of one data directory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name``: one parquet file or a directory of them."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def register(spark: SparkSession, directory: str, names: Iterable[str]) -> None:
    """Temporary views of the tables, for SQL text that names them."""
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(name)
