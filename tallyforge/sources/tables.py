"""Parquet tables of a warehouse folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table name of folder; only the columns that a plan uses are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
