"""Parquet tables of the repository, one folder or file per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``, with the columns of the file; nothing is cached."""
    return spark.read.parquet(f"{root}/{name}.parquet")
