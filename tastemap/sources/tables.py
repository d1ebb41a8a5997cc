"""Reading the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table ``name`` under ``directory``, a single file or a folder of parts."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
