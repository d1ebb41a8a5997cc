"""Ranking helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of ``df`` in ``order``, numbered from 1.

    ``order`` has to end with a unique column, or ties at the cut are arbitrary.

    Every task keeps only its own best ``k`` rows, so at most ``k`` rows per
    input partition move. The window without partitions sees the ``k`` winners.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    return (
        df.orderBy(*order)
        .limit(k)
        .withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    )
