"""Item popularity by distinct users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemap.functions import top_k


def item_popularity(pairs: DataFrame) -> DataFrame:
    """``users`` (distinct) and ``qty`` per item, from rows of a user and an item.

    Rows without a user or an item are left out; the quantities of repeated pairs
    are summed. The result of ``interactions`` is dealt out by user and item already,
    so its pairs are grouped where they are. Every task then combines its pairs to
    one row per item before the shuffle, and a hot item costs the receiving task one
    row per sending task.
    """
    users = (
        pairs.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
        .groupBy("user_id", "item_id")
        .agg(F.sum("qty").alias("qty"))
    )
    return users.groupBy("item_id").agg(
        F.count("*").alias("users"),
        F.sum("qty").alias("qty"),
    )


def popular_items(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` items with most users, ties by item, with their ``rank``."""
    return top_k(
        item_popularity(pairs), k, F.col("users").desc(), F.col("item_id").asc()
    )
