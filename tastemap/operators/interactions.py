"""Implicit feedback: which user bought which item, and how much."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interactions(orders: DataFrame, lineitem: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per user and item with ``n``, ``qty`` and ``last_date``.

    ``n`` counts order lines, ``qty`` sums their quantity, ``last_date`` is the
    date of the latest order. Lines without an order, a customer or a part are
    no interaction and are left out.

    Shuffles: both tables on the order key, unless they are bucketed on it or
    the orders are small enough for Spark to broadcast; then the joined lines
    on (user, item), combined per task beforehand. A hot user spreads over its
    items, a hot item over its users, a hot pair is one row per task.

    With ``parts`` the joined lines are dealt out to so many tasks, before they are
    combined. Pairs compress so well that adaptive execution, which merges partitions
    by their bytes, puts many millions into one task, whose hash tables then take
    gigabytes; it leaves a given number alone. The price is a hot pair: one task reads
    all its lines, in the memory of one row.

    A hot order is split by the adaptive skew join, but only where there is a
    shuffle, and no finer than the tasks that wrote it:

    * Tables bucketed on the order key join without one, so a hot order is one
      task. ``spark.sql.sources.bucketing.enabled=false`` restores the shuffle.
    * Rows that one map task wrote stay together. A map task reads at least a row
      group, so the order of a file of one row group is not split. Row groups and
      scan splits (``spark.sql.files.maxPartitionBytes``) have to be small beside
      the hot order; a larger row group is bounded by its own size.
    """
    bought = orders.where(F.col("o_custkey").isNotNull()).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("order_date"),
    )
    lines = lineitem.where(F.col("l_partkey").isNotNull()).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").alias("quantity"),
    )
    joined = lines.join(bought, "order_id")
    if parts is not None:
        joined = joined.repartition(parts, "user_id", "item_id")
    return (
        joined.groupBy("user_id", "item_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("quantity").alias("qty"),
            F.max("order_date").alias("last_date"),
        )
    )
