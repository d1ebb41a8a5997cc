"""The registered queries, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tastemap.operators import interactions, popular_items
from tastemap.sources import table

TOP_K = 20


#: Lines that a task groups, about, where there are more of them than tasks at once.
TASK_LINES = 500_000


def parts(lineitem: DataFrame) -> int | None:
    """Tasks to deal the joined lines to; none while a share for each core is small
    enough. Counting reads the footers only."""
    count, cores = lineitem.count(), lineitem.sparkSession.sparkContext.defaultParallelism
    return -(-count // TASK_LINES) if count > cores * TASK_LINES else None


def user_item_interactions(spark: SparkSession, directory: str) -> DataFrame:
    lineitem = table(spark, directory, "lineitem")
    return interactions(table(spark, directory, "orders"), lineitem, parts(lineitem))


def top_items(spark: SparkSession, directory: str) -> DataFrame:
    return popular_items(user_item_interactions(spark, directory), TOP_K)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "user_item_interactions": user_item_interactions,
    "top_items": top_items,
}

ORACLE_SQL: dict[str, str] = {
    "user_item_interactions": """
        SELECT o_custkey AS user_id,
               l_partkey AS item_id,
               count(*) AS n,
               sum(l_quantity) AS qty,
               max(o_orderdate) AS last_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_custkey IS NOT NULL AND l_partkey IS NOT NULL
        GROUP BY o_custkey, l_partkey
    """,
    "top_items": f"""
        WITH popularity AS (
            SELECT l_partkey AS item_id,
                   count(DISTINCT o_custkey) AS users,
                   sum(l_quantity) AS qty
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            WHERE o_custkey IS NOT NULL AND l_partkey IS NOT NULL
            GROUP BY l_partkey
        ), ranked AS (
            SELECT item_id, users, qty,
                   CAST(row_number() OVER (ORDER BY users DESC, item_id)
                        AS INTEGER) AS rank
            FROM popularity
        )
        SELECT item_id, users, qty, rank FROM ranked WHERE rank <= {TOP_K}
    """,
}
