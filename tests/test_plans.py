"""The shape of the plans: what is read, what moves, how skew is met."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from tastemap.functions import top_k
from tastemap.operators import interactions, popular_items
from tastemap.plans import QUERIES, registered
from tastemap.session import TASK_BYTES, cluster_settings
from tastemap.tasks import recorded

from helpers import (
    as_pairs,
    as_top,
    brute_interactions,
    brute_top,
    day,
    formatted,
    frames,
    plan,
)

SF = "/root/testdata/sf0.001"
NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1"}


def read_columns(df):
    return [
        set(re.findall(r"(\w+):", schema))
        for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", formatted(df))
    ]


def test_interactions_read_only_their_columns(spark):
    assert read_columns(QUERIES["user_item_interactions"](spark, SF)) == [
        {"l_orderkey", "l_partkey", "l_quantity"},
        {"o_orderkey", "o_custkey", "o_orderdate"},
    ]


def test_top_items_do_not_read_the_date(spark):
    assert read_columns(QUERIES["top_items"](spark, SF)) == [
        {"l_orderkey", "l_partkey", "l_quantity"},
        {"o_orderkey", "o_custkey"},
    ]


def test_null_keys_are_dropped_in_the_scan(spark):
    text = formatted(QUERIES["top_items"](spark, SF))
    assert "IsNotNull(o_custkey)" in text and "IsNotNull(l_partkey)" in text


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for operator in ("Python", "Arrow", "CartesianProduct", "NestedLoop"):
        assert operator not in text


def test_no_broadcast_above_the_threshold(spark, settings):
    settings(**NO_BROADCAST)
    text = plan(QUERIES["user_item_interactions"](spark, SF))
    assert "Broadcast" not in text
    assert text.count("Exchange hashpartitioning") == 3


def test_every_aggregation_combines_before_its_shuffle(spark, settings):
    settings(**NO_BROADCAST)
    lines = [line.strip(" :+-") for line in plan(QUERIES["top_items"](spark, SF)).splitlines()]
    moves = [i for i, line in enumerate(lines) if line.startswith("Exchange")]
    combining = [i for i in moves if "partial_" in lines[i + 1]]
    # The pairs that popularity groups anew need no further shuffle.
    assert len(moves) == 4 and len(combining) == 2
    partial = [line for line in lines if "Aggregate" in line and "partial_" in line]
    assert len(partial) == 3


def test_top_k_sorts_nothing_globally(spark):
    text = plan(top_k(spark.range(100), 3, F.col("id").desc()))
    assert "TakeOrderedAndProject(limit=3" in text
    assert "rangepartitioning" not in text


def test_bucketed_tables_join_without_a_shuffle(spark, settings):
    settings(**NO_BROADCAST)
    orders, lines = frames(
        spark,
        [(i, i % 5, day(i)) for i in range(40)],
        [(i % 40, i % 7, 1.0) for i in range(200)],
    )
    try:
        orders.write.bucketBy(4, "o_orderkey").sortBy("o_orderkey").saveAsTable("b_orders")
        lines.write.bucketBy(4, "l_orderkey").sortBy("l_orderkey").saveAsTable("b_lines")
        df = interactions(spark.table("b_orders"), spark.table("b_lines"))
        assert plan(df).count("Exchange hashpartitioning") == 1
        assert as_pairs(df) == as_pairs(interactions(orders, lines))
    finally:
        spark.sql("DROP TABLE IF EXISTS b_orders")
        spark.sql("DROP TABLE IF EXISTS b_lines")


def skewed():
    """A third of the lines in one order, a third on one item, one busy user."""
    orders = [(i, 1 if i % 3 else i, day(i % 50)) for i in range(300)]
    lines = [(0, i % 40, 1.0) for i in range(3000)]
    lines += [(i % 300, 3, 2.0) for i in range(3000)]
    lines += [(i % 300, i % 97, 3.0) for i in range(3000)]
    return orders, lines


SMALL_SKEW = {
    **NO_BROADCAST,
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "1b",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "4k",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
    "spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold": "0",
    "spark__sql__shuffle__partitions": "16",
}
SPLIT = "SortMergeJoin(skew=true)"


def test_hot_order_of_bucketed_tables_needs_their_shuffle(spark, settings):
    settings(**SMALL_SKEW, spark__sql__files__maxPartitionBytes="4k", spark__sql__files__openCostInBytes="1")
    orders, lines = skewed()
    order_rows, line_rows = frames(spark, orders, lines)
    expected = brute_interactions(orders, lines)
    try:
        # Several files in a bucket, as several tasks write them.
        order_rows.repartition(4).write.bucketBy(4, "o_orderkey").saveAsTable("h_orders")
        line_rows.repartition(8).write.bucketBy(4, "l_orderkey").saveAsTable("h_lines")
        kept = interactions(spark.table("h_orders"), spark.table("h_lines"))
        assert as_pairs(kept) == expected
        assert "skew=true" not in plan(kept)
        settings(spark__sql__sources__bucketing__enabled="false")
        moved = interactions(spark.table("h_orders"), spark.table("h_lines"))
        assert as_pairs(moved) == expected
        assert SPLIT in plan(moved)
    finally:
        spark.sql("DROP TABLE IF EXISTS h_orders")
        spark.sql("DROP TABLE IF EXISTS h_lines")


def test_hot_order_is_split_no_finer_than_row_groups(spark, settings, tmp_path):
    settings(**SMALL_SKEW, spark__sql__files__maxPartitionBytes="4k", spark__sql__files__openCostInBytes="1")
    orders, lines = skewed()
    lines = random.Random(1).sample(lines * 3, 3 * len(lines))
    order_rows, _ = frames(spark, orders, [])
    names = ("l_orderkey", "l_partkey", "l_quantity")
    table = pa.table(dict(zip(names, map(list, zip(*lines)))))
    expected = brute_interactions(orders, lines)
    for groups, split in ((1, False), (30, True)):
        path = str(tmp_path / f"{groups}.parquet")
        pq.write_table(table, path, row_group_size=len(lines) // groups)
        assert pq.ParquetFile(path).num_row_groups == groups
        df = interactions(order_rows, spark.read.parquet(path))
        assert as_pairs(df) == expected
        assert (SPLIT in plan(df)) == split


@pytest.mark.parametrize("partitions", [4, 64])
def test_cluster_settings_deal_out_the_pairs(spark, settings, partitions):
    chosen = cluster_settings(partitions * TASK_BYTES)
    assert chosen["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == str(partitions)
    settings(**NO_BROADCAST, **{name.replace(".", "__"): value for name, value in chosen.items()})
    orders, lines = skewed()
    df = interactions(*frames(spark, orders, lines))
    assert as_pairs(df) == brute_interactions(orders, lines)
    assert re.search(rf"hashpartitioning\(user_id#\d+L, item_id#\d+L, {partitions}\)", plan(df))


def test_cluster_settings_change_the_plan_only():
    chosen = cluster_settings(0, bucketed=False)
    assert all(name.startswith("spark.sql.") for name in chosen)
    assert chosen["spark.sql.sources.bucketing.enabled"] == "false"
    with pytest.raises(ValueError):
        cluster_settings(-1)


def test_hot_order_is_split_and_the_result_is_whole(spark, settings):
    settings(**SMALL_SKEW)
    orders, lines = skewed()
    order_rows, line_rows = frames(spark, orders, lines)
    df = interactions(order_rows, line_rows.repartition(8))
    got = as_pairs(df)
    assert "SortMergeJoin(skew=true)" in plan(df)
    assert got == brute_interactions(orders, lines)


def test_skewed_tables_give_the_whole_ranking(spark, settings):
    settings(**NO_BROADCAST)
    orders, lines = skewed()
    expected = brute_top(brute_interactions(orders, lines), 5)
    df = popular_items(interactions(*frames(spark, orders, lines)), 5)
    assert as_top(df) == expected


@pytest.mark.parametrize("name", QUERIES)
def test_pairs_of_a_task_are_bounded(spark, settings, monkeypatch, name):
    """Compressed bytes do not merge the pairs of large tables into a few tasks."""
    settings(**NO_BROADCAST)
    expected = sorted(map(str, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(registered, "TASK_LINES", 300, raising=False)
    rows = []
    stages = recorded(spark, lambda: rows.extend(QUERIES[name](spark, SF).collect()))
    assert sorted(map(str, rows)) == expected
    dealt = [s for s in stages if s.tasks == 20]
    assert dealt and max(s.largest_shuffle for s in dealt) < 2 * 300
