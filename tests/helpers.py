"""Small tables and the same answers worked out row by row in Python."""

from collections import defaultdict
from datetime import datetime, timedelta

ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"
LINES = "l_orderkey long, l_partkey long, l_quantity double"
DAY0 = datetime(2000, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


def frames(spark, orders, lines):
    return spark.createDataFrame(orders, ORDERS), spark.createDataFrame(lines, LINES)


def brute_interactions(orders, lines):
    """{(user, item): (n, qty, last date)}"""
    found = defaultdict(list)
    for line_order, item, qty in lines:
        for order, user, date in orders:
            if order is None or line_order != order or user is None or item is None:
                continue
            found[user, item].append((qty, date))
    result = {}
    for pair, bought in found.items():
        quantities = [q for q, _ in bought if q is not None]
        dates = [d for _, d in bought if d is not None]
        result[pair] = (
            len(bought),
            sum(quantities) if quantities else None,
            max(dates, default=None),
        )
    return result


def brute_top(pairs, k):
    """[(item, users, qty, rank)]"""
    users, totals = defaultdict(set), defaultdict(list)
    for (user, item), (_, qty, _) in pairs.items():
        users[item].add(user)
        if qty is not None:
            totals[item].append(qty)
    ordered = sorted(users, key=lambda item: (-len(users[item]), item))
    return [
        (item, len(users[item]), sum(totals[item]) if totals[item] else None, rank)
        for rank, item in enumerate(ordered[:k], 1)
    ]


def as_pairs(df):
    rows = df.collect()
    result = {(r.user_id, r.item_id): (r.n, r.qty, r.last_date) for r in rows}
    assert len(result) == len(rows), "more than one row for a user and item"
    return result


def as_top(df):
    rows = [(r.item_id, r.users, r.qty, r["rank"]) for r in df.collect()]
    return sorted(rows, key=lambda row: row[3])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    """The plan with scan details, as ``explain("formatted")`` prints it."""
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)
