import pytest
from hypothesis import HealthCheck, given, settings as trials
from hypothesis import strategies as st

from tastemap.operators import item_popularity, popular_items

from helpers import as_top, brute_top

PAIRS = "user_id long, item_id long, qty double"


def frame(spark, pairs):
    rows = [(user, item, qty) for (user, item), (_, qty, _) in pairs.items()]
    return spark.createDataFrame(rows, PAIRS)


def make(*rows):
    return {(user, item): (1, qty, None) for user, item, qty in rows}


def check(spark, pairs, k):
    got = as_top(popular_items(frame(spark, pairs), k))
    assert got == brute_top(pairs, k)
    return got


def test_counts_users_not_quantity(spark):
    pairs = make((1, 5, 100.0), (1, 6, 1.0), (2, 6, 1.0))
    assert check(spark, pairs, 2) == [(6, 2, 2.0, 1), (5, 1, 100.0, 2)]


def test_ties_go_to_the_smaller_item(spark):
    pairs = make((1, 9, 1.0), (2, 3, 1.0), (3, 5, 1.0), (4, 3, 1.0), (5, 5, 1.0))
    assert [row[0] for row in check(spark, pairs, 3)] == [3, 5, 9]
    assert [row[0] for row in check(spark, pairs, 1)] == [3]


def test_fewer_items_than_k(spark):
    assert len(check(spark, make((1, 5, 1.0)), 10)) == 1


def test_no_pairs(spark):
    assert check(spark, {}, 3) == []


def test_repeated_pairs_are_one_user(spark):
    rows = [(1, 5, 1.0), (1, 5, 2.0), (1, 5, None), (2, 6, 1.0), (3, 6, 1.0)]
    got = as_top(popular_items(spark.createDataFrame(rows, PAIRS), 2))
    assert got == [(6, 2, 2.0, 1), (5, 1, 3.0, 2)]


def test_null_ids_are_no_user_and_no_item(spark):
    rows = [(None, 5, 1.0), (None, 5, 1.0), (1, 6, 1.0), (2, None, 9.0), (None, None, 1.0)]
    got = as_top(popular_items(spark.createDataFrame(rows, PAIRS), 5))
    assert got == [(6, 1, 1.0, 1)]


def test_null_quantities_keep_the_user(spark):
    rows = [(1, 5, None), (2, 5, None), (3, 6, 1.0)]
    got = as_top(popular_items(spark.createDataFrame(rows, PAIRS), 5))
    assert got == [(5, 2, None, 1), (6, 1, 1.0, 2)]


def test_k_has_to_be_positive(spark):
    with pytest.raises(ValueError):
        popular_items(frame(spark, make((1, 5, 1.0))), 0)


def test_popularity_keeps_every_item(spark):
    pairs = make(*[(user, user % 37, 1.0) for user in range(500)])
    rows = item_popularity(frame(spark, pairs)).collect()
    assert len(rows) == 37
    assert sum(row.users for row in rows) == 500


@trials(
    max_examples=20,
    deadline=None,
    derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    rows=st.lists(
        st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 50).map(float)),
        max_size=40,
    ),
    k=st.integers(1, 9),
)
def test_any_pairs(spark, rows, k):
    check(spark, make(*rows), k)
