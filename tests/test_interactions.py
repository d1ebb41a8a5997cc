from hypothesis import HealthCheck, given, settings as trials
from hypothesis import strategies as st

from tastemap.operators import interactions

from helpers import as_pairs, brute_interactions, day, frames


def check(spark, orders, lines):
    got = as_pairs(interactions(*frames(spark, orders, lines)))
    assert got == brute_interactions(orders, lines)
    return got


def test_sums_lines_over_orders(spark):
    orders = [(1, 10, day(0)), (2, 10, day(5)), (3, 11, day(3))]
    lines = [(1, 7, 2.0), (1, 7, 3.0), (2, 7, 1.0), (2, 8, 4.0), (3, 7, 6.0)]
    got = check(spark, orders, lines)
    assert got == {
        (10, 7): (3, 6.0, day(5)),
        (10, 8): (1, 4.0, day(5)),
        (11, 7): (1, 6.0, day(3)),
    }


def test_order_without_lines_and_user_without_history(spark):
    got = check(spark, [(1, 10, day(0)), (2, 11, day(0))], [(1, 7, 1.0)])
    assert set(got) == {(10, 7)}


def test_line_without_order_is_left_out(spark):
    assert check(spark, [(1, 10, day(0))], [(9, 7, 1.0)]) == {}


def test_null_keys_are_no_interaction(spark):
    orders = [(1, None, day(0)), (None, 10, day(0)), (3, 10, day(0))]
    lines = [(1, 7, 1.0), (None, 7, 1.0), (3, None, 1.0), (3, 8, 1.0)]
    assert set(check(spark, orders, lines)) == {(10, 8)}


def test_null_measures_keep_the_pair(spark):
    orders = [(1, 10, None), (2, 10, day(1)), (3, 11, None)]
    lines = [(1, 7, None), (2, 7, 2.0), (3, 7, None)]
    got = check(spark, orders, lines)
    assert got == {(10, 7): (2, 2.0, day(1)), (11, 7): (1, None, None)}


def test_empty_tables(spark):
    assert check(spark, [], []) == {}


keys = st.one_of(st.none(), st.integers(0, 4))
orders_of = st.lists(
    st.tuples(keys, keys, st.one_of(st.none(), st.integers(0, 9).map(day))), max_size=8
)
lines_of = st.lists(
    st.tuples(keys, keys, st.one_of(st.none(), st.integers(0, 50).map(float))),
    max_size=20,
)


@trials(
    max_examples=25,
    deadline=None,
    derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(orders=orders_of, lines=lines_of)
def test_any_tables(spark, orders, lines):
    check(spark, orders, lines)
