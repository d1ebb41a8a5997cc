from pyspark.sql import functions as F

from tastemap.functions import top_k


def test_equal_rows_get_different_numbers(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (0,)], "v long")
    got = top_k(df, 3, F.col("v").desc(), rank="place").collect()
    assert sorted((row.v, row.place) for row in got) == [(1, 1), (1, 2), (1, 3)]
