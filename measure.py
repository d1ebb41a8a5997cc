"""Measures the queries on many copies of the tables, evenly dealt and skewed.

    python measure.py OUT [--copies N] [--runs N] [--cpus N] [--memory 8g]

writes ``OUT/even`` and ``OUT/skewed`` unless they are there, and prints a table in
Markdown: median (least to most) seconds of each query, and the rows of the largest
task behind a shuffle. Keys of each copy are shifted. "Skewed" moves a third of the
lines to one order and another third to one part.
"""

from __future__ import annotations

import argparse
import statistics
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.plans import QUERIES
from tastemap.session import build
from tastemap.sources import table
from tastemap.tasks import recorded

THRESHOLD = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"


def copies(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` copies with their keys shifted past each other."""
    top = df.agg(*(F.max(k).alias(k) for k in keys)).first()
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for k in keys:
        many = many.withColumn(k, F.col(k) + F.col("copy") * F.lit(top[k] + 1))
    return many.drop("copy")


def generate(spark: SparkSession, source: str, out: Path, n: int) -> None:
    orders = copies(table(spark, source, "orders"), n, "o_orderkey", "o_custkey")
    lines = copies(table(spark, source, "lineitem"), n, "l_orderkey", "l_partkey")
    third = F.pmod(F.xxhash64(*lines.columns), F.lit(3))
    skewed = lines.withColumns({
        "l_orderkey": F.when(third == 0, F.lit(0)).otherwise(F.col("l_orderkey")),
        "l_partkey": F.when(third == 1, F.lit(0)).otherwise(F.col("l_partkey")),
    })
    for name, rows in (("even", lines), ("skewed", skewed)):
        if not (out / name).exists():
            orders.repartition(16).write.parquet(f"{out}/{name}/orders.parquet")
            rows.repartition(64).write.parquet(f"{out}/{name}/lineitem.parquet")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("out", type=Path)
    parser.add_argument("--copies", type=int, default=100)
    parser.add_argument("--runs", type=int, default=5)
    parser.add_argument("--cpus", default="8")
    parser.add_argument("--memory", default="8g")
    parser.add_argument("--source", default="/root/testdata/sf0.1")
    args = parser.parse_args()
    spark = build(args.cpus, app="tastemap-measure", **{"spark.driver.memory": args.memory})
    spark.sparkContext.setLogLevel("ERROR")
    generate(spark, args.source, args.out, args.copies)

    cases = [("even", "64m"), ("skewed", "64m"), ("skewed", "256m")]
    times: dict[tuple, list[float]] = {}
    rows: dict[tuple, int] = {}
    for turn in range(args.runs + 1):  # interleaved; the first warms up
        for case in cases:
            spark.conf.set(THRESHOLD, case[1])
            for name, query in QUERIES.items():
                def work(query=query, case=case):
                    query(spark, str(args.out / case[0])).write.format("noop").mode("overwrite").save()

                start = time.perf_counter()
                stages = recorded(spark, work)
                if turn:
                    times.setdefault((name, case), []).append(time.perf_counter() - start)
                    largest = max((s.largest_shuffle for s in stages), default=0)
                    rows[name, case] = max(largest, rows.get((name, case), 0))
    spark.stop()
    print("| | " + " | ".join(f"{kind}, {threshold}" for kind, threshold in cases) + " |")
    print("| --- |" + " --- |" * len(cases))
    for name in QUERIES:
        spread = [times[name, case] for case in cases]
        cells = [f"{statistics.median(t):.1f} s ({min(t):.1f} to {max(t):.1f})" for t in spread]
        print(f"| `{name}` | " + " | ".join(cells) + " |")
        print(f"| most rows in one task of `{name}` | " + " | ".join(f"{rows[name, c]:,}" for c in cases) + " |")


if __name__ == "__main__":
    main()
