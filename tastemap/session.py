"""Session settings: those of a cluster, and a local session for tests and bench.

On a cluster the session comes from the cluster; nothing in the library changes
its settings. ``cluster_settings`` offers those that matter, to be set where the
session is made.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Shuffled bytes of a task that fit beside its hash tables.
TASK_BYTES = 128 << 20

#: Plan settings, the same on a cluster and in tests.
PLAN = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits a join partition that one hot order key has made too large. Rows of
    # one key compress well, so the default of 256 MB lets 20 million through.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
}

SETTINGS = {
    **PLAN,
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_settings(shuffled_bytes: int, bucketed: bool = True) -> dict[str, str]:
    """Settings for a job that is expected to shuffle so many bytes at once.

    They change the plan, never the rows. Adaptive execution merges partitions but
    does not split those of an aggregation, so it has to start with enough. With
    ``bucketed`` false, tables bucketed on the order key are shuffled all the same,
    which lets a hot order be split.
    """
    if shuffled_bytes < 0:
        raise ValueError(f"shuffled_bytes must not be negative, got {shuffled_bytes}")
    partitions = max(1, -(-shuffled_bytes // TASK_BYTES))
    settings = {
        **PLAN,
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
    }
    if not bucketed:
        settings["spark.sql.sources.bucketing.enabled"] = "false"
    return settings


def build(cpus: int | str = "*", app: str = "tastemap", **extra: str) -> SparkSession:
    """A local session; ``extra`` holds further settings by their full name."""
    partitions = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
