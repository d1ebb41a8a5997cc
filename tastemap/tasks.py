"""Rows per task of the stages that some work runs, for measurements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class Stage:
    tasks: int
    input_rows: int
    largest_input: int
    largest_shuffle: int


def recorded(spark: SparkSession, work: Callable[[], object]) -> list[Stage]:
    """Runs ``work`` and reads the rows of each task from Spark's own status store."""
    store = spark.sparkContext._jsc.sc().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    tracker = spark.sparkContext.statusTracker()
    group = f"recorded-{id(work)}"
    spark.sparkContext.setJobGroup(group, "rows per task")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    bus.waitUntilEmpty()
    stages = []
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            info = tracker.getStageInfo(stage)
            if info is None or not info.numCompletedTasks:
                continue  # skipped: its output was there already
            tasks = store.taskList(stage, 0, 1_000_000)
            inputs, shuffles = [], []
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                if metrics.isDefined():
                    inputs.append(metrics.get().inputMetrics().recordsRead())
                    shuffles.append(metrics.get().shuffleReadMetrics().recordsRead())
            stages.append(Stage(len(inputs), sum(inputs), max(inputs, default=0), max(shuffles, default=0)))
    return stages
