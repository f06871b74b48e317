"""Task boards: which tasks can run together, and what the others wait for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repotide.operators.graph import peel
from repotide.operators.windows import number_rows
from repotide.session import REPO


def task_waves(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(project_id, task_id, level): a task is one level after its last dependency.

    Dependencies outside the set are ignored; tasks on or behind a circle have a null level.
    ``deps``: project_id, task_id, dep.
    """
    nodes = tasks.select(F.col("project_id").alias(REPO), F.col("task_id").alias("node"))
    links = deps.select(F.col("project_id").alias(REPO), F.col("dep").alias("src"), F.col("task_id").alias("dst"))
    done, left = peel(links, nodes)
    rows = done.withColumnRenamed("layer", "level").unionByName(left.withColumn("level", F.lit(None).cast("int")))
    return rows.select(F.col(REPO).alias("project_id"), F.col("node").alias("task_id"), "level")


def wave_plan(waves: DataFrame, max_parallel: int = 3) -> DataFrame:
    """Size of each level, whether it has parallel work and how many run at once."""
    n = F.count(F.lit(1))
    return waves.filter("level IS NOT NULL").groupBy("project_id", "level").agg(
        n.alias("tasks"), (n > 1).alias("parallel"), F.least(n, F.lit(max_parallel).cast("bigint")).alias("max_parallel"))


def order_wave(waves: DataFrame, tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Position inside each level: priority, then fewer dependencies, then id."""
    n_deps = deps.groupBy("project_id", "task_id").agg(F.countDistinct("dep").alias("n_deps"))
    rows = waves.filter("level IS NOT NULL").join(tasks.select("project_id", "task_id", "priority"), ["project_id", "task_id"]).join(
        n_deps, ["project_id", "task_id"], "left").na.fill(0, ["n_deps"])
    return number_rows(rows, ["project_id", "level"], [F.col("priority"), F.col("n_deps"), F.col("task_id")], "position")


def blocked(tasks: DataFrame, deps: DataFrame, done: DataFrame) -> DataFrame:
    """(project_id, task_id, waits_for): unfinished tasks and the unfinished dependencies they wait
    for; dependencies outside the run count as satisfied."""
    key = ["project_id", "task_id"]
    waiting = tasks.select(*key).join(done.select(*key), key, "left_anti")
    pending = waiting.select("project_id", F.col("task_id").alias("dep"))
    return deps.join(waiting, key, "left_semi").join(pending, ["project_id", "dep"], "left_semi").select(
        *key, F.col("dep").alias("waits_for")).distinct()
