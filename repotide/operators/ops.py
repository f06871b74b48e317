"""Batch runs and task boards: states, success, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repotide.functions.text import percent, round_half_up
from repotide.operators.windows import keep_last
from repotide.session import REPO

STATES = ["pending", "running", "completed", "failed", "timeout", "cancelled"]
BAD_STATUS = "error|fail|timeout|cancel"


def task_summary(state: DataFrame, *keys: str) -> DataFrame:
    """Counts per task state and in total per repository (and further keys)."""
    return state.groupBy(REPO, *keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATES])


def run_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: processed, counts per status as a map, failures, overall status.

    A result failed when its status contains ``error`` or ``success`` is false. Failed items stay
    rows of ``results``.
    """
    bad = F.col("status").contains("error") | (F.col("success") == F.lit(False))
    per = results.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"))
    pairs = F.array_sort(F.collect_list(F.struct("status", "n")))  # one entry per distinct status
    return per.groupBy(*keys).agg(
        F.sum("n").alias("processed"), F.map_from_entries(pairs).alias("by_status"), F.sum("bad").alias("failed"),
        F.when(F.sum("bad") == 0, "success").otherwise("completed_with_errors").alias("status"))


def success_rate(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Share of results whose status does not name a failure, one decimal; 0 when there are none.

    ``runs``: keys and ``by_status`` (map of counts).
    """
    per = runs.select(*keys, F.explode_outer("by_status").alias("status", "n"))
    good = F.when(F.lower("status").rlike(BAD_STATUS), 0).otherwise(F.col("n"))
    return per.groupBy(*keys).agg(percent(
        F.coalesce(F.sum(good), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), 1).alias("success_rate"))


def avg_from_history(runs: DataFrame) -> DataFrame:
    """Average item duration of each repository's newest usable run: stated average, else total
    duration per item, else elapsed time per item. ``runs``: repo_id, run_at, processed,
    avg_duration, duration, started_at, completed_at."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    elapsed = (micros("completed_at") - micros("started_at")) / 1000
    value = F.coalesce(round_half_up(F.col("avg_duration")), round_half_up(F.col("duration") / F.col("processed")),
                       F.when(elapsed > 0, round_half_up(elapsed / F.col("processed"))))
    usable = runs.filter(F.col("processed") > 0).withColumn("_avg", value).filter("_avg IS NOT NULL")
    return usable.groupBy(REPO).agg(F.max_by("_avg", "run_at").alias("avg_duration"))


def eta(state: DataFrame, now: Column, concurrency: int = 6, history: DataFrame | None = None) -> DataFrame:
    """Open tasks, average duration of completed ones (else from history), remaining milliseconds and
    expected completion per repository. ``now`` is an explicit timestamp."""
    n = lambda s: F.count_if(F.col("status") == s)
    done = F.avg(F.when(F.col("status") == "completed", F.col("duration_ms")))
    rows = state.groupBy(REPO).agg(
        n("pending").alias("pending"), n("running").alias("running"),
        F.coalesce(round_half_up(done), F.lit(0).cast("bigint")).alias("_avg"))
    if history is not None:
        rows = rows.join(history.select(REPO, F.col("avg_duration").alias("_old")), REPO, "left")
    else:
        rows = rows.withColumn("_old", F.lit(None).cast("bigint"))
    avg = F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(F.coalesce("_old", F.lit(0).cast("bigint")))
    left = round_half_up((F.col("pending") + F.col("running")) * avg / max(1, concurrency))
    finish = F.timestamp_millis(F.unix_millis(now.cast("timestamp")) + F.col("remaining_ms"))
    return rows.select(REPO, "pending", "running", avg.alias("avg_duration"), left.alias("remaining_ms")).withColumn(
        "completion", F.when(F.col("remaining_ms") > 0, finish))


def task_overview(types: DataFrame, results: DataFrame, history: DataFrame, keep: int = 5) -> tuple[DataFrame, DataFrame]:
    """(one row per task type with the last known status, the last ``keep`` history rows per type).

    The latest result wins, then the last history entry, else ``never_run``.
    """
    keys = [REPO, "task_name"]
    recent = keep_last(history, keys, [F.col("run_at").desc()], keep)
    last = history.groupBy(*keys).agg(F.max_by(F.struct("status", "run_at", "processed"), F.struct("run_at", "status", "processed")).alias("h"))
    result = results.groupBy(*keys).agg(F.max_by(F.struct("status", "run_at", "processed"), F.struct("run_at", "status", "processed")).alias("r"))
    rows = types.join(result, keys, "left").join(last, keys, "left")
    status = (F.when(F.col("r").isNotNull(), F.coalesce("r.status", F.lit("unknown")))
              .when(F.col("h").isNotNull(), F.coalesce("h.status", F.lit("completed"))).otherwise("never_run"))
    return rows.select(*keys, status.alias("status"), F.coalesce("r.run_at", "h.run_at").alias("last_run"),
                       F.coalesce("r.processed", "h.processed").alias("processed")), recent


def board_status(tasks: DataFrame) -> DataFrame:
    """Tasks per state, and the urgent ones still to do, per project."""
    n = lambda s: F.count_if(F.col("status") == s)
    return tasks.groupBy("project_id").agg(
        n("todo").alias("todo"), n("in_progress").alias("in_progress"), n("done").alias("done"),
        F.count_if((F.col("status") == "todo") & (F.col("priority") == 0)).alias("p0_todo"))


def board_lists(tasks: DataFrame) -> DataFrame:
    """The tasks a status report names: in progress, and P0 to do."""
    section = F.when(F.col("status") == "in_progress", "in_progress").when(
        (F.col("status") == "todo") & (F.col("priority") == 0), "p0_todo")
    return tasks.withColumn("section", section).filter("section IS NOT NULL")


def board_context(tasks: DataFrame, done_shown: int = 3, done_lines: int = 10, long_text: int = 500) -> DataFrame:
    """Tasks by report section with the text shown: P1 descriptions cut at 500 characters, P2 and
    below by title only, three finished tasks with their first ten lines."""
    st, pr, text = F.col("status"), F.col("priority"), F.coalesce("description", F.lit(""))
    section = (F.when(st == "in_progress", "in_progress").when((st == "todo") & (pr == 0), "p0")
               .when((st == "todo") & (pr == 1), "p1").when(st == "todo", "p2_plus").when(st == "done", "done"))
    lines = F.split(text, "\n", -1)
    cut_text = F.when(F.length(text) > long_text, F.concat(F.substring(text, 1, long_text), F.lit("\n...(truncated)"))).otherwise(text)
    head = F.array_join(F.slice(lines, 1, done_lines), "\n")
    shown = (F.when(section == "p1", cut_text).when(section == "p2_plus", "")
             .when(section == "done", F.when(F.size(lines) > done_lines, F.concat(head, F.lit("\n...(truncated)"))).otherwise(head))
             .otherwise(text))
    rows = tasks.withColumns({"section": section, "shown": shown}).filter("section IS NOT NULL")
    recent = keep_last(rows.filter("section = 'done'"), ["project_id"], [F.col("priority"), F.col("task_id")], done_shown)
    return rows.filter("section <> 'done'").unionByName(recent)


def priority_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("project_id", "priority").agg(F.count(F.lit(1)).alias("tasks"))
