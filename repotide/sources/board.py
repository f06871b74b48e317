"""Task board: import, update, export of findings as tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repotide.functions.text import LEVEL_RANK, rank_of
from repotide.session import REPO

TASK = "title STRING, description STRING, priority INT, tags ARRAY<STRING>, dueDate STRING"


def import_tasks(df: DataFrame, column: str) -> DataFrame:
    """Board rows from JSON task texts: an object or a list per row, with the board's defaults."""
    text = F.trim(column)
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    task = df.select(*[c for c in df.columns if c != column],
                     F.explode(F.from_json(listed, f"ARRAY<STRUCT<{_struct(TASK)}>>")).alias("t"))
    return task.select(
        *[c for c in df.columns if c != column], F.col("t.title").alias("title"),
        F.coalesce("t.description", F.lit("")).alias("description"), F.lit("todo").alias("status"),
        F.coalesce("t.priority", F.lit(2)).alias("priority"),
        F.coalesce("t.tags", F.array().cast("array<string>")).alias("tags"),
        F.to_date("t.dueDate").alias("due_date"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.strip().split(" ", 1) for f in ddl.split(",")))


def update_tasks(tasks: DataFrame, updates: DataFrame, fields: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(updated board, one row with updated and skipped counts).

    Of several updates of one id the last set value by ``order`` wins, field by field; without an order
    column (or at a tie) the largest value.
    """
    named = updates.filter(F.col("task_id").isNotNull())
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*([F.col(order)] if order else []), F.col(f))))
    changed = named.groupBy("task_id").agg(*[last(f).alias(f"_new_{f}") for f in fields])
    board = tasks.join(changed, "task_id", "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in tasks.columns])
    known = tasks.select("task_id", F.lit(1).alias("_known"))
    counts = updates.join(known, "task_id", "left").agg(
        F.count_if(F.col("_known").isNotNull()).alias("updated"),
        F.count_if(F.col("_known").isNull()).alias("skipped"))
    return board, counts


def issues_to_tasks(issues: DataFrame, modules: DataFrame) -> DataFrame:
    """One task per issue; priority from the issue, else its module, else 2.

    ``issues``: repo_id, module, severity, type, file, line, description, suggestion (severity may
    be null). ``modules``: repo_id, module, module_severity.
    """
    joined = issues.join(modules, [REPO, "module"], "left")
    level = lambda c: F.lower(F.col(c))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    own = F.when(level("severity").isin(*LEVEL_RANK), rank_of(level("severity"), LEVEL_RANK))
    base = F.when(level("module_severity").isin(*LEVEL_RANK), rank_of(level("module_severity"), LEVEL_RANK))
    title = F.format_string("[AUDIT/%s] %s: %s", F.upper(F.coalesce("module_severity", F.lit("unknown"))),
                            F.col("module"), F.coalesce("type", F.lit("unknown")))
    body: Column = F.concat_ws(
        "\n", F.coalesce("description", F.lit("")), F.concat(F.lit("- module: "), F.col("module")),
        F.concat(F.lit("- file: "), none("file")), F.concat(F.lit("- line: "), none("line")),
        F.concat(F.lit("- suggestion: "), none("suggestion")))
    return joined.select(
        REPO, "module", title.alias("title"), body.alias("description"), F.lit("todo").alias("status"),
        F.coalesce(own, base, F.lit(2)).alias("priority"),
        F.array_compact(F.array(F.lit("audit"), level("module_severity"), F.col("type"))).alias("tags"))


def modules_to_tasks(modules: DataFrame) -> DataFrame:
    """One task per audited module, most severe first in priority."""
    sev = F.lower("module_severity")
    return modules.select(
        REPO, "module",
        F.format_string("[AUDIT] %s (%d issues)", "module", "issue_count").alias("title"),
        F.lit("todo").alias("status"),
        F.when(sev.isin(*LEVEL_RANK), rank_of(sev, LEVEL_RANK)).otherwise(2).alias("priority"),
        F.array(F.lit("type/audit"), F.concat(F.lit("severity/"), sev)).alias("tags"))
