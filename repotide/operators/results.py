"""Test outcomes: errors, summaries, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.functions.text import error_patterns, error_type, round_half_up, truncate
from repotide.session import REPO


def verdict_files(df: DataFrame, column: str) -> DataFrame:
    """(task_id, path, verdict) from evaluation JSON; failed entries are strings or objects."""
    v = F.from_json(column, "overall STRING, passedFiles ARRAY<STRING>, failedFiles ARRAY<STRING>")
    path = lambda s: F.when(s.startswith("{"), F.get_json_object(s, "$.path")).otherwise(s)
    entry = lambda col, verdict: F.transform(
        F.coalesce(col, F.array().cast("array<string>")), lambda s: F.struct(path(s).alias("path"), F.lit(verdict).alias("verdict")))
    rows = df.select("task_id", v.alias("v"))
    both = F.concat(entry(F.col("v.passedFiles"), "passed"), entry(F.col("v.failedFiles"), "failed"))
    return rows.select("task_id", F.explode(both).alias("f")).select("task_id", "f.path", "f.verdict")


def error_summary(errors: DataFrame, samples: int = 2) -> DataFrame:
    """Per test file: error count, most frequent type (ties: first seen), first messages truncated.

    ``errors``: repo_id, test_path, test, message, seq (order of appearance). The samples come
    from a rank limit, so a file with many errors sends two rows per task.
    """
    typed = errors.withColumn("_type", error_type(F.col("message"), variant="plan"))
    per_type = typed.groupBy(REPO, "test_path", "_type").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first"))
    main = per_type.groupBy(REPO, "test_path").agg(
        F.sum("_n").alias("count"), F.max_by("_type", F.struct("_n", -F.col("_first"))).alias("main_type"))
    w = Window.partitionBy(REPO, "test_path").orderBy("seq")
    line = truncate(F.substring_index("message", "\n", 1), 70)
    first = errors.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= samples).groupBy(REPO, "test_path").agg(
        *[F.max(F.when(F.col("_rn") == i, line)).alias(f"sample_{i}") for i in range(1, samples + 1)])
    return main.join(first, [REPO, "test_path"])


def error_type_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy(REPO, error_type(F.col("message")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def error_pattern_counts(errors: DataFrame) -> DataFrame:
    return errors.select(REPO, F.explode(error_patterns(F.col("message"))).alias("pattern")).groupBy(REPO, "pattern").agg(
        F.count(F.lit(1)).alias("n"))


def result_summary(results: DataFrame, *keys: str) -> DataFrame:
    """Totals per repository (and further keys): passed, failed, skipped, duration."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy(REPO, *keys).agg(
        F.count(F.lit(1)).alias("total"), n("passed").alias("passed"), n("failed").alias("failed"),
        n("skipped").alias("skipped"), F.sum("duration_ms").alias("duration_ms"))


def estimate_duration(history: DataFrame, n_files: int, keys: list[str] = [REPO]) -> DataFrame:  # noqa: B006
    """Mean milliseconds per file over the valid history times ``n_files``; null without history."""
    valid = history.filter((F.col("files") > 0) & (F.col("duration_ms") > 0))
    per_file = F.avg(F.col("duration_ms") / F.col("files"))
    return valid.groupBy(*keys).agg(round_half_up(per_file * n_files).alias("estimate_ms"))


def top_failures(summary: DataFrame, k: int = 12) -> DataFrame:
    """Test files with the most failures."""
    return summary.orderBy(F.col("count").desc(), REPO, "test_path").limit(k)


def unfixed(errors: DataFrame, fixed: DataFrame, keys: list[str]) -> DataFrame:
    """Errors without a finished repair task."""
    return errors.join(fixed.select(*keys).distinct(), keys, "left_anti")
