"""Audit findings: matrices, statistics, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repotide.functions.text import percent, rank_of
from repotide.session import REPO


def audit_matrix(issues: DataFrame) -> DataFrame:
    """Open issues per severity, fixed and total, per module and as a TOTAL row per repository."""
    open_ = ~F.col("fixed")
    counted = lambda s: F.count_if(open_ & (F.col("severity") == s)).alias(s)
    rows = issues.rollup(REPO, "module_path").agg(
        *[counted(s) for s in ("critical", "error", "warning", "info")],
        F.count_if("fixed").alias("fixed"), F.count(F.lit(1)).alias("total"), F.grouping_id().alias("_g"))
    return rows.filter(F.col("_g") < 3).withColumn(
        "module", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("module_path"))).drop("_g", "module_path")


def order_matrix(matrix: DataFrame) -> DataFrame:
    """Most open issues first, the TOTAL row last."""
    return matrix.orderBy(F.col("module") == "TOTAL", (F.col("total") - F.col("fixed")).desc(), "module")


def scan_stats(issues: DataFrame) -> DataFrame:
    """Findings per severity and in total."""
    return issues.rollup("severity").agg(F.count(F.lit(1)).alias("issues")).withColumn(
        "severity", F.coalesce("severity", F.lit("total")))


SMELL_TYPES = ["weak", "skipped", "commented", "flaky"]


def smell_stats(smells: DataFrame) -> DataFrame:
    return smells.groupBy(REPO).pivot("type", SMELL_TYPES).agg(F.count(F.lit(1))).na.fill(0, SMELL_TYPES)


def fix_stats(issues: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Repair run per repository: modules, issues, fixable, outcome counts, issues per severity.

    ``outcomes``: issue_id, outcome (fixed / skipped / failed), at most one per issue.
    """
    rows = issues.join(outcomes, "issue_id", "left")
    n = lambda c, v: F.count_if(F.col(c) == v)
    return rows.groupBy(REPO).agg(
        F.countDistinct("module_path").alias("modules_scanned"), F.count(F.lit(1)).alias("total_issues"),
        F.count_if("fixable").alias("fixable"),
        *[n("outcome", o).alias(o) for o in ("fixed", "skipped", "failed")],
        *[n("severity", s).alias(s.lower()) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL")])


FIX_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def fix_queue(issues: DataFrame) -> DataFrame:
    """Fixable issues by severity, directory priority, file, line (global order)."""
    return issues.filter("fixable").orderBy(
        rank_of(F.col("severity"), FIX_RANK), rank_of(F.lower(F.coalesce("priority", F.lit(""))), PRIORITY_RANK), "file", "line")


def insight_bars(stats: DataFrame) -> DataFrame:
    """Severity counts relative to the largest one, and the ready share of audited modules.

    ``stats``: repo_id, critical, high, medium, low, fresh, clean, total.
    """
    levels = ["critical", "high", "medium", "low"]
    top = F.greatest(*[F.col(c) for c in levels])
    bar = lambda c: F.when(top > 0, F.col(c) / top).otherwise(F.lit(0.0))
    return stats.select(REPO, *[bar(c).alias(f"{c}_bar") for c in levels],
                        percent(F.col("fresh") + F.col("clean"), F.col("total")).alias("ready_percent"))
