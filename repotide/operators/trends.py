"""Issue history between snapshots, and alerts on change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.functions.text import percent
from repotide.session import REPO


def _by_day() -> Window:
    """Snapshots of one repository in order: one row per day after aggregation."""
    return Window.partitionBy(REPO).orderBy("day")


def effective_snapshots(totals: DataFrame, order: str = "taken_at") -> DataFrame:
    """Snapshots worth keeping: the date or the total differs from the last kept one.

    ``totals``: repo_id, day, taken_at, total. Rows dropped since the last kept one equal it in both,
    so comparing with the row before is the same as comparing with the last kept one.
    """
    w = Window.partitionBy(REPO).orderBy(order)
    same = (F.lag("day").over(w) == F.col("day")) & (F.lag("total").over(w) == F.col("total"))
    return totals.withColumn("_same", F.coalesce(same, F.lit(False))).filter(~F.col("_same")).drop("_same")


def snapshot_trend(snapshots: DataFrame) -> DataFrame:
    """Per repository and snapshot day: total, new and resolved issues, running resolved.

    ``snapshots``: repo_id, day, module_id, issues (modules without issues may be absent). Each row is
    compared with the same module in the snapshot before: it adds to its own day and, negated, to the
    day after, so a module that vanished counts as resolved. No module x day grid is built.
    """
    days = snapshots.select(REPO, "day").distinct().withColumn("next_day", F.lead("day").over(_by_day()))
    here = snapshots.join(days, [REPO, "day"])
    now = here.select(REPO, "day", "module_id", F.col("issues").alias("cur"), F.lit(0).cast("bigint").alias("prev"))
    later = here.filter("next_day IS NOT NULL").select(
        REPO, F.col("next_day").alias("day"), "module_id", F.lit(0).cast("bigint").alias("cur"), F.col("issues").alias("prev"))
    module = now.unionByName(later).groupBy(REPO, "day", "module_id").agg(F.sum("cur").alias("cur"), F.sum("prev").alias("prev"))
    change = F.col("cur") - F.col("prev")
    zero = F.lit(0).cast("bigint")
    trend = module.groupBy(REPO, "day").agg(
        F.sum("cur").alias("total"), F.sum(F.greatest(change, zero)).alias("new"), F.sum(F.greatest(-change, zero)).alias("resolved"))
    return trend.withColumn("total_resolved", F.sum("resolved").over(_by_day().rowsBetween(Window.unboundedPreceding, 0)))


def total_trend(totals: DataFrame) -> DataFrame:
    """The same from totals alone, for snapshots without module counts; the first one is all new."""
    before = F.coalesce(F.lag("total").over(_by_day()), F.lit(0).cast("bigint"))
    change, zero = F.col("total") - before, F.lit(0).cast("bigint")
    return totals.select(REPO, "day", "total", F.greatest(change, zero).alias("new"), F.greatest(-change, zero).alias("resolved"))


def resolution_rate(trend: DataFrame) -> DataFrame:
    """Resolved share of all issues ever seen: resolved / (open now + resolved), in percent."""
    last = trend.groupBy(REPO).agg(F.max_by("total", "day").alias("open"), F.sum("resolved").alias("resolved"))
    return last.withColumn("resolved_percent", percent(F.col("resolved"), F.col("open") + F.col("resolved")))


def alert(current: Column, last: Column, variant: str = "growth", threshold: int = 3) -> Column:
    """``growth``: grew by more than the threshold; ``change``: moved by at least it. Both also fire
    on the first detection."""
    first = (current > 0) & (last == 0)
    moved = (current - last > threshold) if variant == "growth" else (F.abs(current - last) >= threshold)
    return moved | first


def stale_alerts(counts: DataFrame, variant: str = "growth", threshold: int = 3) -> DataFrame:
    """Each count per repository and day with the one before, the change, and whether to notify."""
    last = F.coalesce(F.lag("n").over(_by_day()), F.lit(0).cast("bigint"))
    rows = counts.withColumn("last", last)
    return rows.select(REPO, "day", "n", "last", (F.col("n") - F.col("last")).alias("change"),
                       alert(F.col("n"), F.col("last"), variant, threshold).alias("notify"))
