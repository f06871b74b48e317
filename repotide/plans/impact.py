"""Change impact, stale propagation and affected tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repotide.operators.graph import NODE, Log, rounds
from repotide.operators.windows import keep_last, number_rows
from repotide.session import REPO, cut_counting
from repotide.session import cut_wide as cut

HIGH_RISK_DEPENDENTS = 50
HIGH_RISK_TOP = 10
UNMAPPED_LEVEL = 99


def propagate(edges: DataFrame, direct: DataFrame, depth: int | None = 2) -> DataFrame:
    """(node, level, cause): files made stale by the direct ones through their importers.

    The cause is the importer chain's previous file. Among equally near ones it is the one first in
    the breadth-first order of sorted names. That order is kept as one number per node: a level is sorted
    by the cause's number and the name, so no row carries its path and rows stay the same size at any depth.
    """
    edges = cut(edges)
    importers = edges.select(REPO, F.col("dst").alias("node"), F.col("src").alias("next"))

    def sorted_(rows: DataFrame, *order: str) -> tuple[DataFrame, dict[str, int]]:
        laid = rows.repartitionByRange(REPO, *order).sortWithinPartitions(REPO, *order)
        return cut_counting(laid.withColumn("place", F.monotonically_increasing_id()).select(*NODE, "level", "cause", "place"))

    frontier, size = sorted_(direct.select(*NODE).distinct().withColumns({"level": F.lit(0), "cause": F.col("node")}), "node")
    seen = Log()
    for level in rounds(depth):
        if not size["rows"]:
            break
        step = frontier.join(importers, NODE).groupBy(REPO, F.col("next").alias("node")).agg(
            F.min(F.struct("place", F.col("node").alias("cause"))).alias("via"))
        fresh, known = step.join(frontier, NODE, "left_anti"), seen.rows()
        fresh = fresh if known is None else fresh.join(known, NODE, "left_anti")
        fresh, size = sorted_(fresh.select(*NODE, F.lit(level).alias("level"), "via.cause", F.col("via.place").alias("by")), "by", "node")
        seen.add(frontier)
        frontier = fresh
    known = seen.rows()
    every = frontier if known is None else known.unionByName(frontier)
    return every.filter("level > 0").select(*NODE, "level", "cause")


def propagation_summary(direct: DataFrame, propagated: DataFrame) -> DataFrame:
    """Files per level (0 is direct) and in total per repository."""
    rows = direct.select(*NODE).distinct().withColumn("level", F.lit(0)).unionByName(propagated.select(*NODE, "level"))
    out = rows.rollup(REPO, "level").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("files")).filter("_g < 3")
    label = F.when(F.col("_g") == 1, "total").when(F.col("level") == 0, "direct").otherwise(
        F.concat(F.lit("L"), F.col("level").cast("string")))
    return out.select(REPO, label.alias("level"), "files")


def high_risk(reach: DataFrame, least: int = HIGH_RISK_DEPENDENTS, top: int = HIGH_RISK_TOP) -> DataFrame:
    """The files with the most transitive dependents, count first, then name."""
    return keep_last(reach.filter(F.col("dependents") >= least), [REPO], [F.col("dependents").desc(), F.col("node")], top)


def module_breakdown(affected: DataFrame) -> DataFrame:
    """Affected files per module, most first. ``affected``: repo_id, module."""
    return affected.groupBy(REPO, "module").agg(F.count(F.lit(1)).alias("files")).orderBy(
        REPO, F.col("files").desc(), "module")


def affected_tests(direct: DataFrame, propagated: DataFrame, test_map: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(test_path, level): 1 for tests of direct sources, level + 1 for propagated ones, the smallest
    per test. Tests of ``tests`` without a mapped source get level 99."""
    levels = direct.select(REPO, F.col("node").alias("source"), F.lit(1).alias("level")).unionByName(
        propagated.select(REPO, F.col("node").alias("source"), (F.col("level") + 1).alias("level")))
    best = levels.groupBy(REPO, "source").agg(F.min("level").alias("level"))
    hit = test_map.join(best, [REPO, "source"]).groupBy(REPO, "test_path").agg(F.min("level").alias("level"))
    if tests is None:
        return hit
    return tests.select(REPO, "test_path").distinct().join(hit, [REPO, "test_path"], "left").withColumn(
        "level", F.coalesce("level", F.lit(UNMAPPED_LEVEL)))


NO_RANK = 1_000_000_000


def order_tests(tests: DataFrame, test_map: DataFrame, ranks: DataFrame) -> DataFrame:
    """Affected tests with their position: level, then the best rank of their sources, then name."""
    best = test_map.join(ranks.select(REPO, "source", "source_rank"), [REPO, "source"]).groupBy(REPO, "test_path").agg(
        F.min("source_rank").alias("_rank"))
    rows = tests.join(best, [REPO, "test_path"], "left").withColumn("_rank", F.coalesce("_rank", F.lit(NO_RANK)))
    return number_rows(rows, [REPO], [F.col("level"), F.col("_rank"), F.col("test_path")], "position").drop("_rank")
