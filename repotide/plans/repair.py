"""Repair planning: which sources to fix first so that failing tests recover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.operators.graph import (
    NODE, component_of, condense, cyclic_nodes, degrees, fix_graph, importers_of, spread, topo_batches, topo_order)
from repotide.operators.windows import batches, keep_last, number_rows
from repotide.session import REPO
from repotide.session import cut_wide as cut

MAX_ROOT_CAUSES = 8
COVER_SHARE = 0.7


def potential_cover(edges: DataFrame, failing_map: DataFrame) -> DataFrame:
    """(node, test_path): failing tests on a file or on anything that transitively imports it.

    ``failing_map``: repo_id, node, test_path. Each failing test is pushed from its files to what they import, on
    the condensed graph, so rows are distinct (component, test), never (file, file). Only components from
    which an involved file can be reached are walked.
    """
    edges = cut(edges)
    cyclic = cyclic_nodes(edges)
    failing = cut(component_of(failing_map.select(*NODE, "test_path").distinct(), cyclic))
    involved = failing.select(REPO, F.col("component").alias("node")).distinct()
    dag = cut(condense(edges, cyclic))
    above = importers_of(dag, involved).select(REPO, F.col("node").alias("dst"))
    links = dag.join(above, [REPO, "dst"], "left_semi").select(REPO, F.col("src").alias("node"), F.col("dst").alias("next"))
    # Written as one table: a semi join goes below the union of the rounds, and what joins that union next fails in Spark 4.1.
    pushed = cut(spread(links, failing.select(REPO, F.col("test_path").alias("start"), F.col("component").alias("node"))))
    covered = pushed.join(involved, NODE, "left_semi").select(REPO, F.col("node").alias("component"), F.col("start").alias("test_path"))
    return failing.select(*NODE, "component").distinct().join(covered, [REPO, "component"]).select(*NODE, "test_path")


def potential_fixes(cover: DataFrame) -> DataFrame:
    """Distinct failing tests each file could repair."""
    return cover.groupBy(*NODE).agg(F.count(F.lit(1)).alias("potential_fixes"))


def candidates(edges: DataFrame, failing_map: DataFrame, cover: DataFrame) -> DataFrame:
    """Involved files with importer count, own failing tests and potential fixes."""
    own = failing_map.select(*NODE, "test_path").distinct().groupBy(*NODE).agg(F.count(F.lit(1)).alias("failing"))
    deg = degrees(own, edges).select(*NODE, F.col("imported_by").alias("dependents"))
    return own.join(deg, NODE).join(potential_fixes(cover), NODE, "left").na.fill(0, ["potential_fixes"])


def _ranking():
    return [F.col("dependents").desc(), F.col("potential_fixes").desc(), F.col("failing").desc(), F.col("node")]


def root_causes(cands: DataFrame, cover: DataFrame, total_failing: DataFrame) -> DataFrame:
    """(node, pick): the greedy cover in candidate order, as windows.

    A candidate adds a test iff it is the first candidate that covers it. Picks go on until two or
    more cover 70 % of the failing tests, or min(8, max(2, a quarter of the candidates)) are taken;
    a repository whose candidates cover nothing takes its first one. At most eight rows per
    repository reach the final window. ``total_failing``: repo_id, failing_tests.
    """
    ranked = number_rows(cands, [REPO], _ranking(), "rank").select(*NODE, "rank")
    first = cover.join(ranked, NODE).groupBy(REPO, "test_path").agg(F.min("rank").alias("rank"))
    added = first.groupBy(REPO, "rank").agg(F.count(F.lit(1)).alias("added"))
    limits = ranked.groupBy(REPO).agg(F.least(
        F.lit(MAX_ROOT_CAUSES), F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)) * 0.25))).alias("cap")).join(
        total_failing.select(REPO, F.greatest(F.lit(1), F.ceil(F.col("failing_tests") * COVER_SHARE)).alias("target")), REPO)
    kept = keep_last(ranked.join(added, [REPO, "rank"]), [REPO], [F.col("rank")], MAX_ROOT_CAUSES)
    w = Window.partitionBy(REPO).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = kept.withColumns({"pick": F.count(F.lit(1)).over(w), "_sum": F.sum("added").over(w)}).join(limits, REPO)
    stop = F.when((F.col("pick") >= 2) & (F.col("_sum") >= F.col("target")), F.col("pick"))
    steps = steps.withColumn("_stop", F.min(stop).over(Window.partitionBy(REPO)))
    picked = steps.filter((F.col("pick") <= F.col("cap")) & (F.col("pick") <= F.coalesce("_stop", F.col("cap")))).select(*NODE, "pick")
    bare = ranked.filter("rank = 1").join(kept.select(REPO).distinct(), REPO, "left_anti").select(*NODE, F.lit(1).cast("bigint").alias("pick"))
    return picked.unionByName(bare)


def repair_plan(edges: DataFrame, failing_map: DataFrame) -> DataFrame:
    """(phase, batch, position, node, tests): root causes, then batches of middle files, then leaves;
    ``order`` rows give the dependency-first order over all involved files."""
    edges = cut(edges)
    failing_map = cut(failing_map.select(*NODE, "test_path").distinct())
    cover = cut(potential_cover(edges, failing_map))
    cands = cut(candidates(edges, failing_map, cover))
    total = failing_map.select(REPO, "test_path").distinct().groupBy(REPO).agg(F.count(F.lit(1)).alias("failing_tests"))
    roots = cut(root_causes(cands, cover, total))
    links, degree = fix_graph(edges, cands)
    links = cut(links)
    rest = cands.join(roots.select(*NODE), NODE, "left_anti").join(degree, NODE)
    leaves = rest.filter("out_degree = 0").select(*NODE, "failing")
    middle = rest.filter("out_degree > 0").select(*NODE, "failing")
    batched = topo_batches(links, middle).join(middle, NODE)
    first = number_rows(cands.join(roots.select(*NODE), NODE, "left_semi"), [REPO], _ranking(), "position").select(
        REPO, F.lit("root_causes").alias("phase"), F.lit(0).alias("batch"), "position", "node", F.col("failing").alias("tests"))
    second = number_rows(batched, [REPO, "batch"], [F.col("failing").desc(), F.col("node")], "position").select(
        REPO, F.lit("independent").alias("phase"), "batch", "position", "node", F.col("failing").alias("tests"))
    third = number_rows(leaves, [REPO], [F.col("failing").desc(), F.col("node")], "position").select(
        REPO, F.lit("leaf_nodes").alias("phase"), F.lit(0).alias("batch"), "position", "node", F.col("failing").alias("tests"))
    order = topo_order(links, cands, links_are_ordered=True).join(cands.select(*NODE, "failing"), NODE).select(
        REPO, F.lit("order").alias("phase"), F.lit(0).alias("batch"), "position", "node", F.col("failing").alias("tests"))
    return first.unionByName(second).unionByName(third).unionByName(order)


def simple_candidates(edges: DataFrame, failing_map: DataFrame) -> DataFrame:
    """Involved files with importers, failing tests, and the failing tests of direct importers."""
    own = failing_map.select(*NODE, "test_path").distinct().groupBy(*NODE).agg(F.count(F.lit(1)).alias("failing"))
    importers = edges.select(REPO, F.col("dst").alias("node"), F.col("src").alias("by")).distinct()
    near = importers.join(own.select(REPO, F.col("node").alias("by"), F.col("failing").alias("_f")), [REPO, "by"]).groupBy(
        *NODE).agg(F.sum("_f").alias("potential_fixes"))
    deg = degrees(own, edges).select(*NODE, F.col("imported_by").alias("dependents"))
    return own.join(deg, NODE).join(near, NODE, "left").na.fill(0, ["potential_fixes"])


def repair_plan_simple(edges: DataFrame, failing_map: DataFrame, roots: int = 10, batch: int = 5, order: int = 20) -> DataFrame:
    """One-hop plan: up to ten root causes (files with importers), leaves in batches of five, and the
    first twenty files as the suggested order."""
    cands = cut(simple_candidates(edges, failing_map))
    ranked = cands.withColumn("tests", F.col("failing"))
    top = keep_last(ranked.filter("dependents > 0"), [REPO], _ranking(), roots)
    first = number_rows(top, [REPO], _ranking(), "position").select(
        REPO, F.lit("root_causes").alias("phase"), F.lit(0).cast("bigint").alias("batch"), "position", "node", "tests")
    leaves = batches(ranked.filter("dependents = 0"), [REPO], _ranking(), batch, "batch")
    second = number_rows(leaves, [REPO, "batch"], _ranking(), "position").select(
        REPO, F.lit("leaf_nodes").alias("phase"), "batch", "position", "node", "tests")
    third = number_rows(keep_last(ranked, [REPO], _ranking(), order), [REPO], _ranking(), "position").select(
        REPO, F.lit("order").alias("phase"), F.lit(0).cast("bigint").alias("batch"), "position", "node", "tests")
    return first.unionByName(second).unionByName(third)
