"""Joins between inventories, documents, tests and rules.

Prefix relations are equi-joins on exploded ancestor directories, per distinct directory rather
than per file. Sides that may repeat a hot key are reduced to one row per key before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repotide.functions.paths import (
    ancestors, base_name, dir_name, expected_source_path, expected_test_path, extension, join_path, module_of, stem)
from repotide.operators.extract import with_js
from repotide.session import REPO


def nearest_owner(dirs: DataFrame, owners: DataFrame, include_self: bool = True, owner: str = "owner") -> DataFrame:
    """(repo_id, dir, owner): the nearest ancestor directory of ``dir`` that is in ``owners``."""
    above = dirs.select(REPO, "dir").distinct().select(
        REPO, "dir", F.explode(ancestors(F.col("dir"), include_self)).alias(owner))
    known = owners.select(REPO, F.col("dir").alias(owner)).distinct()
    return above.join(known, [REPO, owner]).groupBy(REPO, "dir").agg(
        F.max_by(owner, F.when(F.col(owner) == ".", 0).otherwise(F.length(owner))).alias(owner))


def own_files(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Files with the nearest documented directory above them (``owner``) and its document's time.

    The owner's columns are attached per directory, so the files meet one join, on their directory.
    """
    owners = nearest_owner(files, docs).join(
        docs.select(REPO, F.col("dir").alias("owner"), "doc_mtime"), [REPO, "owner"])
    return files.join(owners, [REPO, "dir"])


def changed_since(owned: DataFrame) -> DataFrame:
    """Owned files newer than their document; equal times are fresh."""
    return owned.filter(F.col("mtime") > F.col("doc_mtime"))


def tests_for(sources: DataFrame, test_map: DataFrame) -> DataFrame:
    """Distinct tests covering a set of sources (repo_id, source_path)."""
    return test_map.join(sources.select(REPO, "source_path").distinct(), [REPO, "source_path"], "left_semi").select(
        REPO, "test_path").distinct()


def sources_for(failing: DataFrame, test_map: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(repo_id, test_path, source_path) of failing tests.

    The test map first; where it has nothing, the sources named by the errors. A repository for
    which neither knows any source uses the tests themselves.
    """
    failing = failing.select(REPO, "test_path").distinct()
    mapped = failing.join(test_map.select(REPO, "test_path", "source_path").distinct(), [REPO, "test_path"])
    if errors is not None:
        rest = failing.join(mapped.select(REPO, "test_path").distinct(), [REPO, "test_path"], "left_anti")
        named = errors.filter(F.col("source_path").isNotNull()).select(REPO, "test_path", "source_path").distinct()
        mapped = mapped.unionByName(rest.join(named, [REPO, "test_path"]))
    bare = failing.join(mapped.select(REPO).distinct(), REPO, "left_anti").select(
        REPO, "test_path", F.col("test_path").alias("source_path"))
    return mapped.unionByName(bare)


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a counterpart."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def split_known(changed: DataFrame, nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(changed rows in the graph, changed rows to warn about)."""
    known = nodes.select(*keys).distinct()
    return changed.join(known, keys, "left_semi"), changed.join(known, keys, "left_anti")


def longest_prefix_join(files: DataFrame, rules: DataFrame, path: str = "path", rule: str = "rule_path") -> DataFrame:
    """Each row with the most specific rule at or above its path; null columns without one.

    ``rules``: [repo_id,] rule_path and any columns. Without ``repo_id`` they hold everywhere. A rule
    for the path itself wins; the others are resolved once per directory.
    """
    keys = [REPO, rule] if REPO in rules.columns else [rule]
    extra = [c for c in rules.columns if c not in (REPO, rule)]
    carried = F.struct(F.col(rule), *extra)
    rows = files.withColumn("_dir", dir_name(F.col(path)))
    above = rows.select(REPO, "_dir").distinct().select(
        REPO, "_dir", F.explode(ancestors(F.col("_dir"), include_self=True)).alias(rule)).filter(F.col(rule) != ".")
    by_dir = above.join(rules, keys).groupBy(REPO, "_dir").agg(F.max_by(carried, F.length(rule)).alias("_above"))
    exact = rules.select(*[REPO for _ in keys[1:]], F.col(rule).alias(path), carried.alias("_own"))
    joined = rows.join(by_dir, [REPO, "_dir"], "left").join(exact, [*[REPO for _ in keys[1:]], path], "left")
    best = F.coalesce("_own", "_above")
    return joined.select(*[F.col(c) for c in files.columns], *[best[c].alias(c) for c in (rule, *extra)])


def merge_modules(*lists: DataFrame) -> DataFrame:
    """Merge module lists (repo_id, path, status, changed, want_doc, want_audit) by path.

    A later list overrides the scalars it sets; the first non-zero ``changed`` count stays. One
    union and one aggregation, whatever the number of lists.
    """
    tagged = [df.select(REPO, "path", "status", "changed", "want_doc", "want_audit", F.lit(i).alias("_list"))
              for i, df in enumerate(lists)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_list"))).alias(c)
    first = F.min_by("changed", F.when(F.col("changed") > 0, F.col("_list")))
    return rows.groupBy(REPO, "path").agg(
        latest("status"), F.coalesce(first, F.lit(0).cast("bigint")).alias("changed"),
        latest("want_doc"), latest("want_audit"))


def name_candidates(test_path: Column) -> Column:
    """Source names to try for a test, in order."""
    name = F.regexp_replace(base_name(test_path), r"\.test\.[^.]+$", "")
    strip = lambda p: F.regexp_replace(name, p, "")
    return F.array(name, strip("^test-"), strip("-test$"), strip(r"\.vitest$"), strip(r"\.integration$"), strip(r"\.e2e$"))


def match_by_name(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_id, test_path, source_path): the source with the test's name, smallest path on ties.

    Sources are reduced to one row per name first, so a name that is everywhere stays one row.
    """
    by_name = sources.groupBy(REPO, stem(F.col("path")).alias("_name")).agg(F.min("path").alias("source_path"))
    tried = tests.select(REPO, F.col("path").alias("test_path"), F.posexplode(
        name_candidates(F.col("path"))).alias("_pos", "_name"))
    return tried.join(by_name, [REPO, "_name"]).groupBy(REPO, "test_path").agg(
        F.min_by("source_path", "_pos").alias("source_path"))


def match_by_token(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """Same by whole name tokens of the test's base name (smallest test path per source)."""
    token = F.explode(F.array_distinct(F.concat(
        F.array(F.regexp_replace(base_name(F.col("path")), r"\..*$", "")), F.split(base_name(F.col("path")), r"[.\-_]"))))
    by_token = tests.select(REPO, F.col("path").alias("test_path"), token.alias("_name")).groupBy(REPO, "_name").agg(
        F.min("test_path").alias("test_path"))
    return sources.select(REPO, F.col("path").alias("source_path"), stem(F.col("path")).alias("_name")).join(
        by_token, [REPO, "_name"]).drop("_name")


# Extensions tried for a specifier without one, in order; the first names the index file.
RESOLVE_EXTENSIONS = {
    "javascript": (".js", ".mjs", ".jsx"), "typescript": (".ts", ".tsx", ".js", ".jsx"), "python": (".py",),
}


def resolve_imports(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] | None = None,
                    language: str = "javascript") -> DataFrame:
    """(repo_id, path, spec, target): the first existing candidate of a relative specifier.

    ``extensions``: those of the language unless given. Candidates: the path itself when it has an extension, else with each extension, else the
    index file of the directory.
    """
    extensions = extensions or RESOLVE_EXTENSIONS[language]
    relative = imports.filter(F.col("spec").startswith("."))
    base = join_path(dir_name(F.col("path")), F.col("spec"))
    tried = F.when(extension(base) != "", F.array(base)).otherwise(F.array(
        *[F.concat(base, F.lit(e)) for e in extensions], F.concat(base, F.lit("/index" + extensions[0]))))
    rows = relative.select(REPO, "path", "spec", F.posexplode(tried).alias("_pos", "target")).filter(
        ~F.col("target").startswith(".."))
    known = files.select(REPO, F.col("path").alias("target")).distinct()
    return rows.join(known, [REPO, "target"]).groupBy(REPO, "path", "spec").agg(F.min_by("target", "_pos").alias("target"))


def trace_symbols(test_imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """(repo_id, test_path, source_path): imported files, and the real sources behind index files.

    A star re-export hides its names, so nothing is traced through it.
    """
    resolved = test_imports.select(
        REPO, F.col("path").alias("test_path"), "symbol",
        with_js(join_path(dir_name(F.col("path")), F.col("from_path"))).alias("index_path"))
    through = resolved.join(reexports.filter(F.col("symbol") != "*"), [REPO, "index_path", "symbol"]).select(
        REPO, "test_path", "source_path")
    direct = resolved.select(REPO, "test_path", F.col("index_path").alias("source_path"))
    return direct.unionByName(through).distinct()


def overlay_failures(modules: DataFrame, runs: DataFrame) -> DataFrame:
    """Module status overridden by failures of the repository's most recent run.

    ``modules``: repo_id, module_id, enable_audit. ``runs``: repo_id, run, module_id, status, reason.
    """
    last = runs.groupBy(REPO).agg(F.max("run").alias("run"))
    failed = runs.join(last, [REPO, "run"], "left_semi").filter(
        F.col("status").isin("failed", "timeout", "cancelled")).groupBy(REPO, "module_id").agg(
        F.max_by(F.struct("status", "reason"), F.struct("at", "status", "reason")).alias("_f"))
    base = F.when(F.col("enable_audit"), "ready").otherwise("disabled")
    return modules.join(failed, [REPO, "module_id"], "left").select(
        REPO, "module_id", F.coalesce("_f.status", base).alias("status"), F.col("_f.reason").alias("error"))


def test_placement(tests: DataFrame, sources: DataFrame, src_root: str = "js") -> DataFrame:
    """``correct``, ``misplaced`` or ``orphan`` per test with its expected place.

    Paths are project paths: sources under ``src_root``, tests under ``tests``.
    """
    expected = expected_source_path(F.col("path"), src_root)
    known = sources.select(REPO, F.col("path").alias("expected_source"), F.lit(True).alias("_exists"))
    rows = tests.select(REPO, F.col("path").alias("test_path"), expected.alias("expected_source")).join(
        known, [REPO, "expected_source"], "left").join(
        match_by_name(tests, sources).withColumnRenamed("source_path", "actual_source"), [REPO, "test_path"], "left")
    target = expected_test_path(F.col("actual_source"), "mirrored", src_root)
    status = (F.when(F.col("_exists"), "correct").when(F.col("actual_source").isNull(), "orphan")
              .when(target == F.col("test_path"), "correct").otherwise("misplaced"))
    return rows.select(REPO, "test_path", status.alias("status"), "expected_source", "actual_source",
                       F.when(F.col("_exists").isNull(), target).alias("expected_test"))


def group_changes(changes: DataFrame, test_map: DataFrame) -> DataFrame:
    """Changed files with their module: from the test map (sources and tests), else by path rule.

    ``test_map``: repo_id, module, source_path, test_path.
    """
    both = test_map.select(REPO, F.col("source_path").alias("path"), "module").unionByName(
        test_map.filter(F.col("test_path").isNotNull()).select(REPO, F.col("test_path").alias("path"), "module"))
    known = both.groupBy(REPO, "path").agg(F.max("module").alias("_module"))
    return changes.join(known, [REPO, "path"], "left").withColumn(
        "module", F.coalesce("_module", module_of(F.col("path"), "change"))).drop("_module")


def module_status(modules: DataFrame, stale: DataFrame, tests: DataFrame) -> DataFrame:
    """Modules with document and audit staleness and test counters.

    ``modules``: repo_id, path, enable_doc, enable_audit. ``stale``: repo_id, path. ``tests``:
    repo_id, path (source), status; each source counts for its most specific module.
    """
    rules = modules.select(REPO, F.col("path").alias("rule_path"))
    per = longest_prefix_join(tests, rules).filter(F.col("rule_path").isNotNull())
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = per.groupBy(REPO, F.col("rule_path").alias("path")).agg(
        F.count(F.lit(1)).alias("total"), n("covered"), n("untested"), n("stale"))
    flag = stale.select(REPO, "path").distinct().withColumn("_stale", F.lit(True))
    rows = modules.join(flag, [REPO, "path"], "left").join(counts, [REPO, "path"], "left")
    on = F.coalesce("_stale", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return rows.select(
        REPO, "path", "enable_doc", "enable_audit", (F.col("enable_doc") & on).alias("stale_doc"),
        (F.col("enable_audit") & on).alias("stale_audit"), (zero("stale") > 0).alias("stale_test"),
        *[zero(c).alias(f"test_{c}") for c in ("total", "covered", "untested", "stale")])


def child_edges(modules: DataFrame) -> DataFrame:
    """(repo_id, parent, child): each module depends on the modules directly below it in the set."""
    dirs = modules.select(REPO, F.col("path").alias("dir")).distinct()
    near = nearest_owner(dirs.filter(F.col("dir") != "."), dirs, include_self=False, owner="parent")
    return near.select(REPO, "parent", F.col("dir").alias("child"))
