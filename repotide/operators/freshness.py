"""Freshness and coverage of documents, audits and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repotide.functions.globs import glob_match
from repotide.functions.paths import (
    ancestors, base_name, dir_name, expected_test_path, file_kind, is_source, module_of, path_depth)
from repotide.functions.text import percent
from repotide.operators.joins import changed_since, longest_prefix_join, merge_modules, missing, nearest_owner, own_files
from repotide.operators.windows import keep_last
from repotide.session import REPO

LARGE_FILES = 5
LARGE_LINES = 200


def _code(files: DataFrame) -> DataFrame:
    return files.filter(file_kind(F.col("path")).isin("code", "test"))


def _newest(ts: str = "mtime", path: str = "path") -> Column:
    """Path of the newest file, the smallest path among equals."""
    return F.min_by(path, F.struct(-F.unix_micros(F.col(ts).cast("timestamp")), F.col(path)))


def doc_freshness(files: DataFrame, docs: DataFrame, ignore=()) -> DataFrame:
    """Each document directory: newest code it owns, number of newer files, stale / fresh / missing.

    A directory without code is fresh; a null ``doc_mtime`` means the document is missing.
    """
    code = _code(files)
    if list(ignore):
        code = code.filter(~glob_match(F.col("path"), ignore, "simple"))
    newer = F.col("mtime") > F.col("doc_mtime")
    per_doc = own_files(code, docs).groupBy(REPO, F.col("owner").alias("dir")).agg(
        F.max("mtime").alias("code_mtime"), _newest().alias("newest_file"), F.count_if(newer).alias("changed"))
    present = F.col("doc_mtime").isNotNull()
    status = (F.when(~present, "missing").when(F.col("code_mtime") > F.col("doc_mtime"), "stale").otherwise("fresh"))
    return docs.join(per_doc, [REPO, "dir"], "left").select(
        REPO, "dir", status.alias("status"), "doc_mtime", F.when(present, F.col("code_mtime")).alias("code_mtime"),
        F.when(present, F.col("newest_file")).alias("newest_file"), F.coalesce("changed", F.lit(0).cast("bigint")).alias("changed"))


def changed_files(files: DataFrame, docs: DataFrame) -> DataFrame:
    """The files behind ``changed``: one row per file newer than its document."""
    return changed_since(own_files(_code(files), docs)).select(REPO, F.col("owner").alias("dir"), "path", "mtime")


def subtree_newest(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Newest file anywhere below each module; directories are reduced before they are exploded."""
    per_dir = files.groupBy(REPO, "dir").agg(
        F.max("mtime").alias("mtime"), _newest().alias("newest_file"))
    up = per_dir.select(REPO, "mtime", "newest_file", F.explode(ancestors(F.col("dir"), True)).alias("path"))
    return up.join(modules.select(REPO, "path").distinct(), [REPO, "path"], "left_semi").groupBy(REPO, "path").agg(
        F.max("mtime").alias("code_mtime"), _newest("mtime", "newest_file").alias("newest_file"))


def module_freshness(modules: DataFrame, files: DataFrame, docs: DataFrame, now: Column) -> DataFrame:
    """Stale modules of a module list: ``outdated`` with the document's age, or ``missing`` when the
    module wants a document (``enable_doc``) and has none."""
    rows = modules.join(subtree_newest(_code(files), modules), [REPO, "path"], "left").join(
        docs.select(REPO, F.col("dir").alias("path"), "doc_mtime"), [REPO, "path"], "left")
    kind = (F.when(F.col("doc_mtime").isNull() & F.col("enable_doc"), "missing")
            .when(F.col("code_mtime") > F.col("doc_mtime"), "outdated"))
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("doc_mtime").cast("timestamp"))) / 1000)
    return rows.select(REPO, "path", kind.alias("type"), F.when(kind == "outdated", age).alias("doc_age_ms"),
                       F.when(kind == "outdated", F.col("newest_file")).alias("newest_file")).filter("type IS NOT NULL")


def test_status(sources: DataFrame, test_map: DataFrame) -> DataFrame:
    """Each source ``untested``, ``stale`` (newer than its newest test) or ``covered``."""
    newest = test_map.groupBy(REPO, F.col("source_path").alias("path")).agg(
        F.max("test_mtime").alias("test_mtime"), F.countDistinct("test_path").alias("tests"))
    status = (F.when(F.col("tests").isNull(), "untested").when(F.col("mtime") > F.col("test_mtime"), "stale")
              .otherwise("covered"))
    return sources.join(newest, [REPO, "path"], "left").select(
        REPO, "path", status.alias("status"), F.coalesce("tests", F.lit(0).cast("bigint")).alias("tests"),
        F.col("mtime").alias("source_mtime"), "test_mtime")


def _buckets() -> list[Column]:
    n = lambda s: F.count_if(F.col("status") == s)
    return [F.count(F.lit(1)).alias("total"), *[n(s).alias(s) for s in ("covered", "stale", "untested")],
            percent(n("covered"), F.count(F.lit(1)), 1).alias("coverage")]


def module_coverage(status: DataFrame, rule: str = "layered") -> DataFrame:
    """Test coverage per module, one decimal; only ``covered`` counts."""
    return status.groupBy(REPO, module_of(F.col("path"), rule).alias("module")).agg(*_buckets())


def coverage_summary(status: DataFrame) -> DataFrame:
    return status.groupBy(REPO).agg(*_buckets())


def module_test_freshness(coverage: DataFrame) -> DataFrame:
    """Module verdict from its test buckets; ``missing`` is decided before ``stale``."""
    verdict = (F.when((F.col("untested") > 0) & (F.col("covered") == 0), "missing")
               .when(F.col("stale") > 0, "stale").otherwise("fresh"))
    return coverage.withColumn("status", verdict)


def dir_stats(files: DataFrame, large_files: int = LARGE_FILES, large_lines: int = LARGE_LINES) -> DataFrame:
    """Source files (tests excluded) and lines per directory, and whether that is large."""
    return files.filter(is_source(F.col("path"))).groupBy(REPO, "dir").agg(
        F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines")).withColumn(
        "is_large", (F.col("files") >= large_files) | (F.col("lines") >= large_lines))


def large_dirs(stats: DataFrame) -> DataFrame:
    """Large directories, most lines first."""
    return stats.filter("is_large").orderBy(F.col("lines").desc(), REPO, "dir")


def effective_coverage(stats: DataFrame, docs: DataFrame) -> DataFrame:
    """Documentation coverage per repository: directories with a document, large ones without,
    small ones covered by a documented ancestor, small orphans; effective and actual percent."""
    has = docs.select(REPO, "dir").distinct().withColumn("has_doc", F.lit(True))
    dirs = stats.join(has, [REPO, "dir"], "left").withColumn("has_doc", F.coalesce("has_doc", F.lit(False)))
    documented = dirs.filter("has_doc")
    covered = nearest_owner(dirs.filter(~F.col("has_doc")), documented, include_self=False)
    rows = dirs.join(covered, [REPO, "dir"], "left")
    kind = (F.when(F.col("has_doc"), "with").when(F.col("is_large"), "large")
            .when(F.col("owner").isNotNull(), "covered").otherwise("orphan"))
    n = lambda k: F.count_if(kind == k)
    return rows.groupBy(REPO).agg(
        n("with").alias("with_doc"), n("large").alias("large_missing"), n("covered").alias("small_covered"),
        n("orphan").alias("small_orphan"), percent(n("with"), n("with") + n("large")).alias("effective_percent"),
        percent(n("with"), F.count(F.lit(1))).alias("actual_percent"))


def index_worklist(stats: DataFrame, docs: DataFrame) -> DataFrame:
    """Directories that need an index: ``create`` (large, no document) and ``update`` (documented,
    with small undocumented directories below, down to the next document)."""
    bare = missing(stats, docs, [REPO, "dir"])
    create = bare.filter("is_large").select(
        REPO, "dir", F.lit("create").alias("action"), F.lit(None).cast("bigint").alias("small_children"), "files", "lines")
    near = nearest_owner(bare.filter(~F.col("is_large")), docs, include_self=False)
    none = F.lit(None).cast("bigint")
    update = near.groupBy(REPO, F.col("owner").alias("dir")).agg(F.count(F.lit(1)).alias("small_children")).select(
        REPO, "dir", F.lit("update").alias("action"), "small_children", none.alias("files"), none.alias("lines"))
    return create.unionByName(update)


def all_dirs(files: DataFrame) -> DataFrame:
    """Every directory of an inventory, intermediate ones included (``.`` left out)."""
    dirs = files.select(REPO, "dir").distinct()
    return dirs.select(REPO, F.explode(ancestors(F.col("dir"), True)).alias("dir")).filter(
        F.col("dir") != ".").distinct()


def small_unaudited(files: DataFrame, stats: DataFrame, audits: DataFrame) -> DataFrame:
    """Directories below both size limits without an audit, with the parent that could cover them."""
    dirs = missing(all_dirs(files), audits, [REPO, "dir"]).join(stats, [REPO, "dir"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return dirs.select(REPO, dir_name(F.col("dir")).alias("parent"), "dir", zero("files").alias("files"),
                       zero("lines").alias("lines")).filter(
        (F.col("files") < LARGE_FILES) & (F.col("lines") < LARGE_LINES))


def audit_status(modules: DataFrame, files: DataFrame, audits: DataFrame) -> DataFrame:
    """Audit state of documented directories: never, clean (no issues), stale, fresh.

    ``modules``: repo_id, dir. ``audits``: repo_id, dir, audit_mtime, severity, issue_count. Only
    source files of the directory itself count.
    """
    own = files.filter(is_source(F.col("path"))).groupBy(REPO, "dir").agg(
        F.max("mtime").alias("code_mtime"), _newest().alias("newest_file"), F.count(F.lit(1)).alias("file_count"))
    rows = modules.select(REPO, "dir").distinct().join(audits, [REPO, "dir"], "left").join(own, [REPO, "dir"], "left")
    status = (F.when(F.col("audit_mtime").isNull(), "never").when(F.coalesce("issue_count", F.lit(0)) == 0, "clean")
              .when(F.col("code_mtime") > F.col("audit_mtime"), "stale").otherwise("fresh"))
    return rows.select(REPO, "dir", status.alias("status"), "severity", F.col("issue_count").cast("bigint").alias("issue_count"),
                       "audit_mtime", "code_mtime", F.coalesce("file_count", F.lit(0).cast("bigint")).alias("file_count"))


AUDIT_ORDER = {"never": 0, "stale": 1, "fresh": 2, "clean": 3}
AUDIT_SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "unknown": 4}


def audit_stats(status: DataFrame) -> DataFrame:
    """Counts per state and per severity (not for ``never``), issues and files per repository."""
    done = F.col("status") != "never"
    return status.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in AUDIT_ORDER],
        *[F.count_if(done & (F.col("severity") == s)).alias(s) for s in ("critical", "high", "medium", "low")],
        F.coalesce(F.sum("issue_count"), F.lit(0).cast("bigint")).alias("total_issues"), F.sum("file_count").alias("total_files"))


def dir_coverage(files: DataFrame, status: DataFrame) -> DataFrame:
    """Source files discovered and covered by audit modules per two-segment top directory."""
    top = module_of(F.col("dir"), "two").alias("top_dir")
    found = files.filter(is_source(F.col("path")) & (F.col("dir") != ".")).groupBy(REPO, top).agg(
        F.count(F.lit(1)).alias("discovered"))
    audited = status.filter(F.col("dir") != ".").groupBy(REPO, top).agg(F.sum("file_count").alias("audited"))
    rows = found.join(audited, [REPO, "top_dir"], "left").withColumn("audited", F.coalesce("audited", F.lit(0).cast("bigint")))
    return rows.withColumn("coverage_percent", percent(F.col("audited"), F.col("discovered")))


def rule_coverage(modules: DataFrame, rules: DataFrame) -> DataFrame:
    """Modules and audited share per most specific directory rule (``.`` without one)."""
    rows = longest_prefix_join(modules, rules)
    n = F.count_if("enable_audit")
    return rows.groupBy(REPO, F.coalesce("rule_path", F.lit(".")).alias("rule_path")).agg(
        F.count(F.lit(1)).alias("discovered"), n.alias("audited"), percent(n, F.count(F.lit(1))).alias("coverage_percent"))


def _module_rows(df: DataFrame, status: str, doc: bool | None, audit: bool | None, changed=None) -> DataFrame:
    flag = lambda v: F.lit(v).cast("boolean")
    return df.select(REPO, F.col("dir").alias("path"), F.lit(status).alias("status"),
                     (F.lit(0) if changed is None else F.col(changed)).cast("bigint").alias("changed"),
                     flag(doc).alias("want_doc"), flag(audit).alias("want_audit"))


def modules_by_mode(mode: str, files: DataFrame, docs: DataFrame, audits: DataFrame,
                    doc: bool = True, audit: bool = True) -> DataFrame:
    """Module work list: ``stale`` documents, ``missing`` artefacts, ``all`` of both, or ``force``
    (every large directory)."""
    stats = dir_stats(files)
    if mode == "force":
        return _module_rows(stats.filter("is_large"), "force", None, None)
    lists = []
    if mode in ("stale", "all"):
        lists.append(_module_rows(doc_freshness(files, docs).filter("status = 'stale'"), "stale", True, None, "changed"))
    if mode in ("missing", "all"):
        if doc:
            lists.append(_module_rows(missing(stats.filter("is_large"), docs, [REPO, "dir"]), "missing_doc", True, None))
        if audit:
            lists.append(_module_rows(missing(docs.select(REPO, "dir"), audits, [REPO, "dir"]), "missing_audit", None, True))
    if not lists:  # nothing was asked for
        return _module_rows(stats.limit(0), mode, None, None)
    return merge_modules(*lists)


def newest_sources(files: DataFrame, doc_scope: str = "") -> DataFrame:
    """Newest source per repository and artefact: ``deps`` (sources), ``test`` (sources and tests),
    ``doc`` (sources below ``doc_scope``), with the number of files looked at."""
    kind = file_kind(F.col("path"))
    targets = F.array_compact(F.array(
        F.when(kind == "code", "deps"), F.when(kind.isin("code", "test"), "test"),
        F.when((kind == "code") & F.col("path").startswith(doc_scope), "doc")))
    return files.select(REPO, "path", "mtime", F.explode(targets).alias("target")).groupBy(REPO, "target").agg(
        F.max("mtime").alias("source_mtime"), _newest().alias("newest_source"), F.count(F.lit(1)).alias("scanned"))


def merge_newest(parts: DataFrame) -> DataFrame:
    """``newest_sources`` of several inventories as one."""
    return parts.groupBy(REPO, "target").agg(
        _newest("source_mtime", "newest_source").alias("newest_source"), F.max("source_mtime").alias("source_mtime"),
        F.sum("scanned").alias("scanned"))


def judge_artefacts(artefacts: DataFrame, newest: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Artefacts older than their newest source or the configuration, with the reason.

    ``artefacts``: repo_id, target, generated_at (null when absent). ``config``: repo_id,
    config_mtime; a newer configuration makes everything stale.
    """
    rows = artefacts.join(newest, [REPO, "target"], "left")
    if config is not None:
        rows = rows.join(config, REPO, "left")
    else:
        rows = rows.withColumn("config_mtime", F.lit(None).cast(newest.schema["source_mtime"].dataType))
    by_config = F.coalesce(F.col("config_mtime") > F.col("source_mtime"), F.col("source_mtime").isNull() & F.col("config_mtime").isNotNull())
    latest = F.greatest("source_mtime", "config_mtime")
    absent = F.col("generated_at").isNull()
    stale = absent | F.coalesce(latest > F.col("generated_at"), F.lit(False))
    is_doc = F.col("target") == "doc"
    reason = (F.when(absent, F.when(is_doc, "doc_missing").otherwise("cache_missing"))
              .when(stale, F.when(is_doc, "source_newer_than_doc").otherwise("source_newer_than_cache")).otherwise("fresh"))
    return rows.select(REPO, "target", stale.alias("stale"), reason.alias("reason"),
                       F.when(by_config, "config").otherwise("file").alias("newest_kind"),
                       F.when(~by_config, F.col("newest_source")).alias("newest_source"), latest.alias("newest_mtime"),
                       F.coalesce("scanned", F.lit(0).cast("bigint")).alias("scanned"))


def artefact_staleness(files: DataFrame, artefacts: DataFrame, config: DataFrame | None = None, doc_scope: str = "") -> DataFrame:
    """Whether the dependency graph (``deps``), test map (``test``) and root document (``doc``) are
    older than what they were built from, with the newest source."""
    return judge_artefacts(artefacts, newest_sources(files, doc_scope), config)


def kpi(module_rows: DataFrame, test_rows: DataFrame) -> DataFrame:
    """One status row per repository over ``module_status`` rows and per-source test states."""
    wanted = lambda k: F.count_if(F.col(f"enable_{k}"))
    stale = lambda k: F.count_if(F.col(f"stale_{k}"))
    modules = module_rows.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("modules"), *[e for k in ("doc", "audit") for e in (
            wanted(k).alias(f"{k}_total"), stale(k).alias(f"{k}_stale"),
            F.greatest(wanted(k) - stale(k), F.lit(0)).cast("bigint").alias(f"{k}_fresh"))])
    n = lambda s: F.count_if(F.col("status") == s)
    tests = test_rows.groupBy(REPO).agg(
        F.count(F.lit(1)).alias("test_total"), *[n(s).alias(f"test_{s}") for s in ("covered", "stale", "untested")],
        percent(n("covered"), F.count(F.lit(1))).alias("coverage_percent"))
    return modules.join(tests, REPO, "left")


def module_buckets(modules: DataFrame, tests: DataFrame) -> DataFrame:
    """Test counters per module and a TOTAL row per repository."""
    rows = longest_prefix_join(tests, modules.select(REPO, F.col("path").alias("rule_path"))).filter("rule_path IS NOT NULL")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = rows.rollup(REPO, "rule_path").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"),
                                             n("covered"), n("untested"), n("stale"))
    return out.filter("_g < 3").withColumn("module", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("rule_path"))).drop(
        "_g", "rule_path")


def module_inventory(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Every directory as a module: direct files, index, document, core files, subdirectories, tests, types."""
    name, kind = base_name(F.col("path")), file_kind(F.col("path"))
    core = name.rlike(r"\.(ts|js|tsx|jsx|py|go|rs)$") & (kind == "code")
    own = files.groupBy(REPO, "dir").agg(
        F.count_if(~name.startswith(".")).alias("files"), F.bool_or(name.rlike(r"^index\.(ts|js|tsx|jsx|py)$")).alias("has_index"),
        F.count_if(core).alias("core_files"), F.bool_or(name.contains(".test.") | name.contains(".spec.")).alias("has_tests"),
        F.bool_or(name.endswith(".d.ts") | (name == "types.ts")).alias("has_types"))
    dirs = all_dirs(files)
    below = dirs.groupBy(REPO, dir_name(F.col("dir")).alias("dir")).agg(F.count(F.lit(1)).alias("submodules"))
    documented = docs.select(REPO, "dir").distinct().withColumn("has_doc", F.lit(True))
    rows = dirs.join(own, [REPO, "dir"], "left").join(below, [REPO, "dir"], "left").join(documented, [REPO, "dir"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select(REPO, "dir", zero("files"), zero("core_files"), zero("submodules"),
                       no("has_index"), no("has_doc"), no("has_tests"), no("has_types"))


def common_dir(paths: DataFrame, column: str = "path") -> DataFrame:
    """Longest common directory of include globs or paths per repository."""
    cut = F.regexp_replace(F.regexp_replace(F.split_part(column, F.lit("*"), F.lit(1)), r"^(\./)+", ""), r"/+$", "")
    seg = F.split(F.when(cut.isin("", "."), None).otherwise(cut), "/")
    ends = paths.groupBy(REPO).agg(F.min(seg).alias("_lo"), F.max(seg).alias("_hi"))
    n = F.least(F.size("_lo"), F.size("_hi"))
    # Common prefix of the first and the last in segment order is common to all.
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.get("_lo", i - 1) != F.get("_hi", i - 1))
    shared = F.slice("_lo", F.lit(1), F.coalesce(F.get(differs, F.lit(0)) - 1, n))
    joined = F.array_join(shared, "/")
    return ends.select(REPO, F.when(F.col("_lo").isNull() | (joined == ""), ".").otherwise(joined).alias("common_dir"))


def stale_tree(stale: DataFrame, changed: DataFrame, samples: int = 3) -> DataFrame:
    """Every ancestor of stale modules with the stale modules below it; stale nodes carry up to
    ``samples`` of their newest changed files."""
    up = stale.select(REPO, "dir", F.explode(ancestors(F.col("dir"), True)).alias("node")).filter(F.col("node") != ".")
    nodes = up.groupBy(REPO, "node").agg(
        F.count(F.lit(1)).alias("stale_below"), F.bool_or(F.col("dir") == F.col("node")).alias("is_stale"))
    few = keep_last(changed, [REPO, "dir"], [F.col("mtime").desc(), F.col("path")], samples).groupBy(
        REPO, F.col("dir").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("files"))
    return nodes.join(few, [REPO, "node"], "left").select(
        REPO, "node", path_depth(F.col("node")).alias("depth"), "stale_below", "is_stale",
        F.when(F.col("is_stale"), F.coalesce("files", F.lit(""))).otherwise("").alias("files"))


def testgen_worklist(status: DataFrame, states=("untested",), include=(), ignore=(), path_filter: str | None = None) -> DataFrame:
    """Sources that need a test, deepest first, with the place where it belongs."""
    rows = status.filter(F.col("status").isin(*states))
    if path_filter:
        rows = rows.filter(F.col("path").startswith(path_filter))
    if list(include):
        rows = rows.filter(glob_match(F.col("path"), include))
    if list(ignore):
        rows = rows.filter(~glob_match(F.col("path"), ignore))
    return rows.select(REPO, "path", "status", path_depth(F.col("path")).alias("depth"),
                       expected_test_path(F.col("path")).alias("expected_test")).orderBy(F.col("depth").desc(), REPO, "path")


def scaffold_diff(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """Per source and test type: expected test, the actual one (by name token), missing / stale / covered.

    ``tests``: repo_id, path, mtime, test_type.
    """
    wanted = sources.select(REPO, F.col("path").alias("source_path"), F.col("mtime").alias("source_mtime"), F.explode(
        F.array(*[F.struct(F.lit(t).alias("test_type"), expected_test_path(F.col("path"), t).alias("expected_test"))
                  for t in ("unit", "integration", "e2e")])).alias("w")).select(
        REPO, "source_path", "source_mtime", "w.test_type", "w.expected_test",
        F.regexp_replace(base_name(F.col("source_path")), r"\.js$", "").alias("_name"))
    token = F.explode(F.array_distinct(F.concat(
        F.array(F.regexp_replace(base_name(F.col("path")), r"\..*$", "")), F.split(base_name(F.col("path")), r"[.\-_]"))))
    by_name = tests.select(REPO, "test_type", "path", "mtime", token.alias("_name")).groupBy(REPO, "test_type", "_name").agg(
        F.min(F.struct(F.col("path").alias("actual_test"), F.col("mtime").alias("test_mtime"))).alias("t"))
    rows = wanted.join(by_name, [REPO, "test_type", "_name"], "left")
    status = (F.when(F.col("t").isNull(), "missing").when(F.col("source_mtime") > F.col("t.test_mtime"), "stale").otherwise("covered"))
    return rows.select(REPO, "test_type", "source_path", "expected_test", F.col("t.actual_test").alias("actual_test"), status.alias("status"))


def list_by_status(status: DataFrame, *states: str) -> DataFrame:
    """Module, path, tests of sources in the given states."""
    return status.filter(F.col("status").isin(*states)).select(
        REPO, module_of(F.col("path"), "layered").alias("module"), "path", "status", "tests")


def worst_first(coverage: DataFrame) -> DataFrame:
    """Lowest coverage first."""
    return coverage.orderBy("coverage", REPO, "module")
