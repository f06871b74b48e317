"""Paths, policies, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from repotide.catalog.registry import query
from repotide.fixtures import table
from repotide.functions import globs, paths
from repotide.operators import filters
from repotide.functions.text import older_than

INCLUDE = ["small/**", "large/**"]
IGNORE = ["**/brand_1/**"]
_TEST = "(path LIKE '%.test.%')"
_CODE = "(path LIKE '%.js' OR path LIKE '%.py')"


@query("b01_glob_anchored", """SELECT repo_id, path FROM fx_files
 WHERE regexp_matches(path, '^(?:.*/)?brand_[^/]*/deep(/|$)') OR regexp_matches(path, '^small/.*(/|$)')""")
def _(spark, sf):
    return table(spark, sf, "fx_files").filter(
        globs.glob_match(F.col("path"), ["**/brand_*/deep", "small/**"])).select("repo_id", "path")


@query("b02_glob_simple", """SELECT repo_id, path FROM fx_files
 WHERE regexp_matches(path, '^large/brand_1[^/]*(/|$)') OR regexp_matches(path, '^promo/[^/]*/deep/f[^/]*\\.js(/|$)')""")
def _(spark, sf):
    return table(spark, sf, "fx_files").filter(
        globs.glob_match(F.col("path"), ["large/brand_1*", "promo/*/deep/f*.js"], "simple")).select("repo_id", "path")


@query("b03_glob_full", """SELECT repo_id, dir, path FROM fx_files
 WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '^[^/]*\\.test\\.js$') OR path LIKE 'medium/brand_2/%'
   OR regexp_matches(path, '^economy/.*/deep/[^/]*\\.py$')""")
def _(spark, sf):
    return table(spark, sf, "fx_files").filter(
        globs.glob_match(F.col("path"), ["*.test.js", "medium/brand_2/**", "economy/**/deep/*.py"], "full")
    ).select("repo_id", "dir", "path")


@query("b04_path_policy", """SELECT repo_id, path FROM fx_files
 WHERE (path LIKE 'small/%' OR path LIKE 'large/%') AND path NOT LIKE '%/brand_1/%'""".replace("brand_1", "brand\\_1").replace(
    "%/brand\\_1/%'", "%/brand\\_1/%' ESCAPE '\\'"))
def _(spark, sf):
    return filters.apply_path_policy(table(spark, sf, "fx_files"), INCLUDE, IGNORE).select("repo_id", "path")


@query("b04_repo_policies", """SELECT f.repo_id, f.path FROM fx_files f WHERE CASE f.repo_id
   WHEN 'r0' THEN f.path LIKE 'small/%' WHEN 'r1' THEN f.path NOT LIKE '%/deep/%'
   WHEN 'r2' THEN (f.path LIKE 'large/%' OR f.path LIKE 'promo/%') AND f.path NOT LIKE '%/deep/%' ELSE true END""")
def _(spark, sf):
    policies = spark.createDataFrame(
        [("r0", "include", "small/**"), ("r1", "ignore", "**/deep/**"), ("r2", "include", "large/**"),
         ("r2", "include", "promo/**"), ("r2", "ignore", "**/deep/**")], "repo_id string, kind string, pattern string")
    return filters.apply_repo_policies(table(spark, sf, "fx_files"), policies).select("repo_id", "path")


@query("b05_include_scope", """SELECT DISTINCT repo_id, dir,
   (dir LIKE 'small/brand\\_3%' ESCAPE '\\' OR dir = 'large' OR dir LIKE 'large/%' OR starts_with('small/brand_3*', dir || '/')
     OR starts_with('large/**', dir || '/')) AS can_enter,
   (dir LIKE 'small/brand\\_3%' ESCAPE '\\' OR dir LIKE 'large/%') AS should_count
 FROM (SELECT repo_id, dir FROM fx_files UNION ALL SELECT repo_id, split_part(dir, '/', 1) FROM fx_files)""")
def _(spark, sf):
    files = table(spark, sf, "fx_files").select("repo_id", "dir")
    dirs = files.union(files.select("repo_id", F.split_part("dir", F.lit("/"), F.lit(1)))).distinct()
    enter, count = globs.include_scope(F.col("dir"), ["small/brand_3*", "large/**"])
    return dirs.select("repo_id", "dir", enter.alias("can_enter"), count.alias("should_count"))


@query("b06_scope_filter", "SELECT repo_id, path FROM fx_files WHERE path = 'promo/brand_7' OR starts_with(path, 'promo/brand_7/')")
def _(spark, sf):
    return table(spark, sf, "fx_files").filter(paths.in_scope(F.col("path"), "promo/brand_7")).select("repo_id", "path")


@query("b07_file_kind", f"""SELECT repo_id, CASE WHEN {_CODE} AND {_TEST} THEN 'test' WHEN {_CODE} THEN 'code' WHEN path LIKE '%.md' THEN 'doc'
   ELSE 'other' END AS kind, count(*) AS files FROM fx_files GROUP BY 1, 2""")
def _(spark, sf):
    return table(spark, sf, "fx_files").groupBy("repo_id", paths.file_kind(F.col("path")).alias("kind")).agg(
        F.count(F.lit(1)).alias("files"))


@query("b08_directory_exclusion", """SELECT repo_id, path FROM fx_files
 WHERE NOT list_contains(string_split(dir, '/'), 'deep') AND NOT list_contains(string_split(dir, '/'), 'promo')""")
def _(spark, sf):
    return table(spark, sf, "fx_files").filter(
        paths.not_excluded(F.col("path"), ["deep", "promo"])).select("repo_id", "path")


@query("b09_module_type", """SELECT p_partkey, CASE WHEN p_size <= 8 THEN 'feature' WHEN p_size <= 16 THEN 'component' WHEN p_size <= 24 THEN 'service'
   WHEN p_size <= 32 THEN 'utility' WHEN p_size <= 40 THEN 'package' WHEN p_size <= 45 THEN 'app' END AS module_type FROM part""")
def _(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size")
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    path = (F.when(size <= 8, F.concat(F.lit("src/modules/"), name)).when(size <= 16, F.concat(F.lit("src/components/"), name))
            .when(size <= 24, F.concat(F.lit("src/api/"), name)).when(size <= 32, F.lit("src/lib"))
            .when(size <= 40, F.concat(F.lit("packages/"), name)).when(size <= 45, F.concat(F.lit("apps/"), name))
            .otherwise(F.concat(F.lit("src/modules/"), name, F.lit("/inner"))))
    return p.select("p_partkey", paths.module_type(path).alias("module_type"))


@query("b10_test_type", """SELECT repo_id, file_id, CASE WHEN path LIKE '%/deep/%' THEN 'e2e' WHEN path LIKE 'promo%' THEN 'integration' ELSE 'unit' END AS test_type
 FROM fx_files""")
def _(spark, sf):
    spec = F.when(F.col("path").contains("/deep/"), F.replace("path", F.lit("/f"), F.lit("/e2e/f"))).when(
        F.col("path").startswith("promo"), F.replace("path", F.lit("/f"), F.lit("/a.int.f"))).otherwise(F.col("path"))
    return table(spark, sf, "fx_files").select("repo_id", "file_id", paths.test_type(spec).alias("test_type"))


@query("b30_norm_path", """SELECT file_id, dir || '/x.js' AS kept, regexp_replace(dir, '/[^/]*$', '') || '/y' AS up, '.' AS empty,
   '../' || path AS above FROM fx_files""")
def _(spark, sf):
    d, p = F.col("dir"), F.col("path")
    return table(spark, sf, "fx_files").select(
        "file_id",
        paths.norm_path(F.concat(F.lit(".\\"), F.replace(d, F.lit("/"), F.lit("\\")), F.lit("//./x.js/"))).alias("kept"),
        paths.norm_path(F.concat(d, F.lit("/../y/"))).alias("up"),
        paths.norm_path(F.concat(F.lit("./"), d, F.regexp_replace(F.concat(F.lit("/"), d), "/[^/]+", "/.."))).alias("empty"),
        paths.norm_path(F.concat(F.lit("a/../../"), p)).alias("above"))


@query("b31_graph_keys", """SELECT repo_id, file_id, CASE WHEN path LIKE 'small/%' THEN substr(path, 7) ELSE path END AS graph_key,
   'small/' || path AS project_path FROM fx_files""")
def _(spark, sf):
    p = F.col("path")
    return table(spark, sf, "fx_files").select(
        "repo_id", "file_id", paths.to_graph_key(p, "small").alias("graph_key"),
        paths.to_project_path(p, "small").alias("project_path"))


@query("b32_module_of", """SELECT file_id, split_part(path, '/', 1) AS first, split_part(path, '/', 1) AS root,
   split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) AS two,
   'js/agents/' || split_part(path, '/', 1) AS layered, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS scoped,
   CASE WHEN path LIKE '%.test.%' THEN 'js/' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE 'other' END AS changed
 FROM fx_files""")
def _(spark, sf):
    p = F.col("path")
    tested = F.when(p.contains(".test."), F.concat(F.lit("tests/unit/"), p)).otherwise(p)
    scope = F.split_part("path", F.lit("/"), F.lit(1))
    scoped = F.lit(None)
    for name in ("standard", "small", "promo", "large", "economy", "medium"):
        scoped = F.when(scope == name, paths.module_of(p, "scope", name)).otherwise(scoped)
    return table(spark, sf, "fx_files").select(
        "file_id", paths.module_of(p, "first").alias("first"), paths.module_of(p, "root").alias("root"),
        paths.module_of(F.col("dir"), "two").alias("two"),
        paths.module_of(F.concat(F.lit("js/agents/"), p), "layered").alias("layered"),
        scoped.alias("scoped"), paths.module_of(tested, "change").alias("changed"))


@query("b33_affected_packages", """SELECT repo_id, CASE WHEN path LIKE 'small/%' THEN 'packages/' || split_part(dir, '/', 2)
   ELSE 'src/modules/' || split_part(dir, '/', 1) END AS package, count(*) AS files FROM fx_files GROUP BY 1, 2""")
def _(spark, sf):
    p = F.col("path")
    moved = F.when(p.startswith("small/"), F.concat(F.lit("packages/"), F.substr("path", F.lit(7)))).otherwise(
        F.concat(F.lit("src/modules/"), p))
    return table(spark, sf, "fx_files").groupBy("repo_id", paths.package_of(moved).alias("package")).agg(
        F.count(F.lit(1)).alias("files"))


@query("b34_path_depth", "SELECT file_id, len(string_split(path, '/')) AS depth FROM fx_files")
def _(spark, sf):
    return table(spark, sf, "fx_files").select("file_id", paths.path_depth(F.col("path")).cast("bigint").alias("depth"))


@query("b35_ancestors", """SELECT file_id, array_to_string(CASE len(string_split(dir, '/'))
   WHEN 2 THEN [split_part(dir, '/', 1), '.'] ELSE [split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2), split_part(dir, '/', 1), '.'] END, '|') AS ancestors
 FROM fx_files""")
def _(spark, sf):
    return table(spark, sf, "fx_files").select(
        "file_id", F.array_join(paths.ancestors(F.col("dir")), "|").alias("ancestors"))


@query("b36_expected_test_path", """WITH b AS (SELECT file_id, dir, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM fx_files)
 SELECT file_id, 'tests/' || dir || '/' || stem || '.test.js' AS mirrored, 'tests/unit/' || dir || '/' || stem || '.test.js' AS unit,
   'tests/integration/' || dir || '/' || stem || '.test.js' AS integration, 'tests/e2e/' || dir || '/' || stem || '.e2e.test.js' AS e2e,
   'spec/' || dir || '/' || stem || '_spec.js' AS named FROM b""")
def _(spark, sf):
    p = F.concat(F.lit("js/"), F.col("path"))
    return table(spark, sf, "fx_files").select(
        "file_id", *[paths.expected_test_path(p, k).alias(k) for k in ("mirrored", "unit", "integration", "e2e")],
        paths.expected_test_path(p, "naming", naming="{name}_spec.js", test_root="spec").alias("named"))


@query("b37_expected_source_path", """SELECT file_id, 'js/' || replace(path, '.test.js', '.js') AS mirrored,
  'js/' || replace(path, '.test.js', '.js') AS typed FROM fx_files WHERE path LIKE '%.test.js'""")
def _(spark, sf):
    tests = table(spark, sf, "fx_files").filter(F.col("path").endswith(".test.js"))
    return tests.select(
        "file_id", paths.expected_source_path(F.concat(F.lit("tests/"), F.col("path"))).alias("mirrored"),
        paths.expected_source_path(F.concat(F.lit("tests/unit/"), F.col("path")), layout="typed").alias("typed"))


@query("b38_test_policy", """SELECT repo_id, path FROM fx_files WHERE path LIKE 'small/brand\\_3/%' ESCAPE '\\' AND path NOT LIKE '%/deep/%'""")
def _(spark, sf):
    include, ignore = globs.test_policy(["js/small/brand_3/**"], ["tests/**", "**/*.test.js", "**/deep/**"])
    tests = table(spark, sf, "fx_files").withColumn("path", F.concat(F.lit("tests/unit/"), F.col("path")))
    kept = filters.apply_path_policy(tests, include, ignore, dialect="full")
    return kept.select("repo_id", F.replace("path", F.lit("tests/unit/"), F.lit("")).alias("path"))


@query("b11_status_filter", "SELECT task_id, status FROM fx_tasks WHERE status IN ('failed', 'pending')")
def _(spark, sf):
    return filters.filter_status(table(spark, sf, "fx_tasks"), "failed", "pending").select("task_id", "status")


@query("b13_issue_filter", """SELECT repo_id, dir, severity, issue_count FROM fx_audit_dirs WHERE severity = 'high' AND contains(dir, 'brand_1')""")
def _(spark, sf):
    dirs = table(spark, sf, "fx_audit_dirs").withColumn("module", F.col("dir"))
    return filters.filter_issues(dirs, "high", "BRAND_1").select(
        "repo_id", "dir", "severity", F.col("issue_count").cast("bigint").alias("issue_count"))


@query("b14_errors_by_file", """SELECT run_id, test_path, message FROM fx_test_results WHERE status = 'failed' AND contains(lower(test_path), '/brand_1')""")
def _(spark, sf):
    errors = table(spark, sf, "fx_test_results").filter("status = 'failed'").withColumn("source_path", F.lit(None).cast("string"))
    return filters.errors_for(errors, "/Brand_1").select("run_id", "test_path", "message")


@query("b15_error_by_id", """WITH e AS (SELECT repo_id, run_id, test_path, message, row_number() OVER (PARTITION BY repo_id ORDER BY ts, run_id, test_id) AS id
   FROM fx_test_results WHERE status = 'failed') SELECT * FROM e WHERE id = 3""")
def _(spark, sf):
    from repotide.operators.windows import number_rows
    errors = table(spark, sf, "fx_test_results").filter("status = 'failed'")
    ids = number_rows(errors, ["repo_id"], [F.col("ts"), F.col("run_id"), F.col("test_id")], "id")
    return filters.error_by_id(ids, 3).select("repo_id", "run_id", "test_path", "message", "id")


@query("b16_board_list", "SELECT project_id, task_id, priority FROM fx_board WHERE status = 'todo' AND priority = 1")
def _(spark, sf):
    return filters.board_list(table(spark, sf, "fx_board"), "todo", 1).select("project_id", "task_id", "priority")


@query("b17_id_prefix", """WITH p AS (SELECT DISTINCT substr(CAST(o_orderkey AS VARCHAR), 1, 3) AS prefix FROM orders UNION ALL SELECT 'zz'),
 m AS (SELECT p.prefix, count(t.task_id) AS matches, min(t.task_id) AS one FROM p LEFT JOIN fx_board t ON starts_with(CAST(t.task_id AS VARCHAR), p.prefix)
   GROUP BY p.prefix)
 SELECT prefix, matches, CASE matches WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS state,
   CASE matches WHEN 1 THEN CAST(one AS VARCHAR) END AS task_id FROM m""")
def _(spark, sf):
    tasks = table(spark, sf, "fx_board").select(F.col("task_id").cast("string").alias("task_id"))
    wanted = tasks.select(F.substring("task_id", 1, 3).alias("prefix")).distinct().union(
        spark.createDataFrame([("zz",)], "prefix string"))
    return filters.resolve_prefix(tasks, wanted)


@query("b18_operations_filter", "SELECT task_id, task_name, status FROM fx_tasks WHERE status IN ('failed', 'timeout', 'cancelled') AND task_name = 'task_2'")
def _(spark, sf):
    return filters.ops_filter(table(spark, sf, "fx_tasks"), "failed", "task_2").select("task_id", "task_name", "status")


@query("b19_retry_candidates", "SELECT task_id, status, 1 AS retry_count FROM fx_tasks WHERE status IN ('failed', 'timeout')")
def _(spark, sf):
    state = table(spark, sf, "fx_tasks").withColumn("retry_count", F.lit(0))
    return filters.retry_candidates(state).select("task_id", "status", "retry_count")


@query("b21_older_than", """SELECT task_id, updated_at < (SELECT max(updated_at) FROM fx_tasks) - INTERVAL 24 HOUR AS expired FROM fx_tasks""")
def _(spark, sf):
    tasks = table(spark, sf, "fx_tasks")
    now = tasks.agg(F.max("updated_at").alias("now"))
    return tasks.join(F.broadcast(now)).select(  # one row
        "task_id", older_than(F.col("updated_at"), "24 HOURS", F.col("now")).alias("expired"))


@query("b22_due_on", "SELECT project_id, task_id FROM fx_board WHERE CAST(due_at AS DATE) = DATE '1996-05-05'")
def _(spark, sf):
    return filters.due_on(table(spark, sf, "fx_board"), "1996-05-05", "due_at").select("project_id", "task_id")
