"""Joins, freshness and coverage over the inventory views."""

from __future__ import annotations

from pyspark.sql import functions as F

from repotide.catalog.registry import query
from repotide.fixtures import table
from repotide.functions.paths import dir_name, file_kind, is_source
from repotide.operators import audits as audit_ops
from repotide.operators import freshness, joins, windows

CODE = "(path LIKE '%.js' OR path LIKE '%.py')"
TEST = "path LIKE '%.test.%'"
SOURCE = f"({CODE} AND NOT {TEST})"

# Nearest document at or above a file's directory.
OWNED = f"""owned AS (SELECT * FROM (SELECT f.repo_id, f.path, f.mtime, d.dir AS owner, d.doc_mtime,
    row_number() OVER (PARTITION BY f.repo_id, f.path ORDER BY length(d.dir) DESC) AS rn
  FROM fx_files f JOIN fx_docs d ON d.repo_id = f.repo_id AND (f.dir = d.dir OR starts_with(f.dir, d.dir || '/')) WHERE {CODE}) WHERE rn = 1)"""
FRESH = f"""fresh AS (SELECT d.repo_id, d.dir, CASE WHEN max(o.mtime) > d.doc_mtime THEN 'stale' ELSE 'fresh' END AS status, d.doc_mtime,
    max(o.mtime) AS code_mtime, first(o.path ORDER BY o.mtime DESC, o.path) AS newest_file, count(*) FILTER (o.mtime > d.doc_mtime) AS changed
  FROM fx_docs d LEFT JOIN owned o ON o.repo_id = d.repo_id AND o.owner = d.dir GROUP BY d.repo_id, d.dir, d.doc_mtime)"""
STATS = f"""stats AS (SELECT repo_id, dir, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, count(*) >= 5 OR sum(line_count) >= 200 AS is_large
  FROM fx_files WHERE {SOURCE} GROUP BY repo_id, dir)"""
TSTATUS = f"""tstatus AS (SELECT s.repo_id, s.path, CASE WHEN max(m.test_mtime) IS NULL THEN 'untested' WHEN s.mtime > max(m.test_mtime) THEN 'stale' ELSE 'covered' END AS status,
    count(DISTINCT m.test_path) AS tests, s.mtime AS source_mtime, max(m.test_mtime) AS test_mtime
  FROM fx_files s LEFT JOIN fx_test_map m ON m.repo_id = s.repo_id AND m.source_path = s.path WHERE {SOURCE.replace('path', 's.path')} GROUP BY s.repo_id, s.path, s.mtime)"""
ASTATUS = f"""astatus AS (SELECT d.repo_id, d.dir, CASE WHEN a.audit_mtime IS NULL THEN 'never' WHEN a.issue_count = 0 THEN 'clean' WHEN c.code_mtime > a.audit_mtime THEN 'stale' ELSE 'fresh' END AS status,
    a.severity, CAST(a.issue_count AS BIGINT) AS issue_count, a.audit_mtime, c.code_mtime, coalesce(c.file_count, 0) AS file_count
  FROM fx_docs d LEFT JOIN fx_audit_dirs a USING (repo_id, dir)
  LEFT JOIN (SELECT repo_id, dir, max(mtime) AS code_mtime, count(*) AS file_count FROM fx_files WHERE {SOURCE} GROUP BY repo_id, dir) c USING (repo_id, dir))"""
PCT = "CASE WHEN {1} > 0 THEN CAST(floor({0} * 100.0 / {1} + 0.5) AS BIGINT) ELSE 0 END"
PCT1 = "CASE WHEN {1} > 0 THEN CAST(floor({0} * 100.0 * 10 / {1} + 0.5) AS DOUBLE) / 10 ELSE 0.0 END"
MODULES = "SELECT DISTINCT repo_id, dir AS path, repo_id <> 'r3' AS enable_doc, repo_id <> 'r1' AS enable_audit FROM fx_files WHERE dir NOT LIKE '%/deep'"


def _files(spark, sf):
    return table(spark, sf, "fx_files")


def _docs(spark, sf):
    return table(spark, sf, "fx_docs")


def _sources(spark, sf):
    return _files(spark, sf).filter(is_source(F.col("path")))


def _status(spark, sf):
    return freshness.test_status(_sources(spark, sf), table(spark, sf, "fx_test_map"))


def _stats(spark, sf):
    return freshness.dir_stats(_files(spark, sf))


def _audit(spark, sf):
    return freshness.audit_status(_docs(spark, sf), _files(spark, sf), table(spark, sf, "fx_audit_dirs"))


def _modules(spark, sf):
    dirs = _files(spark, sf).filter(~F.col("dir").endswith("/deep")).select("repo_id", F.col("dir").alias("path")).distinct()
    return dirs.withColumns({"enable_doc": F.col("repo_id") != "r3", "enable_audit": F.col("repo_id") != "r1"})


def _rules(spark):
    return spark.createDataFrame([("small", "medium"), ("small/brand_3", "high"), ("promo", "low")], "rule_path string, priority string")


@query("f05_doc_freshness", f"WITH {OWNED}, {FRESH} SELECT * FROM fresh")
def _(spark, sf):
    return freshness.doc_freshness(_files(spark, sf), _docs(spark, sf))


@query("d01_doc_ownership", f"WITH {OWNED} SELECT repo_id, path, owner FROM owned")
def _(spark, sf):
    code = _files(spark, sf).filter(file_kind(F.col("path")).isin("code", "test"))
    return joins.own_files(code, _docs(spark, sf)).select("repo_id", "path", "owner")


@query("d02_newer_than_doc", f"WITH {OWNED} SELECT repo_id, owner AS dir, path, mtime FROM owned WHERE mtime > doc_mtime")
def _(spark, sf):
    return freshness.changed_files(_files(spark, sf), _docs(spark, sf))


@query("d03_tests_of_sources", f"WITH {OWNED} SELECT DISTINCT m.repo_id, m.test_path FROM fx_test_map m JOIN owned o ON o.repo_id = m.repo_id AND o.path = m.source_path WHERE o.mtime > o.doc_mtime")
def _(spark, sf):
    stale = freshness.changed_files(_files(spark, sf), _docs(spark, sf)).select("repo_id", F.col("path").alias("source_path"))
    return joins.tests_for(stale, table(spark, sf, "fx_test_map"))


@query("d04_sources_of_tests", """WITH f AS (SELECT DISTINCT repo_id, test_path FROM fx_test_results WHERE status = 'failed'), m AS (SELECT DISTINCT repo_id, test_path, source_path FROM fx_test_map),
 j AS (SELECT f.repo_id, f.test_path, coalesce(m.source_path, 'fallback/' || f.test_path) AS source_path FROM f LEFT JOIN m USING (repo_id, test_path)) SELECT * FROM j""")
def _(spark, sf):
    results = table(spark, sf, "fx_test_results").filter("status = 'failed'")
    errors = results.withColumn("source_path", F.concat(F.lit("fallback/"), F.col("test_path")))
    return joins.sources_for(results, table(spark, sf, "fx_test_map"), errors)


@query("d05_missing_docs", f"WITH {STATS} SELECT repo_id, dir FROM stats WHERE is_large AND (repo_id, dir) NOT IN (SELECT (repo_id, dir) FROM fx_docs)")
def _(spark, sf):
    return joins.missing(_stats(spark, sf).filter("is_large"), _docs(spark, sf), ["repo_id", "dir"]).select("repo_id", "dir")


@query("d06_known_changes", "SELECT file_id, file_id IN (SELECT src FROM fx_edges UNION SELECT dst FROM fx_edges) AS known FROM fx_files")
def _(spark, sf):
    edges = table(spark, sf, "fx_edges")
    nodes = edges.select("repo_id", F.col("src").alias("file_id")).union(edges.select("repo_id", "dst"))
    known, warn = joins.split_known(_files(spark, sf), nodes, ["repo_id", "file_id"])
    return known.select("file_id", F.lit(True).alias("known")).union(warn.select("file_id", F.lit(False)))


_RULED = """ruled AS (SELECT f.repo_id, f.path, f.dir, CASE WHEN f.path LIKE 'small/brand\\_3/%' ESCAPE '\\' THEN 'small/brand_3' WHEN f.path LIKE 'small/%' THEN 'small' WHEN f.path LIKE 'promo/%' THEN 'promo' END AS rule_path,
  CASE WHEN f.path LIKE 'small/brand\\_3/%' ESCAPE '\\' THEN 'high' WHEN f.path LIKE 'small/%' THEN 'medium' WHEN f.path LIKE 'promo/%' THEN 'low' END AS priority FROM fx_files f)"""


@query("d07_longest_prefix", f"WITH {_RULED} SELECT repo_id, path, rule_path, priority FROM ruled")
def _(spark, sf):
    return joins.longest_prefix_join(_files(spark, sf), _rules(spark)).select("repo_id", "path", "rule_path", "priority")


_ALL_MODE = f"""sl AS (SELECT repo_id, dir AS path, 'stale' AS status, changed FROM fresh WHERE status = 'stale'),
 md AS (SELECT repo_id, dir AS path FROM stats WHERE is_large AND (repo_id, dir) NOT IN (SELECT (repo_id, dir) FROM fx_docs)),
 ma AS (SELECT repo_id, dir AS path FROM fx_docs WHERE (repo_id, dir) NOT IN (SELECT (repo_id, dir) FROM fx_audit_dirs)),
 k AS (SELECT repo_id, path FROM sl UNION SELECT * FROM md UNION SELECT * FROM ma)"""
_MERGED = """SELECT k.repo_id, k.path, CASE WHEN ma.path IS NOT NULL THEN 'missing_audit' WHEN md.path IS NOT NULL THEN 'missing_doc' ELSE 'stale' END AS status,
   coalesce(sl.changed, 0) AS changed, CASE WHEN sl.path IS NOT NULL OR md.path IS NOT NULL THEN true END AS want_doc, CASE WHEN ma.path IS NOT NULL THEN true END AS want_audit
 FROM k LEFT JOIN sl USING (repo_id, path) LEFT JOIN md USING (repo_id, path) LEFT JOIN ma USING (repo_id, path)"""


@query("b20_modules_all", f"WITH {OWNED}, {FRESH}, {STATS}, {_ALL_MODE} {_MERGED}")
def _(spark, sf):
    return freshness.modules_by_mode("all", _files(spark, sf), _docs(spark, sf), table(spark, sf, "fx_audit_dirs"))


@query("b20_modules_missing", f"""WITH {OWNED}, {FRESH}, {STATS}, {_ALL_MODE} SELECT repo_id, path FROM md UNION SELECT repo_id, path FROM ma""")
def _(spark, sf):
    return freshness.modules_by_mode("missing", _files(spark, sf), _docs(spark, sf), table(spark, sf, "fx_audit_dirs")).select("repo_id", "path")


@query("b20_modules_force", f"WITH {STATS} SELECT repo_id, dir AS path, 'force' AS status FROM stats WHERE is_large")
def _(spark, sf):
    return freshness.modules_by_mode("force", _files(spark, sf), _docs(spark, sf), table(spark, sf, "fx_audit_dirs")).select("repo_id", "path", "status")


@query("d08_merge_modules", """WITH a AS (SELECT repo_id, dir AS path, count(*) AS changed FROM fx_files WHERE path LIKE '%.js' GROUP BY 1, 2), b AS (SELECT repo_id, dir AS path, count(*) AS changed FROM fx_files WHERE path LIKE '%.py' GROUP BY 1, 2)
 SELECT repo_id, path, CASE WHEN b.changed IS NOT NULL THEN 'py' ELSE 'js' END AS status, coalesce(a.changed, b.changed) AS changed FROM a FULL JOIN b USING (repo_id, path)""")
def _(spark, sf):
    def part(ext):
        rows = _files(spark, sf).filter(F.col("path").endswith("." + ext)).groupBy("repo_id", F.col("dir").alias("path")).agg(
            F.count(F.lit(1)).alias("changed"))
        return rows.select("repo_id", "path", F.lit(ext).alias("status"), "changed", F.lit(True).alias("want_doc"), F.lit(None).cast("boolean").alias("want_audit"))
    return joins.merge_modules(part("js"), part("py")).select("repo_id", "path", "status", "changed")


@query("d09_match_by_name", """SELECT t.repo_id, 'tests/test-g' || t.k || '.test.js' AS test_path, min(s.path) AS source_path FROM (SELECT DISTINCT repo_id, k % 40 AS k FROM fx_files) t
  JOIN (SELECT repo_id, dir || '/g' || (k % 50) || '.js' AS path, k % 50 AS k FROM fx_files) s ON s.repo_id = t.repo_id AND s.k = t.k GROUP BY 1, 2""")
def _(spark, sf):
    f = _files(spark, sf)
    tests = f.select("repo_id", F.concat(F.lit("tests/test-g"), (F.col("k") % 40).cast("string"), F.lit(".test.js")).alias("path")).distinct()
    sources = f.select("repo_id", F.concat("dir", F.lit("/g"), (F.col("k") % 50).cast("string"), F.lit(".js")).alias("path"))
    return joins.match_by_name(tests, sources)


@query("d09_match_by_token", """SELECT s.repo_id, s.path AS source_path, min(t.path) AS test_path FROM (SELECT repo_id, dir || '/g' || (k % 50) || '.js' AS path, 'g' || (k % 50) AS n FROM fx_files) s
  JOIN (SELECT repo_id, dir || '/old-g' || (k % 40) || '.test.js' AS path, 'g' || (k % 40) AS n FROM fx_files) t ON t.repo_id = s.repo_id AND t.n = s.n GROUP BY 1, 2""")
def _(spark, sf):
    f = _files(spark, sf)
    tests = f.select("repo_id", F.concat("dir", F.lit("/old-g"), (F.col("k") % 40).cast("string"), F.lit(".test.js")).alias("path"))
    sources = f.select("repo_id", F.concat("dir", F.lit("/g"), (F.col("k") % 50).cast("string"), F.lit(".js")).alias("path")).distinct()
    return joins.match_by_token(tests, sources)


_RESOLVED = """SELECT l.repo_id, l.path, to_root || replace(replace(replace(up_path, '.js', ''), '.py', ''), '.md', '') AS spec, l.up_path AS target FROM fx_links l
   WHERE l.up_path LIKE '%.js' AND l.up_path NOT LIKE '%.test.%'
 UNION SELECT l.repo_id, l.path, to_root || jump_path, jump_path FROM fx_links l WHERE p_size > 40 AND jump_path IS NOT NULL"""


@query("d10_resolve_imports", _RESOLVED)
def _(spark, sf):
    from repotide.operators import extract
    code = table(spark, sf, "fx_code")
    return joins.resolve_imports(extract.extract_imports(extract.without_comments(code)), code)


@query("d11_trace_symbols", """WITH i AS (SELECT repo_id, file_id, dir || '/m' || file_id || '/index.js' AS path, up_id, up_path FROM fx_index)
 SELECT repo_id, 'tests/t' || file_id || '.test.js' AS test_path, path AS source_path FROM i UNION SELECT repo_id, 'tests/t' || file_id || '.test.js', up_path FROM i""".replace("dir || '/m' || file_id || '/index.js' AS path", "path"))
def _(spark, sf):
    from repotide.operators import extract
    index = table(spark, sf, "fx_index")
    key = F.col("file_id").cast("string")
    tests = index.select("repo_id", F.concat(F.lit("tests/t"), key, F.lit(".test.js")).alias("path"), F.concat(
        F.lit("import { fn_"), F.col("up_id").cast("string"), F.lit(" } from '../"), F.regexp_replace("path", r"\.js$", ""), F.lit("';")).alias("content"))
    return joins.trace_symbols(extract.extract_test_imports(tests), extract.reexport_map(index))


@query("d12_reverse_edges", "SELECT repo_id, dst AS src, src AS dst FROM fx_edges")
def _(spark, sf):
    from repotide.operators.graph import reverse_edges
    return reverse_edges(table(spark, sf, "fx_edges"))


@query("d13_failure_overlay", """WITH m AS (SELECT DISTINCT repo_id, module_id, module_id > 20 AS enable_audit FROM fx_tasks), l AS (SELECT repo_id, max(run_day) AS run_day FROM fx_tasks GROUP BY repo_id),
  f AS (SELECT t.repo_id, t.module_id, arg_max(t.status, t.task_id) AS status, arg_max('e' || t.duration_ms, t.task_id) AS error FROM fx_tasks t JOIN l USING (repo_id, run_day) WHERE t.status IN ('failed', 'timeout') GROUP BY 1, 2)
 SELECT m.repo_id, m.module_id, coalesce(f.status, CASE WHEN enable_audit THEN 'ready' ELSE 'disabled' END) AS status, f.error FROM m LEFT JOIN f USING (repo_id, module_id)""")
def _(spark, sf):
    tasks = table(spark, sf, "fx_tasks")
    modules = tasks.select("repo_id", "module_id").distinct().withColumn("enable_audit", F.col("module_id") > 20)
    runs = tasks.select("repo_id", F.col("run_day").alias("run"), "module_id", "status", F.concat(F.lit("e"), F.col("duration_ms").cast("string")).alias("reason"), F.col("task_id").alias("at"))
    return joins.overlay_failures(modules, runs)


@query("d14_test_placement", f"""WITH s AS (SELECT repo_id, 'js/' || dir || '/g' || k || '.js' AS path, k, dir FROM fx_files WHERE k >= 3),
  t AS (SELECT repo_id, k, dir, CASE WHEN file_id % 3 = 0 THEN 'tests/' || dir || '/g' || k || '.test.js' ELSE 'tests/else/g' || k || '.test.js' END AS path FROM fx_files)
 SELECT t.repo_id, t.path AS test_path, CASE WHEN t.k < 3 THEN 'orphan' WHEN t.path LIKE 'tests/else/%' THEN 'misplaced' ELSE 'correct' END AS status FROM t""")
def _(spark, sf):
    f, name = _files(spark, sf), F.concat(F.lit("/g"), F.col("k").cast("string"))
    sources = f.filter("k >= 3").select("repo_id", F.concat(F.lit("js/"), "dir", name, F.lit(".js")).alias("path"))
    place = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("tests/"), F.col("dir"))).otherwise("tests/else")
    return joins.test_placement(f.select("repo_id", F.concat(place, name, F.lit(".test.js")).alias("path")), sources).select("repo_id", "test_path", "status")


@query("d15_group_changes", f"""WITH {OWNED}, c AS (SELECT repo_id, path FROM owned WHERE mtime > doc_mtime), m AS (SELECT repo_id, source_path AS path, split_part(source_path, '/', 1) AS module FROM fx_test_map
   UNION SELECT repo_id, test_path, max(split_part(source_path, '/', 1)) FROM fx_test_map GROUP BY 1, 2),
  mm AS (SELECT repo_id, path, max(module) AS module FROM m GROUP BY 1, 2)
 SELECT c.repo_id, c.path, coalesce(mm.module, 'other') AS module FROM c LEFT JOIN mm USING (repo_id, path)""")
def _(spark, sf):
    changes = freshness.changed_files(_files(spark, sf), _docs(spark, sf)).select("repo_id", "path")
    tm = table(spark, sf, "fx_test_map").withColumn("module", F.split_part("source_path", F.lit("/"), F.lit(1)))
    return joins.group_changes(changes, tm)


_MSTATUS = f"""mods AS ({MODULES}), st AS (SELECT repo_id, dir AS path FROM fresh WHERE status = 'stale'),
  own AS (SELECT t.repo_id, CASE WHEN t.dir LIKE '%/deep' THEN regexp_replace(t.dir, '/deep$', '') ELSE t.dir END AS path, t.status FROM (SELECT s.*, regexp_replace(s.path, '/[^/]*$', '') AS dir FROM tstatus s) t),
  cnt AS (SELECT repo_id, path, count(*) AS total, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'untested') AS untested, count(*) FILTER (status = 'stale') AS stale FROM own GROUP BY 1, 2),
  ms AS (SELECT m.repo_id, m.path, m.enable_doc, m.enable_audit, m.enable_doc AND st.path IS NOT NULL AS stale_doc, m.enable_audit AND st.path IS NOT NULL AS stale_audit, coalesce(c.stale, 0) > 0 AS stale_test,
    coalesce(c.total, 0) AS test_total, coalesce(c.covered, 0) AS test_covered, coalesce(c.untested, 0) AS test_untested, coalesce(c.stale, 0) AS test_stale
   FROM mods m LEFT JOIN st USING (repo_id, path) LEFT JOIN cnt c USING (repo_id, path))"""


def _module_status(spark, sf):
    stale = freshness.doc_freshness(_files(spark, sf), _docs(spark, sf)).filter("status = 'stale'").select("repo_id", F.col("dir").alias("path"))
    return joins.module_status(_modules(spark, sf), stale, _status(spark, sf).select("repo_id", "path", "status"))


@query("d16_module_status", f"WITH {OWNED}, {FRESH}, {TSTATUS}, {_MSTATUS} SELECT * FROM ms")
def _(spark, sf):
    return _module_status(spark, sf)


@query("e27_child_edges", """WITH m AS (SELECT repo_id, dir AS path FROM fx_docs UNION SELECT DISTINCT repo_id, dir FROM fx_files WHERE line_count > 60), p AS (
  SELECT a.repo_id, b.path AS parent, a.path AS child, row_number() OVER (PARTITION BY a.repo_id, a.path ORDER BY length(b.path) DESC) AS rn FROM m a JOIN m b ON a.repo_id = b.repo_id AND starts_with(a.path, b.path || '/'))
 SELECT repo_id, parent, child FROM p WHERE rn = 1""")
def _(spark, sf):
    big = _files(spark, sf).filter("line_count > 60").select("repo_id", F.col("dir").alias("path"))
    return joins.child_edges(_docs(spark, sf).select("repo_id", F.col("dir").alias("path")).union(big))


@query("f01_test_status", f"WITH {TSTATUS} SELECT * FROM tstatus")
def _(spark, sf):
    return _status(spark, sf)


_BUCKETS = "count(*) AS total, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'untested') AS untested, " + PCT1.format("count(*) FILTER (status = 'covered')", "count(*)") + " AS coverage"


@query("f02_module_coverage", f"WITH {TSTATUS} SELECT repo_id, split_part(path, '/', 1) AS module, {_BUCKETS} FROM tstatus GROUP BY 1, 2")
def _(spark, sf):
    return freshness.module_coverage(_status(spark, sf))


@query("f03_coverage_summary", f"WITH {TSTATUS} SELECT repo_id, {_BUCKETS} FROM tstatus GROUP BY 1")
def _(spark, sf):
    return freshness.coverage_summary(_status(spark, sf))


_BY_DIR = f"bydir AS (SELECT repo_id, regexp_replace(path, '/[^/]*$', '') AS module, {_BUCKETS} FROM tstatus GROUP BY 1, 2)"


@query("f04_module_test_freshness", f"WITH {TSTATUS}, {_BY_DIR} SELECT repo_id, module, CASE WHEN untested > 0 AND covered = 0 THEN 'missing' WHEN stale > 0 THEN 'stale' ELSE 'fresh' END AS status, coverage FROM bydir")
def _(spark, sf):
    status = _status(spark, sf).withColumn("path", F.concat(dir_name(F.col("path"))))
    cov = freshness.module_coverage(status.withColumn("path", F.replace("path", F.lit("/"), F.lit("|"))))
    return freshness.module_test_freshness(cov).select("repo_id", F.replace("module", F.lit("|"), F.lit("/")).alias("module"), "status", "coverage")


@query("h04_worst_coverage_first", f"WITH {TSTATUS} SELECT repo_id, split_part(path, '/', 1) AS module, {_BUCKETS} FROM tstatus GROUP BY 1, 2")
def _(spark, sf):
    return freshness.worst_first(freshness.module_coverage(_status(spark, sf)))


@query("h08_untested_and_stale", f"WITH {TSTATUS} SELECT repo_id, split_part(path, '/', 1) AS module, path, status, tests FROM tstatus WHERE status IN ('untested', 'stale')")
def _(spark, sf):
    return freshness.list_by_status(_status(spark, sf), "untested", "stale")


@query("f06_module_freshness", f"""WITH mods AS ({MODULES}), nw AS (SELECT m.repo_id, m.path, max(f.mtime) AS code_mtime, first(f.path ORDER BY f.mtime DESC, f.path) AS newest_file FROM mods m JOIN fx_files f ON f.repo_id = m.repo_id AND starts_with(f.path, m.path || '/')
   WHERE {CODE.replace('path', 'f.path')} GROUP BY 1, 2), x AS (SELECT m.repo_id, m.path, d.doc_mtime, n.newest_file, CASE WHEN d.doc_mtime IS NULL AND m.enable_doc THEN 'missing' WHEN n.code_mtime > d.doc_mtime THEN 'outdated' END AS type
   FROM mods m LEFT JOIN nw n USING (repo_id, path) LEFT JOIN fx_docs d ON d.repo_id = m.repo_id AND d.dir = m.path)
 SELECT repo_id, path, type, CASE WHEN type = 'outdated' THEN CAST(floor(epoch_us(TIMESTAMP '2003-01-01' - doc_mtime) / 1000) AS BIGINT) END AS doc_age_ms, CASE WHEN type = 'outdated' THEN newest_file END AS newest_file FROM x WHERE type IS NOT NULL""".replace(
     "epoch_us(TIMESTAMP '2003-01-01' - doc_mtime)", "(epoch_us(TIMESTAMP '2003-01-01') - epoch_us(doc_mtime))"))
def _(spark, sf):
    return freshness.module_freshness(_modules(spark, sf), _files(spark, sf), _docs(spark, sf), F.lit("2003-01-01").cast("timestamp_ntz"))


@query("f07_audit_status", f"WITH {ASTATUS} SELECT * FROM astatus")
def _(spark, sf):
    return _audit(spark, sf)


@query("h01_audit_order", f"WITH {ASTATUS} SELECT repo_id, dir, status, severity FROM astatus")
def _(spark, sf):
    from repotide.functions.text import rank_of
    return windows.rank_order(_audit(spark, sf), "status", freshness.AUDIT_ORDER, rank_of(
        F.col("severity"), freshness.AUDIT_SEVERITY_ORDER, 5), "repo_id", "dir").select("repo_id", "dir", "status", "severity")


_N = "count(*) FILTER (status = '{0}') AS {0}"
_S = "count(*) FILTER (status <> 'never' AND severity = '{0}') AS {0}"
_ASTATS = "astats AS (SELECT repo_id, count(*) AS total, " + ", ".join(_N.format(s) for s in ("never", "stale", "fresh", "clean")) + ", " + ", ".join(
    _S.format(s) for s in ("critical", "high", "medium", "low")) + ", CAST(coalesce(sum(issue_count), 0) AS BIGINT) AS total_issues, CAST(sum(file_count) AS BIGINT) AS total_files FROM astatus GROUP BY repo_id)"


@query("f08_audit_stats", f"WITH {ASTATUS}, {_ASTATS} SELECT * FROM astats")
def _(spark, sf):
    return freshness.audit_stats(_audit(spark, sf))


@query("f38_insight_bars", f"""WITH {ASTATUS}, {_ASTATS}, g AS (SELECT *, greatest(critical, high, medium, low) AS top FROM astats)
 SELECT repo_id, {', '.join(f"CASE WHEN top > 0 THEN {c} / top ELSE 0.0 END AS {c}_bar" for c in ('critical', 'high', 'medium', 'low'))}, {PCT.format('(fresh + clean)', 'total')} AS ready_percent FROM g""")
def _(spark, sf):
    return audit_ops.insight_bars(freshness.audit_stats(_audit(spark, sf)))


@query("f09_directory_size", f"WITH {STATS} SELECT * FROM stats")
def _(spark, sf):
    return _stats(spark, sf)


@query("f10_large_directories", f"WITH {STATS} SELECT * FROM stats WHERE is_large")
def _(spark, sf):
    return freshness.large_dirs(_stats(spark, sf))


@query("f11_effective_coverage", f"""WITH {STATS}, k AS (SELECT s.*, d.dir IS NOT NULL AS has_doc FROM stats s LEFT JOIN fx_docs d USING (repo_id, dir)),
  c AS (SELECT a.repo_id, CASE WHEN a.has_doc THEN 'with' WHEN a.is_large THEN 'large' WHEN EXISTS (SELECT 1 FROM k b WHERE b.has_doc AND b.repo_id = a.repo_id AND starts_with(a.dir, b.dir || '/')) THEN 'covered' ELSE 'orphan' END AS kind FROM k a),
  n AS (SELECT repo_id, count(*) FILTER (kind = 'with') AS with_doc, count(*) FILTER (kind = 'large') AS large_missing, count(*) FILTER (kind = 'covered') AS small_covered, count(*) FILTER (kind = 'orphan') AS small_orphan, count(*) AS total FROM c GROUP BY 1)
 SELECT repo_id, with_doc, large_missing, small_covered, small_orphan, {PCT.format('with_doc', '(with_doc + large_missing)')} AS effective_percent, {PCT.format('with_doc', 'total')} AS actual_percent FROM n""")
def _(spark, sf):
    return freshness.effective_coverage(_stats(spark, sf), _docs(spark, sf))


@query("f12_index_worklist", f"""WITH {STATS}, bare AS (SELECT * FROM stats WHERE (repo_id, dir) NOT IN (SELECT (repo_id, dir) FROM fx_docs)),
  near AS (SELECT b.repo_id, b.dir, d.dir AS owner, row_number() OVER (PARTITION BY b.repo_id, b.dir ORDER BY length(d.dir) DESC) AS rn FROM bare b JOIN fx_docs d ON d.repo_id = b.repo_id AND starts_with(b.dir, d.dir || '/') WHERE NOT b.is_large)
 SELECT repo_id, dir, 'create' AS action, CAST(NULL AS BIGINT) AS small_children, files, lines FROM bare WHERE is_large
 UNION ALL SELECT repo_id, owner, 'update', count(*), NULL, NULL FROM near WHERE rn = 1 GROUP BY repo_id, owner""")
def _(spark, sf):
    return freshness.index_worklist(_stats(spark, sf), _docs(spark, sf))


_DIRS = """dirs AS (SELECT DISTINCT repo_id, dir FROM fx_files UNION SELECT repo_id, split_part(dir, '/', 1) FROM fx_files UNION SELECT repo_id, split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) FROM fx_files)"""


@query("f13_small_unaudited", f"""WITH {STATS}, {_DIRS} SELECT repo_id, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '.' END AS parent, dir, coalesce(files, 0) AS files, coalesce(lines, 0) AS lines
 FROM dirs LEFT JOIN stats USING (repo_id, dir) WHERE coalesce(files, 0) < 5 AND coalesce(lines, 0) < 200 AND (repo_id, dir) NOT IN (SELECT (repo_id, dir) FROM fx_audit_dirs)""")
def _(spark, sf):
    return freshness.small_unaudited(_files(spark, sf), _stats(spark, sf), table(spark, sf, "fx_audit_dirs"))


_TOP = "split_part(dir, '/', 1) || CASE WHEN contains(dir, '/') THEN '/' || split_part(dir, '/', 2) ELSE '' END"


@query("f14_directory_coverage", f"""WITH {ASTATUS}, f AS (SELECT repo_id, {_TOP} AS top_dir, count(*) AS discovered FROM fx_files WHERE {SOURCE} GROUP BY 1, 2), a AS (SELECT repo_id, {_TOP} AS top_dir, CAST(sum(file_count) AS BIGINT) AS audited FROM astatus GROUP BY 1, 2)
 SELECT repo_id, top_dir, discovered, coalesce(audited, 0) AS audited, {PCT.format('coalesce(audited, 0)', 'discovered')} AS coverage_percent FROM f LEFT JOIN a USING (repo_id, top_dir)""")
def _(spark, sf):
    return freshness.dir_coverage(_files(spark, sf), _audit(spark, sf))


@query("f15_rule_coverage", f"""WITH mods AS ({MODULES}) SELECT repo_id, CASE WHEN path = 'small/brand_3' THEN 'small/brand_3' WHEN path LIKE 'small/%' THEN 'small' WHEN path LIKE 'promo/%' THEN 'promo' ELSE '.' END AS rule_path, count(*) AS discovered,
   count(*) FILTER (enable_audit) AS audited, {PCT.format('count(*) FILTER (enable_audit)', 'count(*)')} AS coverage_percent FROM mods GROUP BY 1, 2""")
def _(spark, sf):
    return freshness.rule_coverage(_modules(spark, sf), _rules(spark))


@query("f35_artefact_staleness", f"""WITH a AS (SELECT repo_id, unnest(['deps', 'test', 'doc']) AS target FROM (SELECT DISTINCT repo_id FROM fx_files)),
  art AS (SELECT repo_id, target, CASE WHEN repo_id = 'r2' AND target <> 'test' THEN NULL WHEN target = 'test' THEN (SELECT max(mtime) FROM fx_files) ELSE (SELECT min(doc_mtime) FROM fx_docs) END AS generated_at FROM a),
  src AS (SELECT repo_id, path, mtime, unnest(CASE WHEN {TEST} THEN ['test'] WHEN starts_with(path, 'small/') THEN ['deps', 'test', 'doc'] ELSE ['deps', 'test'] END) AS target FROM fx_files WHERE {CODE}),
  n AS (SELECT repo_id, target, max(mtime) AS m, first(path ORDER BY mtime DESC, path) AS p, count(*) AS c FROM src GROUP BY 1, 2)
 SELECT art.repo_id, art.target, generated_at IS NULL OR greatest(m, cfg) > generated_at AS stale,
   CASE WHEN generated_at IS NULL THEN CASE WHEN art.target = 'doc' THEN 'doc_missing' ELSE 'cache_missing' END WHEN greatest(m, cfg) > generated_at THEN CASE WHEN art.target = 'doc' THEN 'source_newer_than_doc' ELSE 'source_newer_than_cache' END ELSE 'fresh' END AS reason,
   CASE WHEN cfg > m THEN 'config' ELSE 'file' END AS newest_kind, CASE WHEN NOT coalesce(cfg > m, false) THEN p END AS newest_source, greatest(m, cfg) AS newest_mtime, c AS scanned
 FROM (SELECT *, CASE WHEN repo_id = 'r1' THEN TIMESTAMP '2010-01-01' END AS cfg FROM art) art LEFT JOIN n ON n.repo_id = art.repo_id AND n.target = art.target""")
def _(spark, sf):
    files, docs = _files(spark, sf), _docs(spark, sf)
    repos = files.select("repo_id").distinct()
    bounds = files.agg(F.max("mtime").alias("hi")).join(F.broadcast(docs.agg(F.min("doc_mtime").alias("lo"))))
    target = F.col("target")
    art = repos.select("repo_id", F.explode(F.array(*map(F.lit, ("deps", "test", "doc")))).alias("target")).join(F.broadcast(bounds)).select(  # one row
        "repo_id", "target", F.when((F.col("repo_id") == "r2") & (target != "test"), None).when(target == "test", F.col("hi")).otherwise(F.col("lo")).alias("generated_at"))
    config = repos.filter("repo_id = 'r1'").withColumn("config_mtime", F.lit("2010-01-01").cast("timestamp_ntz"))
    return freshness.artefact_staleness(files, art, config, "small/")


@query("f36_kpi", f"""WITH {OWNED}, {FRESH}, {TSTATUS}, {_MSTATUS}, m AS (SELECT repo_id, count(*) AS modules, count(*) FILTER (enable_doc) AS doc_total, count(*) FILTER (stale_doc) AS doc_stale,
   count(*) FILTER (enable_doc) - count(*) FILTER (stale_doc) AS doc_fresh, count(*) FILTER (enable_audit) AS audit_total, count(*) FILTER (stale_audit) AS audit_stale, count(*) FILTER (enable_audit) - count(*) FILTER (stale_audit) AS audit_fresh FROM ms GROUP BY 1),
  t AS (SELECT repo_id, count(*) AS test_total, count(*) FILTER (status = 'covered') AS test_covered, count(*) FILTER (status = 'stale') AS test_stale, count(*) FILTER (status = 'untested') AS test_untested, {PCT.format("count(*) FILTER (status = 'covered')", 'count(*)')} AS coverage_percent FROM tstatus GROUP BY 1)
 SELECT * FROM m LEFT JOIN t USING (repo_id)""")
def _(spark, sf):
    return freshness.kpi(_module_status(spark, sf), _status(spark, sf))


@query("f37_module_buckets", f"""WITH {OWNED}, {FRESH}, {TSTATUS}, {_MSTATUS} SELECT repo_id, CASE WHEN grouping(path) = 1 THEN 'TOTAL' ELSE path END AS module, count(*) AS total, count(*) FILTER (status = 'covered') AS covered,
   count(*) FILTER (status = 'untested') AS untested, count(*) FILTER (status = 'stale') AS stale FROM (SELECT o.* FROM own o JOIN mods m USING (repo_id, path)) GROUP BY GROUPING SETS ((repo_id, path), (repo_id))""")
def _(spark, sf):
    return freshness.module_buckets(_modules(spark, sf), _status(spark, sf).select("repo_id", "path", "status"))


@query("f39_module_inventory", f"""WITH {_DIRS}, o AS (SELECT repo_id, dir, count(*) AS files, count(*) FILTER (({CODE}) AND NOT {TEST}) AS core_files, bool_or({TEST}) AS has_tests, bool_or(path LIKE '%/index.js') AS has_index FROM
    (SELECT repo_id, dir, CASE WHEN line_count = 60 THEN dir || '/index.js' ELSE path END AS path FROM fx_files) GROUP BY 1, 2),
  b AS (SELECT repo_id, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '.' END AS dir, count(*) AS submodules FROM dirs GROUP BY 1, 2)
 SELECT repo_id, dir, coalesce(files, 0) AS files, coalesce(core_files, 0) AS core_files, coalesce(submodules, 0) AS submodules, coalesce(has_index, false) AS has_index, d.doc_mtime IS NOT NULL AS has_doc, coalesce(has_tests, false) AS has_tests, false AS has_types
 FROM dirs LEFT JOIN o USING (repo_id, dir) LEFT JOIN b USING (repo_id, dir) LEFT JOIN fx_docs d USING (repo_id, dir)""")
def _(spark, sf):
    files = _files(spark, sf).withColumn("path", F.when(F.col("line_count") == 60, F.concat("dir", F.lit("/index.js"))).otherwise(F.col("path")))
    return freshness.module_inventory(files, _docs(spark, sf))


@query("f40_common_directory", """SELECT repo_id || ':' || split_part(dir, '/', 1) || ':' || (k % 2) AS repo_id, CASE WHEN count(DISTINCT dir) = 1 THEN any_value(dir) WHEN count(DISTINCT split_part(dir, '/', 2)) = 1 THEN any_value(split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2))
   ELSE any_value(split_part(dir, '/', 1)) END AS common_dir FROM fx_files GROUP BY 1""")
def _(spark, sf):
    key = F.concat("repo_id", F.lit(":"), F.split_part("dir", F.lit("/"), F.lit(1)), F.lit(":"), (F.col("k") % 2).cast("string"))
    return freshness.common_dir(_files(spark, sf).select(key.alias("repo_id"), F.concat(F.lit("./"), "dir", F.lit("/**")).alias("path")))


@query("f41_stale_tree", f"""WITH {OWNED}, {FRESH}, s AS (SELECT repo_id, dir FROM fresh WHERE status = 'stale'), up AS (SELECT repo_id, dir, dir AS node FROM s UNION SELECT repo_id, dir, split_part(dir, '/', 1) FROM s UNION SELECT repo_id, dir, split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) FROM s WHERE contains(dir, '/')),
  c AS (SELECT repo_id, owner AS node, path, row_number() OVER (PARTITION BY repo_id, owner ORDER BY mtime DESC, path) AS rn FROM owned WHERE mtime > doc_mtime), fl AS (SELECT repo_id, node, string_agg(path, ',' ORDER BY path) AS files FROM c WHERE rn <= 3 GROUP BY 1, 2),
  n AS (SELECT repo_id, node, count(*) AS stale_below, bool_or(dir = node) AS is_stale FROM up GROUP BY 1, 2)
 SELECT repo_id, node, CAST(len(string_split(node, '/')) AS INT) AS depth, stale_below, is_stale, CASE WHEN is_stale THEN coalesce(files, '') ELSE '' END AS files FROM n LEFT JOIN fl USING (repo_id, node)""")
def _(spark, sf):
    files, docs = _files(spark, sf), _docs(spark, sf)
    stale = freshness.doc_freshness(files, docs).filter("status = 'stale'")
    return freshness.stale_tree(stale, freshness.changed_files(files, docs))


@query("g01_newest_per_group", "SELECT repo_id, dir, max(mtime) AS mtime, first(path ORDER BY mtime DESC, path) AS path FROM fx_files GROUP BY repo_id, dir")
def _(spark, sf):
    return windows.newest_per(_files(spark, sf), ["repo_id", "dir"], "mtime", "path", [])


@query("h02_deepest_first", "SELECT repo_id, path FROM fx_files")
def _(spark, sf):
    return windows.deepest_first(_files(spark, sf).select("repo_id", "path"))


@query("h05_fix_queue", f"""WITH {_RULED} SELECT a.repo_id, a.module_path, r.priority, 'HIGH' AS severity FROM fx_audits a JOIN ruled r ON r.repo_id = a.repo_id AND r.path = a.module_path WHERE a.layout = 'bracket'
  UNION ALL SELECT a.repo_id, a.module_path, r.priority, 'LOW' FROM fx_audits a JOIN ruled r ON r.repo_id = a.repo_id AND r.path = a.module_path WHERE a.layout = 'bracket' AND p_size <= 10""")
def _(spark, sf):
    from repotide.sources.audit_docs import parse_bracket_issues
    issues = parse_bracket_issues(table(spark, sf, "fx_audits")).withColumn("path", F.col("module_path"))
    return audit_ops.fix_queue(joins.longest_prefix_join(issues, _rules(spark))).select("repo_id", "module_path", "priority", "severity")


@query("f22_fix_stats", """SELECT repo_id, count(DISTINCT module_path) AS modules_scanned, count(*) AS total_issues, count(*) FILTER (fixable) AS fixable, count(*) FILTER (fixable AND file_id % 3 = 0) AS fixed, count(*) FILTER (fixable AND file_id % 3 = 1) AS skipped,
   count(*) FILTER (fixable AND file_id % 3 = 2) AS failed, count(*) FILTER (sev = 'LOW') AS low, 0 AS medium, count(*) FILTER (sev = 'HIGH') AS high, count(*) FILTER (sev = 'CRITICAL') AS critical
 FROM (SELECT repo_id, module_path, file_id, 'HIGH' AS sev, true AS fixable FROM fx_audits WHERE layout = 'bracket' UNION ALL SELECT repo_id, module_path, file_id, CASE WHEN p_size > 10 THEN 'CRITICAL' ELSE 'LOW' END, p_size <= 10 FROM fx_audits WHERE layout = 'bracket') GROUP BY repo_id""")
def _(spark, sf):
    from repotide.sources.audit_docs import parse_bracket_issues
    docs = table(spark, sf, "fx_audits")
    issues = parse_bracket_issues(docs).withColumn("issue_id", F.concat("repo_id", F.lit("|"), "module_path", F.lit("#"), F.col("seq").cast("string")))
    ids = docs.select("repo_id", "module_path", "file_id")
    outcome = F.when(F.col("file_id") % 3 == 0, "fixed").when(F.col("file_id") % 3 == 1, "skipped").otherwise("failed")
    outcomes = issues.filter("fixable").join(ids, ["repo_id", "module_path"]).select("issue_id", outcome.alias("outcome"))
    return audit_ops.fix_stats(issues, outcomes)


@query("h06_testgen_worklist", f"""WITH {TSTATUS} SELECT repo_id, path, status, CAST(len(string_split(path, '/')) AS INT) AS depth, 'tests/unit/' || regexp_replace(path, '\\.[^.]*$', '') || '.test.js' AS expected_test FROM tstatus WHERE status IN ('untested', 'stale') AND path NOT LIKE '%/deep/%'""")
def _(spark, sf):
    return freshness.testgen_worklist(_status(spark, sf), ("untested", "stale"), ignore=["**/deep/**"])


@query("h07_scaffold_diff", f"""WITH t AS (SELECT repo_id, CASE k % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'integration' ELSE 'e2e' END AS test_type, 'tests/f' || (file_id - 4) || '.spec-x.js' AS path, mtime, 'f' || (file_id - 4) AS name FROM fx_files),
  w AS (SELECT repo_id, path, mtime, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.js$', '') AS name, regexp_replace(path, '\\.[^.]*$', '') AS st, unnest(['unit', 'integration', 'e2e']) AS test_type FROM fx_files WHERE {SOURCE})
 SELECT w.repo_id, w.test_type, w.path AS source_path, 'tests/' || w.test_type || '/' || st || CASE w.test_type WHEN 'e2e' THEN '.e2e.test.js' ELSE '.test.js' END AS expected_test, t.path AS actual_test,
   CASE WHEN t.path IS NULL THEN 'missing' WHEN w.mtime > t.mtime THEN 'stale' ELSE 'covered' END AS status FROM w LEFT JOIN t USING (repo_id, test_type, name)""")
def _(spark, sf):
    f = _files(spark, sf)
    kind = F.when(F.col("k") % 3 == 0, "unit").when(F.col("k") % 3 == 1, "integration").otherwise("e2e")
    tests = f.select("repo_id", kind.alias("test_type"), F.concat(F.lit("tests/f"), (F.col("file_id") - 4).cast("string"), F.lit(".spec-x.js")).alias("path"), "mtime")
    return freshness.scaffold_diff(_sources(spark, sf), tests)
