"""Text-to-rows extraction over the generated sources, audit documents and given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from repotide.catalog.registry import query
from repotide.fixtures import table
from repotide.functions.paths import file_kind
from repotide.operators import entropy, extract
from repotide.sources import audit_docs

_TESTS = "path LIKE '%.test.%'"
_TEST_FILES = "path LIKE '%.test.%' AND path NOT LIKE '%.md'"
_SPEC = "to_root || replace(replace(replace(up_path, '.js', ''), '.py', ''), '.md', '')"


def _code(spark, sf):
    return table(spark, sf, "fx_code")


def _clean(spark, sf):
    return extract.without_comments(_code(spark, sf))


def _tests(spark, sf):
    return _code(spark, sf).filter(file_kind(F.col("path")) == "test")


RULES = [
    extract.Rule("secret", 'token = "[0-9a-f]{40}"', "error", "secret"),
    extract.Rule("email", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+[.]com", "warning", "e-mail address"),
    extract.Rule("ipv4", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "warning", "address"),
    extract.Rule("licence", "License", "info", "licence"),
]
_HITS = """WITH l AS (SELECT file_id, repo_id, path, unnest(string_split(content, chr(10))) AS text,
    unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM fx_sources),
  rules(rule, severity, pattern) AS (VALUES ('secret', 'error', 'token = "[0-9a-f]{40}"'), ('email', 'warning', '[A-Za-z0-9.]+@[A-Za-z0-9.]+[.]com'),
    ('ipv4', 'warning', '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}'), ('licence', 'info', 'License')),
  hits AS (SELECT l.repo_id, l.path, l.line, r.rule, r.severity, substr(trim(l.text), 1, 80) AS snippet FROM l JOIN rules r ON regexp_matches(l.text, r.pattern))"""


@query("c01_strip_comments", """SELECT file_id,
   repeat(' ', length('// file ' || path || ' import x from "./none"') - 1) AS first_line,
   contains(content, 'run("// not') AS kept_string, p_size < 20 AND path NOT LIKE '%.test.%' AS had_block, len(string_split(content, chr(10))) AS lines
 FROM fx_code""")
def _(spark, sf):
    c = F.col("content")
    return _code(spark, sf).withColumn("original", c).select("file_id", "path", "original", extract.strip_comments(c).alias("content")).select(
        "file_id", F.substring_index("content", "\n", 1).alias("first_line"), F.col("content").contains('run("// not').alias("kept_string"),
        (F.col("original").contains("/* note") & ~F.col("content").contains("note") & ~F.col("content").contains("more */")).alias("had_block"),
        F.size(F.split("content", "\n", -1)).cast("bigint").alias("lines"))


@query("c02_imports", f"""SELECT repo_id, path, {_SPEC} AS spec FROM fx_links WHERE up_id IS NOT NULL
 UNION SELECT repo_id, path, to_root || jump_path FROM fx_links WHERE jump_id IS NOT NULL AND p_size > 40
 UNION SELECT repo_id, path, './setup' FROM fx_links WHERE p_size > 46 UNION SELECT repo_id, path, 'lodash' FROM fx_links WHERE p_size > 46""")
def _(spark, sf):
    return extract.extract_imports(_clean(spark, sf), require=True)


@query("c02_python_imports", """SELECT repo_id, path, 'pkg.m' || file_id AS spec FROM fx_paths UNION ALL SELECT repo_id, path, 'os' FROM fx_paths WHERE p_size > 20""")
def _(spark, sf):
    nl = F.lit("\n")
    text = F.concat(F.lit("from pkg.m"), F.col("file_id").cast("string"), F.lit(" import x"), nl,
                    F.when(F.col("p_size") > 20, "  import os\n").otherwise("x = 'import y'\n"))
    return extract.extract_imports(table(spark, sf, "fx_paths").withColumn("content", text), "python")


@query("c03_exports", f"""SELECT repo_id, path, 'fn_' || file_id AS symbol FROM fx_paths WHERE NOT {_TESTS}
 UNION ALL SELECT repo_id, path, 'v_' || file_id FROM fx_paths WHERE NOT {_TESTS} UNION ALL SELECT repo_id, path, 'u_' || file_id FROM fx_paths WHERE NOT {_TESTS}
 UNION ALL SELECT repo_id, path, 'C_' || file_id FROM fx_paths WHERE NOT {_TESTS} AND p_size BETWEEN 28 AND 33
 UNION ALL SELECT repo_id, path, 'alias_' || file_id FROM fx_paths WHERE NOT {_TESTS} AND p_size BETWEEN 28 AND 33
 UNION ALL SELECT repo_id, path, 'default' FROM fx_paths WHERE NOT {_TESTS} AND p_size BETWEEN 34 AND 37""")
def _(spark, sf):
    return extract.extract_exports(_clean(spark, sf))


@query("c03_python_exports", "SELECT repo_id, path, 'f' || file_id AS symbol FROM fx_paths UNION ALL SELECT repo_id, path, 'C' || file_id FROM fx_paths")
def _(spark, sf):
    key = F.col("file_id").cast("string")
    text = F.concat(F.lit("def f"), key, F.lit("(a):\n  def inner(): pass\nclass C"), key, F.lit(":\n  pass\n"))
    return extract.extract_exports(table(spark, sf, "fx_paths").withColumn("content", text), "python")


@query("c04_test_imports", f"""SELECT repo_id, path, s || '_' || up_id AS symbol, {_SPEC} AS from_path
 FROM (SELECT *, unnest(['fn', 'v']) AS s FROM fx_links) WHERE up_id IS NOT NULL AND {_TEST_FILES}""")
def _(spark, sf):
    return extract.extract_test_imports(extract.without_comments(_tests(spark, sf)))


@query("c05_reexport_map", """SELECT repo_id, path AS index_path, 'fn_' || up_id AS symbol, up_path AS source_path FROM fx_index
 UNION ALL SELECT repo_id, path, 'val_' || file_id, up_path FROM fx_index
 UNION ALL SELECT repo_id, path, '*', replace(path, 'm' || file_id || '/index.js', 'f' || file_id || '.js') FROM fx_index""")
def _(spark, sf):
    return extract.reexport_map(table(spark, sf, "fx_index"))


@query("c06_rule_scan", _HITS + " SELECT repo_id, path, CAST(line AS INT) AS line, rule, severity, snippet FROM hits")
def _(spark, sf):
    return extract.rule_scan(table(spark, sf, "fx_sources"), RULES).drop("message")


@query("k03_user_rule_pack", _HITS + " SELECT rule, count(*) AS n FROM hits GROUP BY rule")
def _(spark, sf):
    pack = spark.createDataFrame([(r.id, r.pattern, r.severity, r.message, "") for r in RULES],
                                 "id string, pattern string, severity string, message string, language string")
    return extract.rule_scan(table(spark, sf, "fx_sources"), pack).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("b12_min_severity", _HITS + " SELECT rule, count(*) AS n FROM hits WHERE severity IN ('error', 'warning') GROUP BY rule")
def _(spark, sf):
    return extract.min_severity(extract.rule_scan(table(spark, sf, "fx_sources"), RULES)).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"))


@query("f20_scan_stats", _HITS + """ SELECT coalesce(severity, 'total') AS severity, count(*) AS issues FROM hits GROUP BY ROLLUP(severity)""")
def _(spark, sf):
    from repotide.operators.audits import scan_stats
    return scan_stats(extract.rule_scan(table(spark, sf, "fx_sources"), RULES))


@query("c06_language_rules", f"""SELECT rule, count(*) AS n FROM (
  SELECT 'todo-fixme' AS rule FROM fx_paths WHERE NOT {_TESTS} AND p_size BETWEEN 10 AND 24
  UNION ALL SELECT 'no-console' FROM fx_paths WHERE NOT {_TESTS} AND p_size < 20
  UNION ALL SELECT unnest(['no-eval', 'no-debugger', 'no-var', 'no-secret']) FROM fx_paths WHERE NOT {_TESTS} AND p_size > 48) GROUP BY rule""")
def _(spark, sf):
    rules = extract.rules_for(extract.PACK_SCAN, "javascript")
    return extract.rule_scan(_code(spark, sf), rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("c07_module_rules", f"""SELECT message, severity, count(*) AS n FROM (
  SELECT 'TODO comment' AS message, 'info' AS severity FROM fx_paths WHERE NOT {_TESTS} AND p_size BETWEEN 10 AND 24
  UNION ALL SELECT 'console statement', 'low' FROM fx_paths WHERE NOT {_TESTS} AND p_size < 20
  UNION ALL SELECT unnest(['eval() usage', 'Hardcoded secret']), 'high' FROM fx_paths WHERE NOT {_TESTS} AND p_size > 48
  UNION ALL SELECT 'debugger statement', 'medium' FROM fx_paths WHERE NOT {_TESTS} AND p_size > 48) GROUP BY message, severity""")
def _(spark, sf):
    return extract.rule_scan(_code(spark, sf), extract.PACK_MODULE).groupBy("message", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("c08_smell_scan", f"""WITH t AS (SELECT *, 1 + CASE WHEN up_id IS NULL THEN 0 ELSE 1 END + CASE WHEN jump_id IS NULL OR p_size <= 40 THEN 0 ELSE 1 END + CASE WHEN p_size > 46 THEN 2 ELSE 0 END + 1 AS l0
     FROM fx_links WHERE {_TESTS})
 SELECT repo_id, path, 'weak' AS type, CAST(l0 + 1 AS INT) AS line, 'toBeDefined()' AS description FROM (SELECT *, unnest([1, 2]) FROM t WHERE p_size BETWEEN 21 AND 30)
 UNION ALL SELECT repo_id, path, 'skipped', CAST(l0 + 2 AS INT), 'skipped' FROM t WHERE p_size > 44
 UNION ALL SELECT repo_id, path, 'commented', CAST(l0 + 3 AS INT), 'commented out' FROM t WHERE p_size BETWEEN 15 AND 18
 UNION ALL SELECT repo_id, path, 'commented', CAST(l0 + 4 AS INT), 'block commented out' FROM t WHERE p_size BETWEEN 15 AND 18
 UNION ALL SELECT repo_id, path, 'flaky', CAST(l0 + 3 AS INT), unnest(['setTimeout', 'Date.now()']) FROM t WHERE p_size BETWEEN 10 AND 14""")
def _(spark, sf):
    return extract.smell_scan(_tests(spark, sf)).select("repo_id", "path", "type", "line", "description")


@query("f21_smell_stats", f"""SELECT repo_id, sum(CASE WHEN p_size BETWEEN 21 AND 30 THEN 2 ELSE 0 END)::BIGINT AS weak, count(*) FILTER (p_size > 44) AS skipped,
   sum(CASE WHEN p_size BETWEEN 15 AND 18 THEN 2 ELSE 0 END)::BIGINT AS commented, sum(CASE WHEN p_size BETWEEN 10 AND 14 THEN 2 ELSE 0 END)::BIGINT AS flaky
 FROM fx_paths WHERE {_TESTS} GROUP BY repo_id HAVING weak + skipped + commented + flaky > 0""")
def _(spark, sf):
    from repotide.operators.audits import smell_stats
    return smell_stats(extract.smell_scan(_tests(spark, sf)))


@query("c09_test_blocks", f"""SELECT repo_id, path, 'works ' || file_id AS name, p_size > 30 AS pseudo, p_size > 40 AS empty FROM fx_paths WHERE {_TEST_FILES}""")
def _(spark, sf):
    return extract.test_blocks(_tests(spark, sf)).select(
        "repo_id", "path", "name", "pseudo", "empty")


@query("c10_bracket_issues", """SELECT file_id, CAST(0 AS BIGINT) AS seq, 'HIGH' AS severity, 'Missing JSDoc in ' || p_name AS title, 'src/f' || file_id || '.js' AS file,
   p_size AS line, 'no documentation' AS description, 'add it' AS suggestion, 'missing_jsdoc' AS type, true AS fixable FROM fx_audits WHERE layout = 'bracket'
 UNION ALL SELECT file_id, 1, CASE WHEN p_size > 10 THEN 'CRITICAL' ELSE 'LOW' END, CASE WHEN p_size > 15 THEN '[FIXED] ' ELSE '' END || 'Event naming of ' || p_name, '', 0,
   'event ' || p_size, '', 'event_naming', p_size <= 10 FROM fx_audits WHERE layout = 'bracket'""")
def _(spark, sf):
    docs = table(spark, sf, "fx_audits")
    ids = docs.select("repo_id", "module_path", "file_id")
    return audit_docs.parse_bracket_issues(docs).join(ids, ["repo_id", "module_path"]).select(
        "file_id", "seq", "severity", "title", "file", "line", "description", "suggestion", "type", "fixable")


_ISSUES = """WITH i AS (
  SELECT file_id, repo_id, module_path, 0 AS seq, 'Missing JSDoc in ' || p_name AS tail, 'error' AS severity, false AS fixed FROM fx_audits WHERE layout = 'bracket'
  UNION ALL SELECT file_id, repo_id, module_path, 1, 'Event naming of ' || p_name, CASE WHEN p_size > 10 THEN 'critical' ELSE 'info' END, p_size > 15 FROM fx_audits WHERE layout = 'bracket'
  UNION ALL SELECT file_id, repo_id, module_path, 0, 'Deprecated call in ' || p_name, 'info', p_size > 32 FROM fx_audits WHERE layout = 'numbered'
  UNION ALL SELECT file_id, repo_id, module_path, 1, 'Export of f' || file_id, 'error', false FROM fx_audits WHERE layout = 'numbered' AND p_size > 28
  UNION ALL SELECT file_id, repo_id, module_path, 0, 'eval in ' || p_name, 'error', false FROM fx_audits WHERE layout = 'checklist'
  UNION ALL SELECT file_id, repo_id, module_path, 1, 'secret ' || file_id, 'error', true FROM fx_audits WHERE layout = 'checklist'
  UNION ALL SELECT file_id, repo_id, module_path, 2, 'note ' || p_size, 'info', true FROM fx_audits WHERE layout = 'checklist'
  UNION ALL SELECT file_id, repo_id, module_path, 3, '[warning] slow ' || p_name, 'warning', false FROM fx_audits WHERE layout = 'checklist')"""


@query("c10_parse_audit", _ISSUES + " SELECT repo_id, module_path, tail AS title, severity, fixed FROM i")
def _(spark, sf):
    title = F.regexp_replace("title", r"^\[(HIGH|CRITICAL|LOW)\] ", "")
    return audit_docs.parse_audit(table(spark, sf, "fx_audits")).select(
        "repo_id", "module_path", title.alias("title"), "severity", "fixed")


@query("a08_audit_documents", _ISSUES + " SELECT repo_id, severity, count(*) AS issues, count(*) FILTER (fixed) AS fixed FROM i GROUP BY repo_id, severity")
def _(spark, sf):
    return audit_docs.parse_audit(table(spark, sf, "fx_audits")).groupBy("repo_id", "severity").agg(
        F.count(F.lit(1)).alias("issues"), F.count_if("fixed").alias("fixed"))


@query("c11_audit_header", """SELECT repo_id, module_path, CASE layout WHEN 'bracket' THEN 'medium' WHEN 'numbered' THEN 'high' ELSE 'unknown' END AS severity,
   CAST(CASE WHEN layout = 'bracket' THEN 2 WHEN layout = 'numbered' THEN CASE WHEN p_size > 28 THEN 2 ELSE 1 END ELSE 0 END AS BIGINT) AS issue_count FROM fx_audits""")
def _(spark, sf):
    return audit_docs.audit_header(table(spark, sf, "fx_audits"))


@query("c12_archive_kept", _ISSUES + """ SELECT repo_id, module_path, tail AS title, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS number FROM i WHERE NOT fixed""")
def _(spark, sf):
    kept = audit_docs.archive_issues(audit_docs.parse_audit(table(spark, sf, "fx_audits")))[1]
    return kept.select("repo_id", "module_path", F.regexp_replace("title", r"^\[(HIGH|CRITICAL|LOW)\] ", "").alias("title"), "number")


@query("c12_archive_documents", _ISSUES + """ SELECT repo_id, module_path, count(*) FILTER (fixed) AS archived, count(*) FILTER (NOT fixed) AS kept,
   CASE WHEN count(*) FILTER (NOT fixed) = 0 THEN 'NONE' END AS new_severity FROM i GROUP BY repo_id, module_path""")
def _(spark, sf):
    return audit_docs.archive_issues(audit_docs.parse_audit(table(spark, sf, "fx_audits")))[2]


@query("f19_audit_matrix", _ISSUES + """ SELECT repo_id, CASE WHEN grouping(module_path) = 1 THEN 'TOTAL' ELSE module_path END AS module,
   count(*) FILTER (NOT fixed AND severity = 'critical') AS critical, count(*) FILTER (NOT fixed AND severity = 'error') AS error,
   count(*) FILTER (NOT fixed AND severity = 'warning') AS warning, count(*) FILTER (NOT fixed AND severity = 'info') AS info,
   count(*) FILTER (fixed) AS fixed, count(*) AS total FROM i GROUP BY GROUPING SETS ((repo_id, module_path), (repo_id))""")
def _(spark, sf):
    from repotide.operators.audits import audit_matrix
    return audit_matrix(audit_docs.parse_audit(table(spark, sf, "fx_audits")))


@query("c13_task_dependencies", """SELECT project_id, task_id, regexp_extract(d, '\\[([0-9]+)\\]', 1) AS dep FROM (
   SELECT project_id, task_id, unnest(regexp_extract_all(description, '(?i)(?:blocked by|depends on:|requires) \\[[0-9]+\\]')) AS d FROM fx_board)""")
def _(spark, sf):
    return extract.parse_task_deps(table(spark, sf, "fx_board"))


@query("c14_doc_comment_coverage", f"""SELECT repo_id, path, CASE WHEN {_TESTS} THEN 0 ELSE 3 + CASE WHEN p_size BETWEEN 28 AND 33 THEN 2 WHEN p_size BETWEEN 34 AND 37 THEN 1 ELSE 0 END END
     - CASE WHEN {_TESTS} THEN 0 ELSE 1 END AS exports,
   CASE WHEN p_size > 25 AND NOT {_TESTS} THEN 1 ELSE 0 END AS documented FROM fx_paths""")
def _(spark, sf):
    got = extract.doc_comment_coverage(_code(spark, sf))
    return got.select("repo_id", "path", "exports", "documented")


@query("c14_module_average", f"""WITH c AS (SELECT repo_id, dir, CASE WHEN {_TESTS} THEN 100 WHEN p_size <= 25 THEN 0
     ELSE floor(100.0 / (2 + CASE WHEN p_size BETWEEN 28 AND 33 THEN 2 WHEN p_size BETWEEN 34 AND 37 THEN 1 ELSE 0 END) + 0.5) END AS coverage FROM fx_paths)
 SELECT repo_id, dir, CAST(floor(sum(coverage) / count(*) + 0.5) AS BIGINT) AS coverage FROM c GROUP BY repo_id, dir""")
def _(spark, sf):
    from repotide.functions.paths import dir_name
    from repotide.functions.text import round_half_up
    got = extract.doc_comment_coverage(_code(spark, sf)).withColumn("dir", dir_name(F.col("path")))
    return got.groupBy("repo_id", "dir").agg(round_half_up(F.sum("coverage") / F.count(F.lit(1))).alias("coverage"))


@query("c24_acceptance_items", """SELECT task_id, CAST(p AS INT) AS pos, CASE p WHEN 0 THEN 'total checked' ELSE 'shipped' END AS item,
   CASE p WHEN 0 THEN contains(description, '[x] total') ELSE contains(description, '[x] shipped') END AS done FROM (SELECT *, unnest([0, 1]) AS p FROM fx_board)""")
def _(spark, sf):
    return extract.acceptance_items(table(spark, sf, "fx_board")).select("task_id", "pos", "item", "done")


@query("c24_acceptance_share", """WITH s AS (SELECT task_id, CAST(contains(description, '[x] total') AS INT) + CAST(contains(description, '[x] shipped') AS INT) AS d FROM fx_board)
 SELECT task_id, 2 AS items, d AS done, d * 50 AS share_done FROM s""")
def _(spark, sf):
    return extract.acceptance_share(extract.acceptance_items(table(spark, sf, "fx_board"))).drop("project_id")


_L1 = "1 + CASE WHEN up_id IS NULL THEN 0 ELSE 1 END + CASE WHEN jump_id IS NULL OR p_size <= 40 THEN 0 ELSE 1 END + CASE WHEN p_size > 46 THEN 2 ELSE 0 END"


@query("c15_undocumented_exports", f"SELECT repo_id, path, CAST({_L1} + 1 AS INT) AS line FROM fx_links WHERE NOT {_TESTS} AND p_size <= 25")
def _(spark, sf):
    return entropy.undocumented_exports(_code(spark, sf)).select("repo_id", "path", "line")


@query("c16_todo_markers", f"SELECT repo_id, path, CAST({_L1} + CASE WHEN p_size < 20 THEN 4 ELSE 2 END AS INT) AS line FROM fx_links WHERE NOT {_TESTS} AND p_size BETWEEN 10 AND 24")
def _(spark, sf):
    return entropy.todo_markers(_code(spark, sf)).select("repo_id", "path", "line")


@query("c17_console_residue", f"SELECT repo_id, path, CAST({_L1} + 2 AS INT) AS line FROM fx_links WHERE NOT {_TESTS} AND p_size < 20")
def _(spark, sf):
    return entropy.console_residue(_code(spark, sf)).select("repo_id", "path", "line")


@query("c18_swallowed_errors", f"""SELECT repo_id, path, CAST({_L1} + CASE WHEN p_size > 42 THEN 3 ELSE 4 END AS INT) AS line, CASE WHEN p_size > 42 THEN 'bare rethrow' ELSE 'empty catch' END AS detail FROM fx_links WHERE NOT {_TESTS} AND p_size > 38""")
def _(spark, sf):
    return entropy.swallowed_errors(_code(spark, sf)).select("repo_id", "path", "line", "detail")


_GAPS = f"""WITH j AS (SELECT *, min(file_id) OVER (PARTITION BY repo_id, dir) AS a, max(file_id) OVER (PARTITION BY repo_id, dir) AS b
   FROM fx_paths WHERE path LIKE '%.js' AND NOT {_TESTS}),
  i AS (SELECT DISTINCT repo_id, dir FROM j)
 SELECT repo_id, path FROM j WHERE file_id NOT IN (a, b) UNION ALL SELECT p.repo_id, p.path FROM fx_paths p JOIN i USING (repo_id, dir) WHERE p.path LIKE '%.test.js'"""


@query("c19_index_gaps", _GAPS)
def _(spark, sf):
    return entropy.index_gaps(table(spark, sf, "fx_dir_sources")).select("repo_id", "path")


_UNUSED = f"""WITH e AS (SELECT repo_id, path, file_id, 'fn_' || file_id AS symbol FROM fx_paths WHERE NOT {_TESTS} AND p_size <= 35
   UNION ALL SELECT repo_id, path, file_id, 'v_' || file_id FROM fx_paths WHERE NOT {_TESTS}
   UNION ALL SELECT repo_id, path, file_id, 'C_' || file_id FROM fx_paths WHERE NOT {_TESTS} AND p_size BETWEEN 28 AND 33),
  used AS (SELECT repo_id, unnest(['fn_' || up_id, 'v_' || up_id]) AS symbol FROM fx_links WHERE up_id IS NOT NULL)
 SELECT repo_id, path, symbol AS detail FROM e WHERE (repo_id, symbol) NOT IN (SELECT (repo_id, symbol) FROM used)"""


@query("c20_unused_exports", _UNUSED)
def _(spark, sf):
    return entropy.unused_exports(_code(spark, sf)).select("repo_id", "path", "detail")


@query("c21_async_without_try", f"SELECT repo_id, path, CAST({_L1} + 2 AS INT) AS line FROM fx_links WHERE NOT {_TESTS} AND p_size BETWEEN 36 AND 42")
def _(spark, sf):
    return entropy.async_without_try(_code(spark, sf)).select("repo_id", "path", "line")


@query("c22_mutual_imports", "SELECT a.repo_id, a.src, a.dst FROM fx_edges a JOIN fx_edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def _(spark, sf):
    return entropy.mutual_imports(table(spark, sf, "fx_edges"))


@query("c23_entropy_report", f"""WITH n AS (
   SELECT 1 AS check_id, 'undocumented export' AS check_name, 'medium' AS risk, (SELECT count(*) FROM fx_paths WHERE NOT {_TESTS} AND p_size <= 25) AS findings
   UNION ALL SELECT 2, 'todo marker', 'low', (SELECT count(*) FROM fx_paths WHERE NOT {_TESTS} AND p_size BETWEEN 10 AND 24)
   UNION ALL SELECT 3, 'console residue', 'medium', (SELECT count(*) FROM fx_paths WHERE NOT {_TESTS} AND p_size < 20)
   UNION ALL SELECT 4, 'swallowed error', 'high', (SELECT count(*) FROM fx_paths WHERE NOT {_TESTS} AND p_size > 38)
   UNION ALL SELECT 5, 'index export gap', 'medium', (SELECT count(*) FROM ({_GAPS})) UNION ALL SELECT 6, 'unused export', 'low', (SELECT count(*) FROM ({_UNUSED}))
   UNION ALL SELECT 7, 'async without try', 'high', (SELECT count(*) FROM fx_paths WHERE NOT {_TESTS} AND p_size BETWEEN 36 AND 42)
   UNION ALL SELECT 8, 'mutual import', 'high', (SELECT count(*) FROM fx_edges a JOIN fx_edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst))
 SELECT * FROM n UNION ALL SELECT 0, 'TOTAL', NULL, CAST(sum(findings) AS BIGINT) FROM n""")
def _(spark, sf):
    found = entropy.entropy_scan(_code(spark, sf), table(spark, sf, "fx_edges"), checks=(1, 2, 3, 4, 6, 7, 8))
    # The code fixture has no index files; the directory fixture has.
    gaps = entropy.entropy_scan(table(spark, sf, "fx_dir_sources"), checks=(5,))
    return entropy.entropy_report(found.unionByName(gaps))
