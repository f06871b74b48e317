"""Scalar text functions over generated and given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from repotide.catalog.registry import query
from repotide.fixtures import table
from repotide.functions import text


@query("a02_head_lines", """SELECT file_id, CASE WHEN len(string_split(content, chr(10))) > 5
   THEN array_to_string(string_split(content, chr(10))[1:5], chr(10)) || chr(10) || '... (' || (len(string_split(content, chr(10))) - 5) || ' more lines)'
   ELSE content END AS head FROM fx_sources""")
def _(spark, sf):
    return table(spark, sf, "fx_sources").select("file_id", text.head_lines(F.col("content"), 5).alias("head"))


@query("b39_norm_severity", """SELECT repo_id, dir, CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'info' END AS level,
  CASE WHEN issue_count > 1 THEN 'error' END AS alias FROM fx_audit_dirs""")
def _(spark, sf):
    alias = F.when(F.col("issue_count") > 1, " Err ").otherwise("whatever")
    return table(spark, sf, "fx_audit_dirs").select(
        "repo_id", "dir", text.norm_severity(F.col("severity")).alias("level"), text.norm_severity(alias).alias("alias"))


_TITLES = [("JSDoc gone", "missing_jsdoc"), ("uses console.log", "console_log"), ("a FIXME", "todo_fixme"),
           ("Hardcoded port", "magic_number"), ("Event bad naming", "event_naming"), ("export of import unused", "export_missing"),
           ("import is unused", "unused_import"), ("no error handling", "missing_error_handling"),
           ("deprecated call", "deprecated_api"), ("slow loop", "unknown")]


@query("b40_issue_type", "SELECT p_partkey, CASE p_partkey % 10 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(_TITLES)) + " END AS issue_type FROM part")
def _(spark, sf):
    titles = F.array(*[F.lit(t) for t, _ in _TITLES])
    return table(spark, sf, "part").select("p_partkey", text.infer_issue_type(
        F.element_at(titles, (F.col("p_partkey") % 10 + 1).cast("int")), F.col("p_name")).alias("issue_type"))


@query("b41_fixable", "SELECT p_partkey, p_partkey % 10 <> 9 AND p_size > 25 AS fixable FROM part")
def _(spark, sf):
    types = F.array(*[F.lit(t) for _, t in _TITLES])
    kind = F.element_at(types, (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.is_fixable(
        kind, F.when(F.col("p_size") > 25, "HIGH").otherwise("CRITICAL")).alias("fixable"))


@query("b42_error_type", """SELECT run_id, test_id, CASE WHEN message LIKE 'TypeError%' THEN 'TypeError' WHEN message LIKE 'expect%' THEN 'AssertionError' ELSE 'Unknown' END AS report_type,
  CASE WHEN message LIKE 'TypeError%' THEN 'TypeError' ELSE 'Other' END AS plan_type FROM fx_test_results""")
def _(spark, sf):
    m = F.col("message")
    return table(spark, sf, "fx_test_results").select(
        "run_id", "test_id", text.error_type(m).alias("report_type"), text.error_type(m, variant="plan").alias("plan_type"))


@query("b43_error_patterns", """SELECT run_id, test_id, CASE WHEN message LIKE 'Cannot find%' THEN 'import_failure' WHEN message LIKE '%timed out%' THEN 'timeout'
   WHEN message LIKE 'jest.mock%' THEN 'mock_issue|env_missing_globals' ELSE 'other' END AS patterns FROM fx_test_results""")
def _(spark, sf):
    return table(spark, sf, "fx_test_results").select(
        "run_id", "test_id", F.array_join(text.error_patterns(F.col("message")), "|").alias("patterns"))


@query("b44_error_location", r"""SELECT run_id, test_id, nullif(regexp_extract(message, '(?:at\s+)?([^\s:]+):(\d+)(?::(\d+))?', 1), '') AS file,
  CAST(nullif(regexp_extract(message, '(?:at\s+)?([^\s:]+):(\d+)(?::(\d+))?', 2), '') AS INT) AS line,
  CAST(nullif(regexp_extract(message, '(?:at\s+)?([^\s:]+):(\d+)(?::(\d+))?', 3), '') AS INT) AS col FROM fx_test_results""")
def _(spark, sf):
    loc = text.error_location(F.col("message"))
    return table(spark, sf, "fx_test_results").select(
        "run_id", "test_id", loc["file"].alias("file"), loc["line"].alias("line"), loc["column"].alias("col"))


@query("b45_assertion", """SELECT r.run_id, r.test_id, CASE WHEN r.message LIKE 'expect%' THEN CAST(e.user_id AS VARCHAR) END AS expected,
  CASE WHEN r.message LIKE 'expect%' THEN e.event_type END AS received FROM fx_test_results r JOIN events e ON e.event_id = r.run_id""")
def _(spark, sf):
    a = text.assertion(F.col("message"))
    return table(spark, sf, "fx_test_results").select(
        "run_id", "test_id", a["expected"].alias("expected"), a["received"].alias("received"))


@query("b46_failure_class", """SELECT task_id, CASE status WHEN 'failed' THEN 'transient' WHEN 'timeout' THEN 'transient' WHEN 'running' THEN 'transient' ELSE 'other' END AS exit_class,
  CASE status WHEN 'failed' THEN 'transient' WHEN 'pending' THEN 'permanent' WHEN 'timeout' THEN 'transient' ELSE 'other' END AS message_class FROM fx_tasks""")
def _(spark, sf):
    s = F.col("status")
    code = F.when(s == "running", 429).otherwise(1)
    err = (F.when(s == "failed", "HTTP 429: too many requests").when(s == "pending", "404 not found")
           .when(s == "timeout", "rate limit").otherwise("boom"))
    return table(spark, sf, "fx_tasks").select(
        "task_id", text.failure_class(code, err).alias("exit_class"),
        text.failure_class(code, err, "message").alias("message_class"))


@query("b47_labels", """WITH m AS (SELECT task_id, duration_ms * task_id % 10000000 AS ms FROM fx_tasks),
 t AS (SELECT task_id, ms, CASE WHEN ms < 60000 THEN 1000 WHEN ms < 3600000 THEN 60000 ELSE 3600000 END AS u,
   CASE WHEN ms < 60000 THEN 's' WHEN ms < 3600000 THEN 'min' ELSE 'h' END AS x FROM m),
 r AS (SELECT *, CAST(floor(ms * 10 / u + 0.5) AS BIGINT) AS v FROM t)
 SELECT task_id, CASE WHEN ms < 1000 THEN ms || 'ms' ELSE (v // 10) || '.' || (v % 10) || x END AS label,
   CASE WHEN ms < 1000 THEN ms || ' ms' WHEN v % 10 = 0 THEN (v // 10) || ' ' || x ELSE (v // 10) || '.' || (v % 10) || ' ' || x END AS estimate,
   CASE WHEN ms < 60000 THEN (ms // 1000) || 's ago' WHEN ms < 3600000 THEN (ms // 60000) || 'm ago' WHEN ms < 86400000 THEN (ms // 3600000) || 'h ago'
     ELSE (ms // 86400000) || 'd ago' END AS age FROM r""")
def _(spark, sf):
    ms = F.col("duration_ms") * F.col("task_id") % 10000000
    label = text.duration_label(ms)
    return table(spark, sf, "fx_tasks").select(
        "task_id", label.alias("label"), text.estimate_label(label).alias("estimate"), text.age_label(ms).alias("age"))


@query("b48_truncate", "SELECT file_id, CASE WHEN length(content) > 40 THEN substr(content, 1, 39) || '…' ELSE content END AS short FROM fx_sources")
def _(spark, sf):
    return table(spark, sf, "fx_sources").select("file_id", text.truncate(F.col("content"), 40).alias("short"))


@query("b49_extract_json", """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN 'error' WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'P' THEN 'parse_error' ELSE 'unclear' END AS state,
  CASE WHEN o_orderpriority NOT LIKE '5%' AND o_orderstatus = 'F' THEN 'high' END AS severity, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS BIGINT) END AS fenced FROM orders""")
def _(spark, sf):
    st, key = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    answer = (F.when(st == "F", F.concat(F.lit('Sure {"severity":"high","n":'), key, F.lit("} done")))
              .when(st == "P", F.lit('{"severity": oops}')).otherwise("no idea"))
    fenced = F.when(st == "F", F.concat(F.lit('text\n```json\n{"n":'), key, F.lit("}\n```\n"))).otherwise("none")
    got = text.extract_json(answer, "severity STRING, n BIGINT", ok=~F.col("o_orderpriority").startswith("5"))
    block = text.extract_json(fenced, "n BIGINT", fenced=True)
    return table(spark, sf, "orders").select(
        "o_orderkey", got["status"].alias("state"), got["payload"]["severity"].alias("severity"),
        block["payload"]["n"].alias("fenced"))


@query("b50_line_count", "SELECT file_id, len(string_split(content, chr(10))) AS lines FROM fx_sources")
def _(spark, sf):
    return table(spark, sf, "fx_sources").select("file_id", text.line_count(F.col("content")).cast("bigint").alias("lines"))


@query("b51_verdict_files", """SELECT o_orderkey AS task_id, 'a' || o_custkey || '.js' AS path, 'passed' AS verdict FROM orders
 UNION ALL SELECT o_orderkey, 'b' || o_custkey || '.js', 'failed' FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT o_orderkey, 'c' || o_custkey || '.js', 'failed' FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, sf):
    from repotide.operators.results import verdict_files
    key, st = F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    failed = (F.when(st == "F", F.concat(F.lit('"b'), key, F.lit('.js"')))
              .when(st == "P", F.concat(F.lit('{"path":"c'), key, F.lit('.js","why":"x"}'))).otherwise(""))
    verdict = F.concat(F.lit('{"overall":"FAIL","passedFiles":["a'), key, F.lit('.js"],"failedFiles":['), failed, F.lit("]}"))
    return verdict_files(table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), verdict.alias("verdict_json")), "verdict_json")
