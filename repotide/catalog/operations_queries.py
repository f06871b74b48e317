"""Test outcomes, batch runs, boards, trends, numbering and user hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from repotide.catalog.registry import query
from repotide.fixtures import table
from repotide.operators import enrich as hooks
from repotide.operators import ops, results, trends, windows

ERR = "SELECT repo_id, run_id, ts, test_id, test_path, message FROM fx_test_results WHERE status = 'failed'"
PCT = "CASE WHEN {1} > 0 THEN CAST(floor({0} * 100.0 / {1} + 0.5) AS BIGINT) ELSE 0 END"
PCT1 = "CASE WHEN {1} > 0 THEN CAST(floor({0} * 100.0 * 10 / {1} + 0.5) AS DOUBLE) / 10 ELSE 0.0 END"


def _results(spark, sf):
    return table(spark, sf, "fx_test_results")


def _errors(spark, sf):
    return _results(spark, sf).filter("status = 'failed'")


def _tasks(spark, sf):
    return table(spark, sf, "fx_tasks")


_SUMMARY = f"""e AS ({ERR}), t AS (SELECT *, CASE WHEN message LIKE 'TypeError%' THEN 'TypeError' ELSE 'Other' END AS kind FROM e),
  k AS (SELECT repo_id, test_path, kind, count(*) AS n, min(run_id) AS f FROM t GROUP BY 1, 2, 3), m AS (SELECT repo_id, test_path, CAST(sum(n) AS BIGINT) AS count, first(kind ORDER BY n DESC, f) AS main_type FROM k GROUP BY 1, 2),
  s AS (SELECT *, row_number() OVER (PARTITION BY repo_id, test_path ORDER BY run_id) AS rn, CASE WHEN length(message) > 70 THEN substr(message, 1, 69) || '…' ELSE message END AS line FROM e),
  summary AS (SELECT m.*, max(CASE WHEN rn = 1 THEN line END) AS sample_1, max(CASE WHEN rn = 2 THEN line END) AS sample_2 FROM m JOIN s USING (repo_id, test_path) WHERE rn <= 2 GROUP BY ALL)"""


def _summary(spark, sf):
    return results.error_summary(_errors(spark, sf).withColumn("seq", F.col("run_id")))


@query("f23_error_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def _(spark, sf):
    return _summary(spark, sf)


@query("h03_top_failures", f"WITH {_SUMMARY} SELECT * FROM summary ORDER BY count DESC, repo_id, test_path LIMIT 12")
def _(spark, sf):
    return results.top_failures(_summary(spark, sf))


@query("f24_error_types", f"WITH e AS ({ERR}) SELECT repo_id, CASE WHEN message LIKE 'TypeError%' THEN 'TypeError' WHEN message LIKE 'expect%' THEN 'AssertionError' ELSE 'Unknown' END AS type, count(*) AS n FROM e GROUP BY 1, 2")
def _(spark, sf):
    return results.error_type_counts(_errors(spark, sf))


@query("f24_error_patterns", f"""WITH e AS ({ERR}) SELECT repo_id, pattern, count(*) AS n FROM (SELECT repo_id, unnest(CASE WHEN message LIKE 'Cannot find%' THEN ['import_failure'] WHEN message LIKE '%timed out%' THEN ['timeout']
   WHEN message LIKE 'jest.mock%' THEN ['mock_issue', 'env_missing_globals'] ELSE ['other'] END) AS pattern FROM e) GROUP BY 1, 2""")
def _(spark, sf):
    return results.error_pattern_counts(_errors(spark, sf))


@query("f25_result_summary", """SELECT repo_id, count(*) AS total, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM fx_test_results GROUP BY 1""")
def _(spark, sf):
    return results.result_summary(_results(spark, sf))


@query("f31_duration_estimate", """WITH h AS (SELECT repo_id, run_id, count(*) AS files, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM fx_test_results GROUP BY 1, 2)
 SELECT repo_id, CAST(floor(avg(duration_ms / files) * 40 + 0.5) AS BIGINT) AS estimate_ms FROM h WHERE files > 0 AND duration_ms > 0 GROUP BY 1""")
def _(spark, sf):
    history = _results(spark, sf).groupBy("repo_id", "run_id").agg(F.count(F.lit(1)).alias("files"), F.sum("duration_ms").alias("duration_ms"))
    return results.estimate_duration(history, 40)


_STATE = "count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ops.STATES)


@query("f26_task_summary", f"SELECT repo_id, task_name, {_STATE} FROM fx_tasks GROUP BY 1, 2")
def _(spark, sf):
    return ops.task_summary(_tasks(spark, sf), "task_name")


_RUNS = """runs AS (SELECT repo_id, task_name, run_day, count(*) AS processed, count(*) FILTER (status IN ('failed', 'timeout')) AS failed, array_to_string(list_sort(list_distinct(list(status || '=' || n))), ',') AS by_status
  FROM (SELECT *, count(*) OVER (PARTITION BY repo_id, task_name, run_day, status) AS n FROM fx_tasks) GROUP BY 1, 2, 3)"""


def _runs(spark, sf):
    items = _tasks(spark, sf).withColumn("success", ~F.col("status").isin("failed", "timeout"))
    return ops.run_summary(items, ["repo_id", "task_name", "run_day"])


@query("f27_run_summary", f"WITH {_RUNS} SELECT repo_id, task_name, run_day, processed, failed, CASE WHEN failed = 0 THEN 'success' ELSE 'completed_with_errors' END AS status, by_status FROM runs")
def _(spark, sf):
    shown = F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _runs(spark, sf).withColumn("by_status", shown)


@query("f28_success_rate", f"SELECT repo_id, task_name, {PCT1.format(chr(39).join(['count(*) FILTER (status NOT IN (', 'failed', ', ', 'timeout', '))']), 'count(*)')} AS success_rate FROM fx_tasks GROUP BY 1, 2")
def _(spark, sf):
    return ops.success_rate(_runs(spark, sf), ["repo_id", "task_name"])


_ETA = """SELECT repo_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, CAST(floor(avg(duration_ms) FILTER (status = 'completed') + 0.5) AS BIGINT) AS a FROM fx_tasks GROUP BY 1"""


@query("f29_eta", f"""WITH n AS (SELECT max(updated_at) AS now FROM fx_tasks), x AS ({_ETA}), y AS (SELECT *, CAST(floor((pending + running) * a / 6 + 0.5) AS BIGINT) AS r FROM x)
 SELECT repo_id, pending, running, a AS avg_duration, r AS remaining_ms, epoch_ms(CAST(floor(epoch_us(n.now) / 1000) AS BIGINT) + r) AS completion FROM y, n""")
def _(spark, sf):
    tasks = _tasks(spark, sf)
    now = tasks.agg(F.max("updated_at").alias("now"))
    rows = ops.eta(tasks, F.lit("2000-01-01").cast("timestamp"))
    done = F.timestamp_millis(F.unix_millis(F.col("now").cast("timestamp")) + F.col("remaining_ms")).cast("timestamp_ntz")
    return rows.join(F.broadcast(now)).withColumn("completion", done).drop("now")  # one row


@query("f30_average_from_history", """WITH h AS (SELECT repo_id, run_day, count(*) AS processed, CAST(sum(duration_ms) AS BIGINT) AS duration, min(updated_at) AS s, max(updated_at) AS e, CASE WHEN repo_id = 'r0' THEN avg(duration_ms) END AS avg_d FROM fx_tasks GROUP BY 1, 2),
  v AS (SELECT repo_id, run_day, CASE repo_id WHEN 'r0' THEN floor(avg_d + 0.5) WHEN 'r1' THEN floor((epoch_us(e) - epoch_us(s)) / 1000 / processed + 0.5) ELSE floor(duration / processed + 0.5) END AS a FROM h)
 SELECT repo_id, CAST(arg_max(a, run_day) AS BIGINT) AS avg_duration FROM v WHERE a > 0 GROUP BY 1""")
def _(spark, sf):
    repo = F.col("repo_id")
    runs = _tasks(spark, sf).groupBy("repo_id", F.col("run_day").alias("run_at")).agg(
        F.count(F.lit(1)).alias("processed"), F.avg(F.when(repo == "r0", F.col("duration_ms"))).alias("avg_duration"),
        F.sum(F.when(repo != "r1", F.col("duration_ms"))).alias("duration"), F.min("updated_at").alias("started_at"), F.max("updated_at").alias("completed_at"))
    return ops.avg_from_history(runs)


@query("f32_task_overview", """WITH t AS (SELECT repo_id, unnest(['task_0', 'task_1', 'task_2', 'task_9']) AS task_name FROM (SELECT DISTINCT repo_id FROM fx_tasks)), res AS (SELECT repo_id, task_name, arg_max(status, task_id) AS status, max(updated_at) AS u, arg_max(duration_ms, task_id) AS p FROM fx_tasks WHERE task_name = 'task_0' GROUP BY 1, 2),
  his AS (SELECT repo_id, task_name, arg_max(status, task_id) AS status, max(updated_at) AS u, arg_max(duration_ms, task_id) AS p FROM fx_tasks WHERE task_name <> 'task_0' GROUP BY 1, 2)
 SELECT t.repo_id, t.task_name, coalesce(res.status, his.status, 'never_run') AS status, coalesce(res.u, his.u) AS last_run, coalesce(res.p, his.p) AS processed FROM t LEFT JOIN res USING (repo_id, task_name) LEFT JOIN his USING (repo_id, task_name)""")
def _(spark, sf):
    rows = _tasks(spark, sf).select("repo_id", "task_name", "status", F.col("updated_at").alias("run_at"), F.col("duration_ms").alias("processed"))
    types = rows.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, ("task_0", "task_1", "task_2", "task_9")))).alias("task_name"))
    return ops.task_overview(types, rows.filter("task_name = 'task_0'"), rows.filter("task_name <> 'task_0'"))[0]


@query("f33_board_status", """SELECT project_id, count(*) FILTER (status = 'todo') AS todo, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'todo' AND priority = 0) AS p0_todo FROM fx_board GROUP BY 1""")
def _(spark, sf):
    return ops.board_status(table(spark, sf, "fx_board"))


@query("f33_board_lists", "SELECT project_id, task_id, CASE status WHEN 'in_progress' THEN 'in_progress' ELSE 'p0_todo' END AS section FROM fx_board WHERE status = 'in_progress' OR (status = 'todo' AND priority = 0)")
def _(spark, sf):
    return ops.board_lists(table(spark, sf, "fx_board")).select("project_id", "task_id", "section")


@query("f34_board_context", """WITH d AS (SELECT *, row_number() OVER (PARTITION BY project_id, status ORDER BY priority, task_id) AS rn FROM fx_board)
 SELECT project_id, task_id, CASE WHEN status = 'in_progress' THEN 'in_progress' WHEN status = 'done' THEN 'done' WHEN priority = 0 THEN 'p0' WHEN priority = 1 THEN 'p1' ELSE 'p2_plus' END AS section,
   CASE WHEN status = 'todo' AND priority = 1 THEN CASE WHEN length(description) > 60 THEN substr(description, 1, 60) || chr(10) || '...(truncated)' ELSE description END WHEN status = 'todo' AND priority > 1 THEN ''
     WHEN status = 'done' THEN array_to_string(string_split(description, chr(10))[1:2], chr(10)) || chr(10) || '...(truncated)' ELSE description END AS shown FROM d WHERE status <> 'done' OR rn <= 3""")
def _(spark, sf):
    return ops.board_context(table(spark, sf, "fx_board"), done_lines=2, long_text=60).select("project_id", "task_id", "section", "shown")


@query("f42_priority_counts", "SELECT project_id, priority, count(*) AS tasks FROM fx_board GROUP BY 1, 2")
def _(spark, sf):
    return ops.priority_counts(table(spark, sf, "fx_board"))


_TREND = """days AS (SELECT DISTINCT repo_id, day FROM fx_snapshots), mods AS (SELECT DISTINCT repo_id, module_id FROM fx_snapshots), grid AS (SELECT d.repo_id, d.day, m.module_id, coalesce(s.issues, 0) AS cur FROM days d JOIN mods m USING (repo_id) LEFT JOIN fx_snapshots s USING (repo_id, day, module_id)),
  g2 AS (SELECT *, coalesce(lag(cur) OVER (PARTITION BY repo_id, module_id ORDER BY day), 0) AS prev FROM grid),
  tr AS (SELECT repo_id, day, CAST(sum(cur) AS BIGINT) AS total, CAST(sum(greatest(cur - prev, 0)) AS BIGINT) AS new, CAST(sum(greatest(prev - cur, 0)) AS BIGINT) AS resolved FROM g2 GROUP BY 1, 2)"""


@query("f16_snapshot_trend", f"WITH {_TREND} SELECT *, CAST(sum(resolved) OVER (PARTITION BY repo_id ORDER BY day) AS BIGINT) AS total_resolved FROM tr")
def _(spark, sf):
    return trends.snapshot_trend(table(spark, sf, "fx_snapshots"))


@query("f16_total_trend", """WITH t AS (SELECT repo_id, day, CAST(sum(issues) AS BIGINT) AS total FROM fx_snapshots GROUP BY 1, 2), p AS (SELECT *, coalesce(lag(total) OVER (PARTITION BY repo_id ORDER BY day), 0) AS prev FROM t)
 SELECT repo_id, day, total, greatest(total - prev, 0) AS new, greatest(prev - total, 0) AS resolved FROM p""")
def _(spark, sf):
    totals = table(spark, sf, "fx_snapshots").groupBy("repo_id", "day").agg(F.sum("issues").alias("total"))
    return trends.total_trend(totals)


@query("f17_effective_snapshots", """WITH s AS (SELECT 'r' || user_id % 4 AS repo_id, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS taken_at, count(*) FILTER (event_type = 'error') AS total FROM events GROUP BY 1, 2, 3),
  p AS (SELECT *, lag(day) OVER w AS d, lag(total) OVER w AS t FROM s WINDOW w AS (PARTITION BY repo_id ORDER BY taken_at)) SELECT repo_id, day, taken_at, total FROM p WHERE d IS NULL OR d <> day OR t <> total""")
def _(spark, sf):
    e = table(spark, sf, "events")
    totals = e.groupBy(F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("repo_id"), F.to_date("ts").alias("day"),
                       F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("taken_at")).agg(F.count_if(F.col("event_type") == "error").alias("total"))
    return trends.effective_snapshots(totals)


@query("f18_resolution_rate", f"WITH {_TREND}, l AS (SELECT repo_id, arg_max(total, day) AS open, CAST(sum(resolved) AS BIGINT) AS resolved FROM tr GROUP BY 1) SELECT *, {PCT.format('resolved', '(open + resolved)')} AS resolved_percent FROM l")
def _(spark, sf):
    return trends.resolution_rate(trends.snapshot_trend(table(spark, sf, "fx_snapshots")))


@query("g04_running_total", """SELECT repo_id, task_id, CAST(sum(duration_ms) OVER (PARTITION BY repo_id ORDER BY updated_at, task_id) AS BIGINT) AS running_ms FROM fx_tasks""")
def _(spark, sf):
    return windows.running_sum(_tasks(spark, sf).select("repo_id", "task_id", "updated_at", "duration_ms"), ["repo_id"],
                               [F.col("updated_at"), F.col("task_id")], "duration_ms", "running_ms").select("repo_id", "task_id", "running_ms")


_COUNTS = "t AS (SELECT repo_id, day, CAST(sum(issues) AS BIGINT) AS n FROM fx_snapshots GROUP BY 1, 2), p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY repo_id ORDER BY day), 0) AS last FROM t)"


@query("g05_growth_alerts", f"WITH {_COUNTS} SELECT *, n - last AS change, n - last > 3 OR (n > 0 AND last = 0) AS notify FROM p")
def _(spark, sf):
    return trends.stale_alerts(table(spark, sf, "fx_snapshots").groupBy("repo_id", "day").agg(F.sum("issues").alias("n")))


@query("g05_change_alerts", f"WITH {_COUNTS} SELECT *, n - last AS change, abs(n - last) >= 3 OR (n > 0 AND last = 0) AS notify FROM p")
def _(spark, sf):
    return trends.stale_alerts(table(spark, sf, "fx_snapshots").groupBy("repo_id", "day").agg(F.sum("issues").alias("n")), "change")


@query("g02_keep_last", "SELECT repo_id, task_name, task_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, task_name ORDER BY updated_at DESC, task_id DESC) AS rn FROM fx_tasks) WHERE rn <= 10")
def _(spark, sf):
    return windows.keep_last(_tasks(spark, sf), ["repo_id", "task_name"], [F.col("updated_at").desc(), F.col("task_id").desc()], 10).select("repo_id", "task_name", "task_id")


@query("g03_first_wins", "SELECT repo_id, source_path, min(test_path) AS test_path FROM fx_test_map GROUP BY 1, 2")
def _(spark, sf):
    return windows.first_wins(table(spark, sf, "fx_test_map"), ["repo_id", "source_path"], [F.col("test_path")]).select("repo_id", "source_path", "test_path")


@query("g06_stable_numbering", f"WITH e AS ({ERR}) SELECT repo_id, run_id, test_id, row_number() OVER (PARTITION BY repo_id ORDER BY ts, run_id, test_id) AS id FROM e")
def _(spark, sf):
    return windows.number_rows(_errors(spark, sf), ["repo_id"], [F.col("ts"), F.col("run_id"), F.col("test_id")], "id").select("repo_id", "run_id", "test_id", "id")


@query("g08_page", f"""WITH e AS ({ERR}), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts, run_id, test_id) AS rn, count(*) OVER (PARTITION BY repo_id) AS total FROM e)
 SELECT repo_id, run_id, test_id, rn, total, 11 AS showing_from, least(30, total) AS showing_to, least(30, total) < total AS has_more, CASE WHEN least(30, total) < total THEN least(30, total) END AS next_offset FROM n WHERE rn > 10 AND rn <= 30""")
def _(spark, sf):
    rows = _errors(spark, sf).select("repo_id", "run_id", "test_id", "ts")
    return windows.page(rows, ["repo_id"], [F.col("ts"), F.col("run_id"), F.col("test_id")], 10, 20).drop("ts")


@query("g09_batches", f"WITH e AS ({ERR}) SELECT repo_id, run_id, test_id, (row_number() OVER (PARTITION BY repo_id ORDER BY ts, run_id, test_id) - 1) // 5 AS batch FROM e")
def _(spark, sf):
    return windows.batches(_errors(spark, sf), ["repo_id"], [F.col("ts"), F.col("run_id"), F.col("test_id")], 5).select("repo_id", "run_id", "test_id", "batch")


@query("i03_remaining_work", "SELECT DISTINCT repo_id, module_id FROM fx_tasks WHERE (repo_id, module_id) NOT IN (SELECT (repo_id, module_id) FROM fx_tasks WHERE task_name = 'task_3')")
def _(spark, sf):
    tasks = _tasks(spark, sf)
    items = tasks.select("repo_id", "module_id").distinct()
    return windows.remaining(items, tasks.filter("task_name = 'task_3'"), ["repo_id", "module_id"])


@query("i04_skip_fixed", f"WITH e AS ({ERR}) SELECT run_id, test_id FROM e WHERE run_id NOT IN (SELECT event_id FROM events WHERE value > 10)")
def _(spark, sf):
    fixed = table(spark, sf, "events").filter("value > 10").select(F.col("event_id").alias("run_id"))
    return results.unfixed(_errors(spark, sf), fixed, ["run_id"]).select("run_id", "test_id")


@query("i05_merge_results", """SELECT task_id, 'retried' AS status FROM fx_tasks WHERE status IN ('failed', 'timeout') UNION ALL SELECT task_id, status FROM fx_tasks WHERE status NOT IN ('failed', 'timeout')""")
def _(spark, sf):
    old = _tasks(spark, sf).select("task_id", "status")
    new = old.filter("status IN ('failed', 'timeout')").select("task_id", F.lit("retried").alias("status"))
    return windows.merge_results(old, new, ["task_id"])


@query("k01_enrich", """SELECT task_id, CASE WHEN status = 'failed' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN status <> 'failed' THEN upper(status) END AS result, CASE WHEN status = 'failed' THEN 'bad ' || task_id END AS error FROM fx_tasks""")
def _(spark, sf):
    def work(row):
        if row["status"] == "failed":
            raise ValueError(f"bad {row['task_id']}")
        return row["status"].upper()

    return hooks.enrich(_tasks(spark, sf).select("task_id", "status"), work, "task_id").select("task_id", "status", "result", "error")


@query("k02_retry", """SELECT task_id, 'failed' AS status, CASE status WHEN 'failed' THEN 4 ELSE 1 END AS attempts FROM fx_tasks WHERE status IN ('failed', 'timeout')""")
def _(spark, sf):
    def work(row):
        raise RuntimeError("rate limit" if row["status"] == "failed" else "not found")

    rows = _tasks(spark, sf).filter("status IN ('failed', 'timeout')").select("task_id", "status")
    return hooks.enrich(rows, work, "task_id", retries=3, transient=lambda e: "rate limit" in e).select("task_id", "status", "attempts")


@query("k04_tasks_from_files", "SELECT file_id, 'review ' || path AS title FROM fx_files")
def _(spark, sf):
    def build(part):
        return part.assign(title="review " + part["path"])[["file_id", "title"]]

    return hooks.tasks_from(table(spark, sf, "fx_files").select("file_id", "path"), build, "file_id bigint, title string")


@query("k05_sql_functions", "SELECT file_id, length(content) - 1 - CASE WHEN p_size < 20 AND path NOT LIKE '%.test.%' THEN 2 ELSE 0 END - CASE WHEN p_size BETWEEN 10 AND 24 AND path NOT LIKE '%.test.%' THEN 1 ELSE 0 END - CASE WHEN p_size BETWEEN 15 AND 18 AND path LIKE '%.test.%' THEN 3 ELSE 0 END - CASE WHEN p_size > 25 AND path NOT LIKE '%.test.%' THEN 2 ELSE 0 END AS stripped FROM fx_code")
def _(spark, sf):
    hooks.register_functions(spark)
    table(spark, sf, "fx_code").createOrReplaceTempView("k05_code")
    return spark.sql("SELECT file_id, CAST(length(strip_comments(content)) AS BIGINT) AS stripped FROM k05_code")


@query("k06_table_functions", "SELECT file_id, 'works ' || file_id AS name FROM fx_paths WHERE path LIKE '%.test.%'")
def _(spark, sf):
    hooks.register_functions(spark)
    table(spark, sf, "fx_code").createOrReplaceTempView("k06_code")
    return spark.sql("SELECT c.file_id, b.name FROM k06_code c, LATERAL test_blocks(c.content) b")


@query("k06_issue_table_function", """SELECT file_id, 'HIGH' AS severity FROM fx_audits WHERE layout = 'bracket' UNION ALL SELECT file_id, CASE WHEN p_size > 10 THEN 'CRITICAL' ELSE 'LOW' END FROM fx_audits WHERE layout = 'bracket'""")
def _(spark, sf):
    hooks.register_functions(spark)
    table(spark, sf, "fx_audits").createOrReplaceTempView("k06_audits")
    return spark.sql("SELECT a.file_id, i.severity FROM k06_audits a, LATERAL bracket_issues(a.content) i")
