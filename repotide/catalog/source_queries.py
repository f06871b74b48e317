"""Sources, sinks, reports, board input."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from repotide.catalog.registry import query
from repotide.fixtures import table
from repotide.session import checkpoint_dir, cut_counting, release
from repotide.sources import board, files, reports


@query("a01_file_inventory", """SELECT repo_id, path, dir, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '\\.[^./]+$') AS ext
 FROM fx_files WHERE path LIKE '%.js' OR path LIKE '%.py'""")
def _(spark, sf):
    return files.scan_snapshot(table(spark, sf, "fx_files")).select("repo_id", "path", "dir", "name", "ext")


FILES_A_TASK = 1000  # files of the tree that a task writes


def _write_files(root):
    """Writer of Arrow batches (id, repo_id, folder, value) as one text file a row, in folders named as Spark names partitions."""
    special = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
    name = lambda v: special.sub(lambda m: f"%{ord(m[0]):02X}", v) if v else "__HIVE_DEFAULT_PARTITION__"

    def write(batches):
        made = set()
        for batch in batches:
            for row in batch.to_pylist():
                place = os.path.join(root, f"repo_id={name(row['repo_id'])}", f"folder={name(row['folder'])}")
                if place not in made:
                    os.makedirs(place, exist_ok=True)
                    made.add(place)
                # The number is the row's, so a task that runs twice writes the same files.
                with open(os.path.join(place, f"part-{row['id']}.txt"), "wb") as out:
                    out.write((row["value"] or "").encode() + b"\n")
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})
    return write


def write_tree(code, root, rows):
    """One text file per row of ``code`` (repo_id, folder, value; a table made by ``cut``) below the URI ``root``.

    On a file system the tasks write plain files: Spark's writer starts a process for the permissions of each file
    and moves it twice. Other stores take Spark's writer. Either way a task gets a bounded share of the files.
    """
    tasks, place = rows // FILES_A_TASK + 1, re.sub("^file:(//)?(?=/)", "", root)
    if not place.startswith("/"):
        code.repartition(tasks).write.option("maxRecordsPerFile", 1).option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("repo_id", "folder").text(root)
        return
    numbered = code.withColumn("id", F.monotonically_increasing_id()).repartition(tasks)
    os.makedirs(place, exist_ok=True)
    written = numbered.mapInArrow(_write_files(place), "files long").agg(F.sum("files")).first()[0] or 0
    if written != rows:
        raise RuntimeError(f"{written} of {rows} files were written")


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a01_scanned_tree", """SELECT repo_id, 'folder=' || replace(replace(dir, '/', '.'), ' ', '_') AS dir, count(*) AS files,
  CAST(sum(octet_length(encode(content)) + 1) AS BIGINT) AS bytes, CAST(sum(length(content) - length(replace(content, chr(10), '')) + 2) AS BIGINT) AS lines
 FROM fx_code GROUP BY ALL""")
def _(spark, sf):
    # A tree of one file per source file, in folders by repository and directory, listed by its URI.
    root = _folder(spark, "tree")
    folder = F.translate("dir", "/ ", "._").alias("folder")
    code, size = cut_counting(table(spark, sf, "fx_code").select("repo_id", folder, F.col("content").alias("value")))
    write_tree(code, root, size["rows"])
    release(code)
    found = files.scan_files(spark, root, extensions=(".txt",), with_content=True)
    return found.groupBy("repo_id", "dir").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"),
                                               F.sum("line_count").cast("bigint").alias("lines"))


@query("a03_graph_documents", "SELECT DISTINCT repo_id, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM fx_edges")
def _(spark, sf):
    # Documents of at most 256 importing files, in a folder per repository, read by their URI.
    root, part = _folder(spark, "graphs"), F.floor(F.col("src") / 256)
    node = table(spark, sf, "fx_edges").groupBy("repo_id", "src").agg(
        F.struct(F.collect_set(F.col("dst").cast("string")).alias("imports")).alias("node"))
    docs = node.groupBy("repo_id", part.alias("part")).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.map_from_entries(
        F.collect_list(F.struct(F.col("src").cast("string"), "node"))).alias("files"))).alias("value"))
    docs.select("repo_id", "value").write.option("maxRecordsPerFile", 1).partitionBy("repo_id").text(root)
    return files.read_graph_json(spark, root)[1]


@query("a03_graph_json", """SELECT repo_id, src, dst FROM (SELECT repo_id, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM fx_edges)""")
def _(spark, sf):
    edges = table(spark, sf, "fx_edges")
    # One document per importing file, as an artefact table would hold them.
    doc = edges.groupBy("repo_id", "src").agg(F.to_json(F.struct(F.map_from_arrays(
        F.array(F.col("src").cast("string")), F.array(F.struct(F.collect_set(F.col("dst").cast("string")).alias("imports")))
    ).alias("files"))).alias("doc"))
    return files.parse_graph_json(doc, "doc")[1]


@query("a03_test_map_json", """SELECT repo_id, source_path, 'm' || (file_id % 7) AS module, CASE WHEN mtime < TIMESTAMP '2001-06-01' THEN 'stale' ELSE 'covered' END AS status,
   't' || file_id AS test_path FROM (SELECT repo_id, file_id, path AS source_path, mtime FROM fx_files)""")
def _(spark, sf):
    f = table(spark, sf, "fx_files")
    status = F.when(F.col("mtime") < F.lit("2001-06-01").cast("timestamp_ntz"), "stale").otherwise("covered")
    one = F.struct(F.col("path"), status.alias("status"), F.array(F.concat(F.lit("t"), F.col("file_id").cast("string"))).alias("tests"))
    module = F.struct(F.map_from_arrays(F.array("path"), F.array(one)).alias("files"))
    doc = f.select("repo_id", F.to_json(F.struct(F.map_from_arrays(
        F.array(F.concat(F.lit("m"), (F.col("file_id") % 7).cast("string"))), F.array(module)).alias("modules"))).alias("doc"))
    return files.parse_test_map_json(doc, "doc")


@query("a04_jest_counts", """SELECT run_id, CASE WHEN price > 250000 THEN 9 WHEN st = 'P' THEN 0 ELSE 2 END AS total, CASE WHEN price > 250000 THEN 6 WHEN st = 'P' THEN 0 ELSE 1 END AS passed,
  CASE WHEN price > 250000 THEN 2 WHEN st = 'F' THEN 1 ELSE 0 END AS failed, CASE WHEN price > 250000 THEN 1 WHEN st = 'O' THEN 1 ELSE 0 END AS skipped FROM fx_reports""")
def _(spark, sf):
    return reports.parse_test_reports(table(spark, sf, "fx_reports"), "jest")[0]


@query("a04_jest_failures", """SELECT run_id, 'tests/t' || cust || '.test.js' AS test_file, CASE st WHEN 'P' THEN '(suite)' ELSE 'b' END AS test,
  CASE st WHEN 'P' THEN 'suite broke' ELSE 'TypeError: bad ' || cust END AS message,
  CASE st WHEN 'P' THEN 'suite broke' || chr(10) || 'line two' ELSE 'TypeError: bad ' || cust || chr(10) || ' at x.js:3' END AS stack FROM fx_reports WHERE st IN ('P', 'F')""")
def _(spark, sf):
    return reports.parse_test_reports(table(spark, sf, "fx_reports"), "jest", "vitest")[1]


@query("a05_pytest_report", """SELECT run_id, CASE st WHEN 'F' THEN 1 ELSE 0 END AS failed, CASE st WHEN 'F' THEN 'tests/test_' || cust || '.py' END AS test_file,
  CASE st WHEN 'F' THEN 'assert ' || cust END AS message FROM fx_reports""")
def _(spark, sf):
    counts, failures = reports.parse_test_reports(table(spark, sf, "fx_reports"), "pytest", "pytest")
    return counts.join(failures, "run_id", "left").select("run_id", "failed", "test_file", "message")


@query("a06_go_events", """SELECT run_id, CASE st WHEN 'F' THEN 0 ELSE 1 END AS passed, CASE st WHEN 'F' THEN 1 ELSE 0 END AS failed, CASE st WHEN 'F' THEN 'Test' || cust END AS test FROM fx_reports""")
def _(spark, sf):
    counts, failures = reports.parse_test_reports(table(spark, sf, "fx_reports"), "go", "go")
    return counts.join(failures, "run_id", "left").select("run_id", "passed", "failed", "test")


@query("a07_text_report", """SELECT run_id, cust + 3 + CASE st WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS total, cust AS passed, CASE st WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS failed,
   CAST(3 AS BIGINT) AS skipped FROM fx_reports""")
def _(spark, sf):
    return reports.parse_test_text(table(spark, sf, "fx_reports"), "txt", "exit_code")


@query("a07_file_summary", """SELECT run_id, cust AS passed, CASE st WHEN 'F' THEN 4 ELSE 2 END AS failed FROM fx_reports""")
def _(spark, sf):
    n = F.col("cust").cast("string")
    tail = F.when(F.col("st") == "F", F.concat(F.lit("Test Files  1 passed (1)\n Test Files  "), n, F.lit(" passed ("), n, F.lit(") | 4 failed"))).when(
        F.col("st") == "P", F.concat(F.lit("Test Files  "), n, F.lit(" passed ("), (F.col("cust") + 2).cast("string"), F.lit(")"))).otherwise(
        F.concat(F.lit("Test Files  2 failed | "), n, F.lit(" passed (9)")))
    return reports.parse_file_summary(table(spark, sf, "fx_reports").withColumn("tail", tail), "tail")


@query("a09_change_set", """SELECT repo_id, path, CASE WHEN max(CASE WHEN status IN ('failed', 'pending') THEN 1 ELSE 0 END) = 1
    THEN min(CASE WHEN status IN ('failed', 'pending') THEN 'M' END) ELSE min('A') END AS status
 FROM (SELECT repo_id, 'm' || module_id || CASE WHEN module_id >= 100 THEN '.md' ELSE '.ts' END AS path, status FROM fx_tasks) WHERE path LIKE '%.ts' GROUP BY repo_id, path""")
def _(spark, sf):
    staged = F.col("status").isin("failed", "pending")
    name = F.concat(F.lit("m"), F.col("module_id").cast("string"), F.when(F.col("module_id") >= 100, ".md").otherwise(".ts"))
    changes = table(spark, sf, "fx_tasks").select(
        "repo_id", name.alias("path"), F.when(staged, "staged").otherwise("unstaged").alias("stage"),
        F.when(staged, "M100").otherwise("A").alias("status"))
    return files.change_set(changes)


@query("a10_task_import", """SELECT o_orderkey, 'Task ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'text' ELSE '' END AS description, 'todo' AS status,
   CASE o_orderstatus WHEN 'F' THEN 0 ELSE 2 END AS priority, CASE o_orderstatus WHEN 'F' THEN 'a|b' ELSE '' END AS tags FROM orders""")
def _(spark, sf):
    key = F.col("o_orderkey").cast("string")
    doc = F.when(F.col("o_orderstatus") == "F", F.concat(
        F.lit('[{"title":"Task '), key, F.lit('","description":"text","priority":0,"tags":["a","b"]}]'))).otherwise(
        F.concat(F.lit('{"title":"Task '), key, F.lit('"}')))
    got = board.import_tasks(table(spark, sf, "orders").select("o_orderkey", doc.alias("doc")), "doc")
    return got.select("o_orderkey", "title", "description", "status", "priority", F.array_join("tags", "|").alias("tags"))


@query("a11_task_update", """SELECT o_orderkey AS task_id, CASE WHEN o_totalprice > 300000 THEN 'P' || o_orderkey ELSE 'Task ' || o_orderkey END AS title,
   CASE WHEN o_totalprice > 400000 THEN 0 ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 END AS priority,
   (SELECT count(*) FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'O') AS updated,
   (SELECT count(*) FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O') AS skipped
 FROM orders""".replace("CASE WHEN o_totalprice > 300000 THEN 'P'", "CASE WHEN o_totalprice > 300000 AND o_orderstatus <> 'O' THEN 'P'").replace(
    "CASE WHEN o_totalprice > 400000 THEN 0", "CASE WHEN o_totalprice > 400000 AND o_orderstatus <> 'O' THEN 0"))
def _(spark, sf):
    tasks = table(spark, sf, "fx_board").select("task_id", "title", "priority")
    updates = table(spark, sf, "orders").filter("o_totalprice > 300000").select(
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey")).alias("task_id"),
        F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_totalprice") > 400000, 0).alias("priority"))
    changed, counts = board.update_tasks(tasks, updates, ["title", "priority"])
    return changed.join(F.broadcast(counts))  # one row


@query("a12_issue_tasks", """SELECT p_partkey AS id, '[AUDIT/' || upper(p_type) || '] ' || p_brand || ': todo' AS title,
   CASE WHEN p_size > 40 THEN 0 WHEN p_size > 25 THEN 3 WHEN p_type = 'MEDIUM' THEN 2 ELSE 2 END AS priority,
   'audit|' || lower(p_type) || '|todo' AS tags FROM part""")
def _(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size")
    issues = p.select(F.lit("r").alias("repo_id"), F.concat("p_brand", F.lit("@"), F.col("p_partkey").cast("string")).alias("module"),
                      F.when(size > 40, "CRITICAL").when(size > 25, "low").alias("severity"), F.lit("todo").alias("type"),
                      F.lit(None).cast("string").alias("file"), size.alias("line"), F.col("p_name").alias("description"),
                      F.lit("x").alias("suggestion"))
    modules = p.select(F.lit("r").alias("repo_id"), F.concat("p_brand", F.lit("@"), F.col("p_partkey").cast("string")).alias("module"),
                       F.col("p_type").alias("module_severity"))
    got = board.issues_to_tasks(issues, modules)
    return got.select(F.split_part("module", F.lit("@"), F.lit(2)).cast("bigint").alias("id"),
                      F.regexp_replace("title", "@[0-9]+", "").alias("title"), "priority", F.array_join("tags", "|").alias("tags"))


@query("a12_module_tasks", """SELECT repo_id, dir AS module, '[AUDIT] ' || dir || ' (' || issue_count || ' issues)' AS title,
   CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority FROM fx_audit_dirs""")
def _(spark, sf):
    mods = table(spark, sf, "fx_audit_dirs").select(
        "repo_id", F.col("dir").alias("module"), F.col("severity").alias("module_severity"), F.col("issue_count").cast("bigint").alias("issue_count"))
    return board.modules_to_tasks(mods).select("repo_id", "module", "title", "priority")


@query("a13_history_sink", """SELECT repo_id, task_id, task_name, status FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, task_name ORDER BY updated_at DESC, task_id DESC) AS rn FROM fx_tasks) WHERE rn <= 20""")
def _(spark, sf):
    from repotide.operators.windows import keep_last
    target = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    kept = keep_last(table(spark, sf, "fx_tasks"), ["repo_id", "task_name"], [F.col("updated_at").desc(), F.col("task_id").desc()], 20)
    files.write_result(kept, target)
    return spark.read.parquet(target).select("repo_id", "task_id", "task_name", "status")


@query("a14_project_stack", """WITH d AS (SELECT repo_id || ':' || split_part(dir, '/', 1) AS repo_id, max(line_count) AS big, count(*) FILTER (path LIKE '%.test.%') AS tests,
    count(*) FILTER (path LIKE '%.py') AS py FROM fx_files GROUP BY 1)
 SELECT repo_id, CASE WHEN big >= 100 THEN 'javascript' WHEN py > 0 THEN 'python' ELSE 'unknown' END AS language,
   CASE WHEN big >= 100 THEN 'node' WHEN py > 0 THEN 'poetry' ELSE 'unknown' END AS framework,
   concat_ws(',', CASE WHEN big >= 100 THEN 'node' END, CASE WHEN py > 0 THEN 'python' END) AS technologies,
   CASE WHEN big >= 100 AND tests > 0 THEN 'vitest' WHEN big >= 100 THEN 'unknown' WHEN py > 0 THEN 'pytest' ELSE 'unknown' END AS test_framework,
   CASE WHEN big >= 100 THEN 'yarn' END AS package_manager FROM d""")
def _(spark, sf):
    f = table(spark, sf, "fx_files").withColumn("repo_id", F.concat("repo_id", F.lit(":"), F.split_part("dir", F.lit("/"), F.lit(1))))
    marker = F.array_compact(F.array(
        F.col("path"), F.when(F.col("line_count") >= 100, "package.json"), F.when(F.col("line_count") >= 100, "yarn.lock"),
        F.when(F.col("path").contains(".test."), "vitest.config.js"), F.when(F.col("path").endswith(".py"), "pyproject.toml")))
    return files.detect_stack(f.select("repo_id", F.explode(marker).alias("path")))


@query("a15_project_registry", "SELECT task_name AS project_path, max(updated_at) AS last_run, count(*) AS runs FROM fx_tasks GROUP BY task_name")
def _(spark, sf):
    return files.latest_projects(table(spark, sf, "fx_tasks").select(
        F.col("task_name").alias("project_path"), F.col("updated_at").alias("run_at")))
