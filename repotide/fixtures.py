"""Repository-metadata views over the given tables, in SQL that Spark and DuckDB both accept.

The registered queries read these views; the oracle statements repeat the same text as ``WITH``
clauses. Each view covers its base tables whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

# One row per part: repository, index inside it, directory, path. Sizes choose the file kind.
VIEWS["fx_paths"] = """
SELECT p_partkey AS file_id, 'r' || CAST(p_partkey % 4 AS STRING) AS repo_id,
  CAST(floor(p_partkey / 4) AS BIGINT) AS k, p_size, p_name,
  lower(p_type) || '/' || lower(replace(p_brand, '#', '_'))
    || CASE WHEN p_size BETWEEN 26 AND 35 THEN '/deep' ELSE '' END AS dir,
  lower(p_type) || '/' || lower(replace(p_brand, '#', '_'))
    || CASE WHEN p_size BETWEEN 26 AND 35 THEN '/deep' ELSE '' END
    || '/f' || CAST(p_partkey AS STRING)
    || CASE WHEN p_name LIKE 'red %' THEN '.test' ELSE '' END
    || CASE WHEN p_size <= 5 THEN '.md' WHEN p_size <= 12 THEN '.py' ELSE '.js' END AS path
FROM part"""

# File inventory; the newest shipment is the modification time.
VIEWS["fx_files"] = """
SELECT p.file_id, p.repo_id, p.k, p.dir, p.path, p.p_size * 2 AS line_count, max(l.l_shipdate) AS mtime
FROM fx_paths p JOIN lineitem l ON l.l_partkey = p.file_id
GROUP BY p.file_id, p.repo_id, p.k, p.dir, p.path, p.p_size"""

# A document per directory with a markdown file, and per first-level directory with a large file.
VIEWS["fx_docs"] = """
SELECT repo_id, dir, max(mtime) AS doc_mtime FROM fx_files WHERE path LIKE '%.md' GROUP BY repo_id, dir
UNION ALL
SELECT repo_id, substr(dir, 1, instr(dir, '/') - 1) AS dir, max(mtime) AS doc_mtime
FROM fx_files WHERE line_count >= 98 AND path LIKE '%.js' GROUP BY repo_id, substr(dir, 1, instr(dir, '/') - 1)"""

# Import graph inside each repository: a halving tree, long jumps and back edges (so cycles exist).
VIEWS["fx_edges"] = """
SELECT DISTINCT repo_id, src, dst FROM (
  SELECT repo_id, file_id AS src, CAST(floor(k / 2) AS BIGINT) * 4 + file_id % 4 AS dst
    FROM fx_paths WHERE k > 0 AND p_size > 16
  UNION ALL
  SELECT b.repo_id, b.file_id, ((b.k * 7 + 3) % n.n) * 4 + b.file_id % 4
    FROM fx_paths b JOIN (SELECT repo_id, max(k) + 1 AS n FROM fx_paths GROUP BY repo_id) n
      ON n.repo_id = b.repo_id WHERE b.p_size > 46
  UNION ALL
  SELECT repo_id, CAST(floor(k / 2) AS BIGINT) * 4 + file_id % 4, file_id
    FROM fx_paths WHERE k > 0 AND p_size BETWEEN 20 AND 22
) e WHERE src <> dst"""

# Test files and the one or two files after them as their sources.
VIEWS["fx_test_map"] = """
SELECT t.repo_id, t.file_id AS test_id, t.path AS test_path, s.file_id AS source_id, s.path AS source_path,
  t.mtime AS test_mtime, s.mtime AS source_mtime
FROM fx_files t JOIN fx_files s ON s.repo_id = t.repo_id AND s.file_id IN (t.file_id + 4, t.file_id + 8)
WHERE t.path LIKE '%.test.%'"""

# Test outcomes over time: an event is a run of the test files with the user's index.
VIEWS["fx_test_results"] = """
SELECT t.repo_id, e.event_id AS run_id, e.ts, t.file_id AS test_id, t.path AS test_path,
  CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'passed' END AS status,
  CAST(floor(e.value * 100) AS BIGINT) AS duration_ms,
  CASE CAST(floor(e.value) AS BIGINT) % 5 WHEN 0 THEN 'TypeError: x is undefined at lib/a.js:' || CAST(e.user_id AS STRING) || ':7'
    WHEN 1 THEN 'Cannot find module ./x' WHEN 2 THEN 'expect(a).toBe(b) Expected: ' || CAST(e.user_id AS STRING) || ' Received: ' || e.event_type
    WHEN 3 THEN 'test timed out' ELSE 'jest.mock failed: window is not defined' END AS message
FROM events e JOIN fx_files t ON t.k = e.user_id WHERE t.path LIKE '%.test.%'"""

# Batch-run log.
VIEWS["fx_tasks"] = """
SELECT event_id AS task_id, 'r' || CAST(user_id % 4 AS STRING) AS repo_id, 'task_' || CAST(user_id % 5 AS STRING) AS task_name,
  user_id AS module_id, ts AS updated_at, CAST(ts AS DATE) AS run_day,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
    WHEN 'click' THEN 'timeout' ELSE 'completed' END AS status,
  CAST(floor(value * 100) AS BIGINT) AS duration_ms
FROM events"""

# Open issues per module and day.
VIEWS["fx_snapshots"] = """
SELECT 'r' || CAST(user_id % 4 AS STRING) AS repo_id, CAST(ts AS DATE) AS day, user_id AS module_id, count(*) AS issues
FROM events WHERE event_type = 'error' GROUP BY CAST(ts AS DATE), user_id"""

# Board tasks of eight projects with dependencies written into the description.
VIEWS["fx_board"] = """
SELECT o_orderkey AS task_id, 'p' || CAST(o_orderkey % 8 AS STRING) AS project_id,
  'Task ' || CAST(o_orderkey AS STRING) AS title,
  CASE o_orderstatus WHEN 'O' THEN 'todo' WHEN 'P' THEN 'in_progress' ELSE 'done' END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS priority, o_orderdate AS due_at,
  'Order of ' || CAST(o_custkey AS STRING) || chr(10) || '## Acceptance Criteria' || chr(10)
    || '- [' || CASE WHEN o_totalprice > 200000 THEN 'x' ELSE ' ' END || '] total checked' || chr(10)
    || '- [' || CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE ' ' END || '] shipped' || chr(10) || '## Notes' || chr(10)
    || CASE WHEN o_orderkey >= 24 AND floor(o_orderkey / 8) % 3 = 0
         THEN 'depends on: [' || CAST(CAST(floor(o_orderkey / 24) AS BIGINT) * 8 + o_orderkey % 8 AS STRING) || ']'
       WHEN floor(o_orderkey / 8) % 3 = 1 THEN 'Blocked by [' || CAST(o_orderkey - 8 AS STRING) || ']' ELSE '' END
    || CASE WHEN o_totalprice > 420000 THEN chr(10) || 'requires [' || CAST(o_orderkey + 8 AS STRING) || ']' ELSE '' END AS description
FROM orders"""

# Source-like texts for line rules.
VIEWS["fx_sources"] = """
SELECT doc_id AS file_id, source AS repo_id, lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path, text AS content FROM documents"""

# JavaScript text per file: imports of the tree parent and the long-jump target, exports,
# comments and findings chosen by size; tests hold test blocks.
VIEWS["fx_links"] = """
SELECT b.file_id, b.repo_id, b.k, b.p_size, b.dir, b.path,
  u.file_id AS up_id, u.path AS up_path, j.file_id AS jump_id, j.path AS jump_path,
  CASE WHEN b.dir LIKE '%/deep' THEN '../../../' ELSE '../../' END AS to_root
FROM fx_paths b
JOIN (SELECT repo_id, max(k) + 1 AS n FROM fx_paths GROUP BY repo_id) n ON n.repo_id = b.repo_id
LEFT JOIN fx_paths u ON u.file_id = CAST(floor(b.k / 2) AS BIGINT) * 4 + b.file_id % 4 AND u.file_id <> b.file_id
LEFT JOIN fx_paths j ON j.file_id = ((b.k * 7 + 3) % n.n) * 4 + b.file_id % 4 AND j.file_id <> b.file_id"""

VIEWS["fx_code"] = """
SELECT file_id, repo_id, p_size, dir, path, up_id, up_path, jump_id, jump_path,
  '// file ' || path || ' import x from "./none"' || chr(10)
  || CASE WHEN up_id IS NULL THEN '' ELSE 'import { fn_' || CAST(up_id AS STRING) || ', v_' || CAST(up_id AS STRING) || ' as w } from '''
       || to_root || replace(replace(replace(up_path, '.js', ''), '.py', ''), '.md', '') || ''';' || chr(10) END
  || CASE WHEN jump_id IS NULL OR p_size <= 40 THEN '' ELSE 'const lazy = () => import("' || to_root || jump_path || '");' || chr(10) END
  || CASE WHEN p_size > 46 THEN 'import "./setup";' || chr(10) || 'const q = require("lodash");' || chr(10) ELSE '' END
  || CASE WHEN path LIKE '%.test.%' THEN
       'it(''works ' || CAST(file_id AS STRING) || ''', async () => {' || chr(10)
       || CASE WHEN p_size > 40 THEN '}' WHEN p_size > 30 THEN '  const a = { b: 1 };' || chr(10) || '  run(a, lib);' || chr(10) || '}'
            WHEN p_size > 20 THEN '  expect(fn).toBeDefined(); expect(x).toBeDefined();' || chr(10) || '}'
            ELSE '  expect(fn(1)).toBe(2);' || chr(10) || '}' END || ');' || chr(10)
       || CASE WHEN p_size > 44 THEN 'it.skip(''later'', () => { expect(1).toBe(1); });' || chr(10) ELSE '' END
       || CASE WHEN p_size BETWEEN 15 AND 18 THEN '// it(''old'', run);' || chr(10) || '/* test(''older'',' || chr(10) || ' run); */' || chr(10) ELSE '' END
       || CASE WHEN p_size BETWEEN 10 AND 14 THEN 'setTimeout(run, 100); const t = Date.now();' || chr(10) ELSE '' END
     ELSE
       CASE WHEN p_size > 25 THEN '/** doc of ' || CAST(file_id AS STRING) || ' @param a */' || chr(10) ELSE '' END
       || 'export ' || CASE WHEN p_size > 35 THEN 'async ' ELSE '' END || 'function fn_' || CAST(file_id AS STRING) || '(a) {' || chr(10)
       || CASE WHEN p_size > 42 THEN '  try { run("// not a comment"); } catch (e) { throw e; }' || chr(10)
            WHEN p_size > 38 THEN '  run();' || chr(10) || '  catch (e) {}' || chr(10) ELSE '' END
       || CASE WHEN p_size < 20 THEN '  console.log(a); /* note' || chr(10) || ' more */' || chr(10) ELSE '' END
       || CASE WHEN p_size BETWEEN 10 AND 24 THEN '  // TODO check' || chr(10) ELSE '' END
       || CASE WHEN p_size > 48 THEN '  eval(a); debugger;' || chr(10) || '  var pass = 1; const password = "x";' || chr(10) ELSE '' END
       || '}' || chr(10)
       || 'export const v_' || CAST(file_id AS STRING) || ' = 1, u_' || CAST(file_id AS STRING) || ' = 2;' || chr(10)
       || CASE WHEN p_size BETWEEN 28 AND 33 THEN 'export class C_' || CAST(file_id AS STRING) || ' {}' || chr(10)
            || 'export { fn_' || CAST(file_id AS STRING) || ' as alias_' || CAST(file_id AS STRING) || ' };' || chr(10) ELSE '' END
       || CASE WHEN p_size BETWEEN 34 AND 37 THEN 'export default fn_' || CAST(file_id AS STRING) || ';' || chr(10) ELSE '' END
     END AS content
FROM fx_links"""

# An index file per file of large size, re-exporting its tree parent.
VIEWS["fx_index"] = """
SELECT repo_id, dir || '/m' || CAST(file_id AS STRING) || '/index.js' AS path, file_id, up_id, up_path,
  'export { fn_' || CAST(up_id AS STRING) || ', v_' || CAST(up_id AS STRING) || ' as val_' || CAST(file_id AS STRING) || ' } from ''../' || to_root || up_path || ''';'
  || chr(10) || 'export * from ''../f' || CAST(file_id AS STRING) || ''';' || chr(10) AS content
FROM fx_links WHERE up_id IS NOT NULL AND p_size > 30"""

# Directories with an index file that names its first and last file; the other files are gaps.
VIEWS["fx_dir_sources"] = """
SELECT repo_id, path, 'export const v = 1;' || chr(10) AS content FROM fx_paths
UNION ALL
SELECT repo_id, dir || '/index.js' AS path, 'export * from "./f' || CAST(min(file_id) AS STRING) || '";' || chr(10)
  || 'export { v } from ''./f' || CAST(max(file_id) AS STRING) || '.js'';' || chr(10) AS content
FROM fx_paths WHERE path LIKE '%.js' AND path NOT LIKE '%.test.%' GROUP BY repo_id, dir"""

# An audit document per file in one of three layouts.
VIEWS["fx_audits"] = """
SELECT file_id, repo_id, p_size, p_name, dir, path AS module_path,
  CASE WHEN p_size <= 20 THEN 'bracket' WHEN p_size <= 36 THEN 'numbered' ELSE 'checklist' END AS layout,
  CASE WHEN p_size <= 20 THEN
    '# Audit' || chr(10) || 'Severity: **MEDIUM**' || chr(10) || '## Issues (2)' || chr(10)
    || '### [HIGH] Missing JSDoc in ' || p_name || chr(10) || '- **File**: src/f' || CAST(file_id AS STRING) || '.js:' || CAST(p_size AS STRING) || chr(10)
    || '- **Description**: no documentation' || chr(10) || '- **Suggestion**: add it' || chr(10)
    || '### [' || CASE WHEN p_size > 10 THEN 'CRITICAL' ELSE 'LOW' END || '] ' || CASE WHEN p_size > 15 THEN '[FIXED] ' ELSE '' END || 'Event naming of ' || p_name || chr(10)
    || '- **Description**: event ' || CAST(p_size AS STRING) || chr(10)
  WHEN p_size <= 36 THEN
    '# Audit' || chr(10) || 'Severity: **HIGH**' || chr(10) || '## Summary' || chr(10) || p_name || chr(10) || '## Issues (' || CASE WHEN p_size > 28 THEN '2' ELSE '1' END || ')' || chr(10)
    || '### 1. ' || CASE WHEN p_size > 32 THEN '[FIXED] ' ELSE '' END || 'Deprecated call in ' || p_name || chr(10) || 'Severity: **low**' || chr(10) || chr(10)
    || CASE WHEN p_size > 28 THEN '### 2. Export of f' || CAST(file_id AS STRING) || chr(10) || 'body ' || CAST(p_size AS STRING) || chr(10) ELSE '' END
  ELSE
    '# Audit' || chr(10) || '## Error' || chr(10) || '- [ ] eval in ' || p_name || chr(10) || '- [x] secret ' || CAST(file_id AS STRING) || chr(10)
    || '## Info' || chr(10) || '- [FIXED] note ' || CAST(p_size AS STRING) || chr(10) || '- [ ] [warning] slow ' || p_name || chr(10)
  END AS content
FROM fx_paths"""

# Audited directories: document time from shipments, issue count and severity from sizes.
VIEWS["fx_audit_dirs"] = """
SELECT f.repo_id, f.dir, max(f.mtime) AS audit_mtime,
  CASE WHEN min(p.p_size) <= 2 THEN 'critical' WHEN min(p.p_size) <= 4 THEN 'high' WHEN max(p.p_size) > 40 THEN 'medium' ELSE 'low' END AS severity,
  sum(CASE WHEN p.p_size < 14 THEN 1 ELSE 0 END) AS issue_count
FROM fx_files f JOIN fx_paths p ON p.file_id = f.file_id
WHERE p.p_size < 22 GROUP BY f.repo_id, f.dir"""

# Test reports, one per order, in four formats.
VIEWS["fx_reports"] = """
SELECT o_orderkey AS run_id, 'r' || CAST(o_orderkey % 4 AS STRING) AS repo_id, o_orderstatus AS st, o_custkey AS cust, o_totalprice AS price,
  '{"testResults":[{"name":"tests/t' || CAST(o_custkey AS STRING) || '.test.js","status":"' || CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'passed' END || '","message":"suite broke' || chr(92) || 'nline two","assertionResults":['
    || CASE WHEN o_orderstatus = 'P' THEN '' ELSE '{"status":"passed","title":"a","fullName":"s a","failureMessages":[]},{"status":"'
         || CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'pending' END || '","title":"b","fullName":"","ancestorTitles":["s"],"failureMessages":["TypeError: bad ' || CAST(o_custkey AS STRING) || chr(92) || 'n at x.js:3"]}' END
    || ']}]' || CASE WHEN o_totalprice > 250000 THEN ',"numTotalTests":9,"numPassedTests":6,"numFailedTests":2,"numPendingTests":1' ELSE '' END || '}' AS jest,
  '{"tests":[{"nodeid":"tests/test_' || CAST(o_custkey AS STRING) || '.py::test_a","outcome":"' || CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'passed' END
    || '","call":{"longrepr":"assert ' || CAST(o_custkey AS STRING) || '"}}],"summary":{"passed":' || CASE o_orderstatus WHEN 'F' THEN '0,"failed":1' ELSE '1' END || '},"duration":1.5}' AS pytest,
  '{"Action":"run","Package":"pkg/a","Test":"TestA"}' || chr(10) || 'noise' || chr(10)
    || '{"Action":"' || CASE o_orderstatus WHEN 'F' THEN 'fail' ELSE 'pass' END || '","Package":"pkg/a","Test":"Test' || CAST(o_custkey AS STRING) || '","Output":"out"}' || chr(10)
    || '{"Action":"pass","Package":"pkg/a"}' || chr(10) AS go,
  'Tests: ' || CASE o_orderstatus WHEN 'F' THEN '2 failed, ' ELSE '' END || CAST(o_custkey AS STRING) || ' passed, 3 skipped' AS txt,
  CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS exit_code
FROM orders"""

# What Spark reads: the same rows. The test map joins on equal file numbers; with the repository as its only equal key
# a task would hold one whole and compare all its tests with all its files. Shipments are reduced to a row per part
# first, so that a query that reads the files several times does it once. Part is small as a file and large in memory:
# below the broadcast limit it would go through the driver in every join, so what grows joins by sort-merge.
SPARK_VIEWS: dict[str, str] = {
    **VIEWS,
    "fx_files": """
SELECT /*+ MERGE(l) */ p.file_id, p.repo_id, p.k, p.dir, p.path, p.p_size * 2 AS line_count, max(l.shipped) AS mtime
FROM fx_paths p JOIN (SELECT l_partkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p.file_id
GROUP BY p.file_id, p.repo_id, p.k, p.dir, p.path, p.p_size""",
    "fx_test_map": """
SELECT /*+ MERGE(s) */ t.repo_id, t.file_id AS test_id, t.path AS test_path, s.file_id AS source_id, s.path AS source_path,
  t.mtime AS test_mtime, s.mtime AS source_mtime
FROM (SELECT * FROM fx_files LATERAL VIEW explode(array(4, 8)) AS step WHERE path LIKE '%.test.%') t
JOIN fx_files s ON s.repo_id = t.repo_id AND s.file_id = t.file_id + t.step""",
    "fx_test_results": VIEWS["fx_test_results"].replace("SELECT", "SELECT /*+ MERGE(t) */", 1)}


def with_views(query: str, views: dict[str, str] = VIEWS) -> str:
    """Put the fixture views that ``query`` names (and those they need) in front of it."""
    wanted: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\bfx_\w+\b", sql):
            if name in views and name not in wanted:
                need(views[name])
                wanted.append(name)

    need(query)
    body = query.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if recursive:
        body = body[len("WITH RECURSIVE "):]
    elif body.upper().startswith("WITH "):
        body = body[len("WITH "):]
    else:
        clauses = ",\n".join(f"{n} AS ({views[n].strip()})" for n in wanted)
        return f"WITH {clauses}\n{body}" if wanted else body
    clauses = "".join(f"{n} AS ({views[n].strip()}),\n" for n in wanted)
    return ("WITH RECURSIVE " if recursive else "WITH ") + clauses + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table or a fixture view over the tables in ``sf``."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf}/{name}.parquet")
    for base in TABLES:
        if re.search(rf"\b{base}\b", with_views(f"SELECT * FROM {name}", SPARK_VIEWS)):
            spark.read.parquet(f"{sf}/{base}.parquet").createOrReplaceTempView(base)
    return spark.sql(with_views(f"SELECT * FROM {name}", SPARK_VIEWS))
