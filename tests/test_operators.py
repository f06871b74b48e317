"""Literal cases for freshness, audits, extraction, sources and hooks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from repotide.operators import enrich, entropy, extract, freshness, joins, trends, windows
from repotide.sources import audit_docs, board, files, reports


def day(y):
    return dt.datetime(y, 1, 1)


def inventory(spark, rows):
    df = spark.createDataFrame([("r", p, t, n) for p, t, n in rows], "repo_id string, path string, mtime timestamp, line_count int")
    from repotide.functions.paths import dir_name
    return df.withColumn("dir", dir_name(F.col("path")))


def docs(spark, rows):
    return spark.createDataFrame([("r", d, t) for d, t in rows], "repo_id string, dir string, doc_mtime timestamp")


def test_nested_document_boundary(spark):
    f = inventory(spark, [("index.js", day(2021), 1), ("src/c.js", day(2023), 1)])
    d = docs(spark, [(".", day(2020)), ("src", day(2022))])
    got = {r.dir: (r.status, r.newest_file, r.changed) for r in freshness.doc_freshness(f, d).collect()}
    assert got == {".": ("stale", "index.js", 1), "src": ("stale", "src/c.js", 1)}
    assert {(r.dir, r.path) for r in freshness.changed_files(f, d).collect()} == {(".", "index.js"), ("src", "src/c.js")}


def test_ignored_code_and_missing_document(spark):
    f = inventory(spark, [("ignored/x.js", day(2021), 1), ("b/y.js", day(2021), 1)])
    d = docs(spark, [(".", day(2020)), ("b", None)])
    got = {r.dir: r for r in freshness.doc_freshness(f, d, ["ignored/**"]).collect()}
    assert (got["."].status, got["."].code_mtime, got["."].changed) == ("fresh", None, 0)
    assert (got["b"].status, got["b"].newest_file) == ("missing", None)


def test_equal_time_is_fresh(spark):
    f, d = inventory(spark, [("a/x.js", day(2021), 1)]), docs(spark, [("a", day(2021))])
    assert freshness.doc_freshness(f, d).first()["status"] == "fresh"


def test_module_test_freshness(spark):
    cov = spark.createDataFrame([("a", 0, 0, 2), ("b", 1, 1, 1), ("c", 2, 0, 0)], "module string, covered long, stale long, untested long")
    got = {r.module: r.status for r in freshness.module_test_freshness(cov).collect()}
    assert got == {"a": "missing", "b": "stale", "c": "fresh"}


def test_audit_report(spark):
    f = inventory(spark, [(f"{d}/x.js", day(2022), 1) for d in ("never", "stale", "fresh", "clean")] + [("clean/x.test.js", day(2030), 1)])
    modules = spark.createDataFrame([("r", d) for d in ("never", "stale", "fresh", "clean")], "repo_id string, dir string")
    audits = spark.createDataFrame([("r", "stale", day(2021), "high", 2), ("r", "fresh", day(2023), "medium", 1), ("r", "clean", day(2020), "low", 0)],
                                   "repo_id string, dir string, audit_mtime timestamp, severity string, issue_count long")
    status = freshness.audit_status(modules, f, audits)
    assert {r.dir: r.status for r in status.collect()} == {d: d for d in ("never", "stale", "fresh", "clean")}
    stats = freshness.audit_stats(status).first()
    assert (stats.total_issues, stats.high, stats.medium, stats.low, stats.total_files) == (3, 1, 1, 1, 4)


def test_large_thresholds_and_worklist(spark):
    rows = [(f"big/f{i}.js", day(2020), 1) for i in range(5)] + [("exact/a.js", day(2020), 200), ("small/a.js", day(2020), 2)]
    rows += [("parent/child/a.js", day(2020), 1), ("parent/child/deep/b.js", day(2020), 1), ("parent/own/c.js", day(2020), 1)]
    f = inventory(spark, rows)
    stats = freshness.dir_stats(f)
    assert [r.dir for r in freshness.large_dirs(stats).collect()] == ["exact", "big"]
    work = {(r.dir, r.action): r.small_children for r in freshness.index_worklist(stats, docs(spark, [("parent", day(2020)), ("parent/own", day(2020))])).collect()}
    assert work == {("big", "create"): None, ("exact", "create"): None, ("parent", "update"): 2}


def test_child_edges_use_nearest_module(spark):
    mods = spark.createDataFrame([("r", p) for p in (".", "a", "a/b/c", "a/b/c/d", "x/y")], "repo_id string, path string")
    got = {(r.parent, r.child) for r in joins.child_edges(mods).collect()}
    assert got == {(".", "a"), ("a", "a/b/c"), ("a/b/c", "a/b/c/d"), (".", "x/y")}


def test_resolve_imports_candidates(spark):
    f = spark.createDataFrame([("r", p) for p in ("a/x.js", "a/lib/index.js", "b.js", "a/y.ts")], "repo_id string, path string")
    imports = spark.createDataFrame([("r", "a/x.js", s) for s in ("./lib", "../b", "./y.ts", "./none", "react", "../../out")], "repo_id string, path string, spec string")
    got = {r.spec: r.target for r in joins.resolve_imports(imports, f).collect()}
    assert got == {"./lib": "a/lib/index.js", "../b": "b.js", "./y.ts": "a/y.ts"}


def test_import_and_export_forms(spark):
    content = "\n".join([
        "// import z from './z'", "import a, { b as c } from './a';", "import type { T } from \"./t\";", "import './side';",
        "const d = await import('./dyn');", "export { e, f as g } from './re';", "export * from './star';", "export * as ns from './ns';",
        "export default function h() {}", "export const i = 1, j = 2;", "export async function k() {}", "export class L {}"])
    df = spark.createDataFrame([("r", "x.js", content)], "repo_id string, path string, content string")
    clean = extract.without_comments(df)
    assert {r.spec for r in extract.extract_imports(clean).collect()} == {"./a", "./t", "./side", "./dyn", "./re", "./star", "./ns"}
    assert {r.symbol for r in extract.extract_exports(clean).collect()} == {"default", "e", "g", "*", "ns", "i", "j", "k", "L"}


def test_reexport_last_wins_and_star_marker(spark):
    df = spark.createDataFrame([("r", "lib/index.js", "export { a } from './one';\nexport { b as a } from './two.mjs';\nexport * from '../up';")],
                               "repo_id string, path string, content string")
    got = {(r.symbol, r.source_path) for r in extract.reexport_map(df).collect()}
    assert got == {("a", "lib/two.mjs"), ("*", "up.js")}


AUDIT = """# Audit
## Issues (3)
### [LOW] Missing JSDoc
- **File**: src/a.js:12
- **Description**: no docs
### [CRITICAL] Deprecated call
- **File**: src/b.js:abc
### [NOPE] skipped
### [HIGH] Bare
"""


def test_bracket_issues(spark):
    df = spark.createDataFrame([("r", "m", AUDIT)], "repo_id string, module_path string, content string")
    got = {r.title: r for r in audit_docs.parse_bracket_issues(df).collect()}
    assert (got["Missing JSDoc"].file, got["Missing JSDoc"].line, got["Missing JSDoc"].fixable) == ("src/a.js", 12, True)
    assert (got["Deprecated call"].line, got["Deprecated call"].type, got["Deprecated call"].fixable) == (0, "deprecated_api", False)
    assert (got["Bare"].file, got["Bare"].seq) == ("", 2) and "skipped" not in got


def test_archive_renumbers_and_empties(spark):
    rows = [("r", "m", "Severity: **HIGH**\n## Issues (3)\n### 1. [FIXED] a\nx\n### 2. b\ny\n### 3. c\nz\n"), ("r", "n", "## Issues (1)\n### 1. [FIXED] d\n")]
    issues = audit_docs.parse_audit(spark.createDataFrame(rows, "repo_id string, module_path string, content string"))
    archived, kept, state = audit_docs.archive_issues(issues)
    assert {(r.title, r.number) for r in kept.collect()} == {("b", 1), ("c", 2)}
    assert {r.title for r in archived.collect()} == {"a", "d"}
    assert {r.module_path: r.new_severity for r in state.collect()} == {"m": None, "n": "NONE"}


def test_audit_header_layouts(spark):
    rows = [("r", "a", "Severity: **High**\n## Issues (4)\n"), ("r", "b", "x\n## Severity: low\n## Issues\n- **t** (f:1): d\n- **t** (f:2): e\n"), ("r", "c", "nothing")]
    got = {r.module_path: (r.severity, r.issue_count) for r in audit_docs.audit_header(
        spark.createDataFrame(rows, "repo_id string, module_path string, content string")).collect()}
    assert got == {"a": ("high", 4), "b": ("low", 2), "c": ("unknown", 0)}


def test_jest_report_names(spark):
    report = ('{"testResults":[{"name":"a.js","assertionResults":[{"status":"failed","ancestorTitles":["x","y"],"failureMessages":[]},'
              '{"status":"todo","title":"t"}],"message":"file message"}]}')
    counts, errors = reports.parse_test_reports(spark.createDataFrame([("1", report)], "run_id string, r string"), "r", "vitest")
    c, e = counts.first(), errors.first()
    assert (c.total, c.passed, c.failed, c.skipped) == (2, 0, 1, 1)
    assert (e.test, e.message) == ("x > y > (unknown)", "file message")


def test_task_updates_keep_unset_fields(spark):
    tasks = spark.createDataFrame([(1, "a", 2), (2, "b", 2)], "task_id long, title string, priority int")
    updates = spark.createDataFrame([(1, None, 0), (None, "z", 1), (9, "q", 1)], "task_id long, title string, priority int")
    after, counts = board.update_tasks(tasks, updates, ["title", "priority"])
    assert {tuple(r) for r in after.collect()} == {(1, "a", 0), (2, "b", 2)}
    assert tuple(counts.first()) == (1, 2)


def test_snapshot_trend_counts_vanished_modules(spark):
    d = [dt.date(2024, 1, i) for i in (1, 2, 3)]
    rows = [("r", d[0], 1, 5), ("r", d[0], 2, 3), ("r", d[1], 1, 2), ("r", d[2], 1, 2), ("r", d[2], 3, 1)]
    got = [tuple(r)[2:] for r in trends.snapshot_trend(spark.createDataFrame(rows, "repo_id string, day date, module_id long, issues long")).orderBy("day").collect()]
    assert got == [(8, 8, 0, 0), (2, 0, 6, 6), (3, 1, 0, 6)]


def test_numbering_survives_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    rows = windows.ordered_prefix(df, ["k"], [F.col("v")], "n", {"s": "v"}).collect()
    for key in ("hot", "cold"):
        mine = sorted((r for r in rows if r.k == key), key=lambda r: r.v)
        total = 0
        for i, r in enumerate(mine, 1):
            total += r.v
            assert (r.n, r.s) == (i, total)


def test_enrich_isolates_failures(spark):
    def work(row):
        if row["id"] == 3:
            raise ValueError("bad")
        return str(row["id"])

    got = {r.id: (r.status, r.result, r.error) for r in enrich.enrich(spark.range(5), work, "id").collect()}
    assert got[3] == ("failed", None, "bad") and got[4] == ("completed", "4", None)


def test_scan_files_from_disk(spark, tmp_path):
    for rel in ("src/a.js", "src/.hid/b.js", "node_modules/c.js", "d.py", "e.txt"):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("line\nline\n")
    got = {(r.path, r.dir, r.line_count) for r in files.scan_files(spark, str(tmp_path), "r", with_content=True).collect()}
    assert got == {("src/a.js", "src", 3), ("d.py", ".", 3)}
    files.write_result(files.scan_files(spark, str(tmp_path), "r"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    doc = tmp_path / "graph.json"
    doc.write_text('{"version": 1, "files": {"a.js": {"imports": ["b.js"], "importedBy": [], "exports": ["x"]}, "b.js": {"imports": []}}}')
    nodes, edges, exports = files.read_graph_json(spark, str(doc), "r")
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("r", "a.js", "b.js")] and exports.first()["symbol"] == "x"


def test_scan_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILES_A_TASK", 7)
    monkeypatch.setattr(files, "FOLDERS_A_TASK", 2)
    for i in range(40):
        place = tmp_path / f"repo_id=r{i % 3}" / f"folder=a b%2F{i % 5}" / ("deep" if i % 4 == 0 else ".")
        place.mkdir(parents=True, exist_ok=True)
        (place / f"part-{i}.{'TXT' if i % 7 == 0 else 'txt'}").write_bytes(b"a\xc3\xa9\n" * i)
    for name in ("_SUCCESS", "_x=1.txt", "._y.txt", "_y.txt", "z.txt._COPYING_", "_metadata.txt", "no.text"):
        (tmp_path / "repo_id=r0" / name).write_text("1")
    (tmp_path / "repo_id=r1" / "gone.txt").symlink_to(tmp_path / "nothing.txt")
    (tmp_path / "repo_id=r1" / "_hidden").mkdir()
    (tmp_path / "repo_id=r1" / "_hidden" / "h.txt").write_text("1")
    found = files.scan_files(spark, tmp_path.as_uri(), extensions=(".txt",), with_content=True)
    assert "BinaryFile" not in found._jdf.queryExecution().toString()  # that source lists all files on the driver
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").load(str(tmp_path))
    want = {(r.path.split(f"{tmp_path}/repo_id=")[1], r.modificationTime, r.length, bytes(r.content).decode()) for r in raw.collect()}
    got = found.collect()
    assert {(f"{r.repo_id}/{r.path}", r.mtime, r.bytes, r.content) for r in got} == want and len(got) == len(want) == 40
    assert not files.scan_files(spark, str(tmp_path), extensions=(".txt",), modified_after="2999-01-01T00:00:00").count()
    assert files.scan_files(spark, str(tmp_path), extensions=(".txt",), modified_after="2001-01-01T00:00:00").count() == len(got)
    (tmp_path / "empty").mkdir()
    assert files.scan_files(spark, str(tmp_path / "empty"), "r").count() == 0


@pytest.mark.parametrize("dialect", ["bad"])
def test_unknown_framework_is_refused(spark, dialect):
    with pytest.raises(ValueError):
        reports.parse_test_reports(spark.createDataFrame([("1", "{}")], "run_id string, r string"), "r", dialect)


def test_swallowed_errors_have_their_lines(spark):
    text = "a\ntry {} catch (e) {}\nb // catch\ntry {\n} catch (x) {\n  throw x;\n}\ncatch\n(y)\n{\n}\n"
    df = spark.createDataFrame([("r", "a.js", text), ("r", "b.js", "nothing"), ("r", "c.js", None)], "repo_id string, path string, content string")
    got = sorted((r.line, r.detail) for r in entropy.swallowed_errors(df).collect())
    assert got == [(2, "empty catch"), (5, "bare rethrow"), (8, "empty catch")]


def test_table_functions_equal_the_parsers(spark):
    text = ("# A\n### [HIGH] One of 'em\n- **File**: src/a.js:12\n- **Description**: d\n- **Suggestion**: s\n```js\nx\n```\n"
            "### [odd] no\n### [LOW] Two\n- **File**: b.js\n### [CRITICAL] three\n- **File**: c.js:x\n")
    df = spark.createDataFrame([("r", "m", text), ("r", "n", ""), ("r", "o", None)], "repo_id string, module_path string, content string")
    enrich.register_functions(spark)
    df.createOrReplaceTempView("k06_own")
    cols = ["module_path", "seq", "severity", "title", "file", "line", "description", "suggestion", "snippet"]
    rows = spark.sql(f"SELECT {', '.join(cols)} FROM k06_own, LATERAL bracket_issues(content)")
    want = audit_docs.parse_bracket_issues(df).select(*cols).collect()
    assert sorted(rows.collect()) == sorted(want) and len(want) == 3
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    tests = spark.sql("SELECT b.* FROM VALUES ('it(\"x\", () => { a });\nit(\"y\", () => {})'), (NULL) AS t(c), LATERAL test_blocks(c) b")
    assert sorted((r.name, r.line) for r in tests.collect()) == [("x", 1), ("y", 2)]
    assert "ArrowEvalPython" in tests._jdf.queryExecution().executedPlan().toString()


def test_sources_of_many_repositories(spark, tmp_path):
    for path in ("one/src/a.js", "one/b.PY", "repo_id=two/src/a.js", "repo_id=two/node_modules/x.js", "beside.js"):
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text("x")
    found = files.scan_files(spark, (tmp_path / "tree").as_uri(), extensions=(".js", ".py"))
    got = {(r.repo_id, r.path, r.dir) for r in found.collect()}
    assert got == {(r.repo_id, r.path, r.dir) for repo, folder in (("one", "one"), ("two", "repo_id=two")) for r in files.scan_files(
        spark, str(tmp_path / "tree" / folder), repo, extensions=(".js", ".py")).collect()}
    assert {g[:2] for g in got} >= {("one", "src/a.js"), ("two", "src/a.js")} and len({g[0] for g in got}) == 2
    for repo, name, target in (("one", "1", "b"), ("one", "2", "c"), ("two", "1", "b")):
        doc = tmp_path / "graphs" / f"repo_id={repo}" / f"{name}.json"
        doc.parent.mkdir(parents=True, exist_ok=True)
        doc.write_text('{"version": 1,\n "files": {"a": {"imports": ["%s"], "exports": ["f"]}}}' % target)
    nodes, edges, exports = files.read_graph_json(spark, (tmp_path / "graphs").as_uri())
    assert sorted(tuple(r) for r in edges.collect()) == [("one", "a", "b"), ("one", "a", "c"), ("two", "a", "b")]
    assert {r.symbol for r in exports.collect()} == {"f"}
