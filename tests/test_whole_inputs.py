"""Inputs that limits and shortcuts would lose: anchored rules, deep chains, many policies and rules, full ids, URIs."""

import datetime
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from repotide import fixtures, session
from repotide.catalog import source_queries
from repotide.functions import globs, scanners
from repotide.operators import enrich, entropy, extract, filters, graph, windows
from repotide.plans import impact
from repotide.sources import board, files


def sources(spark, *texts):
    return spark.createDataFrame([("r", f"f{i}.js", t) for i, t in enumerate(texts)], "repo_id string, path string, content string")


def test_anchored_rules(spark):
    rules = [extract.Rule("head", "^import", "info", "m"), extract.Rule("tail", "1$", "info", "m")]
    got = extract.rule_scan(sources(spark, "x\nimport a\ny = 1\nz", "none"), rules).collect()
    assert {(r.path, r.line, r.rule) for r in got} == {("f0.js", 2, "head"), ("f0.js", 3, "tail")}


def test_many_rules(spark):
    pack = spark.createDataFrame([(f"r{i}", rf"\bw{i}\b", "info", "m", "") for i in range(1200)], "id string, pattern string, severity string, message string, language string")
    got = extract.rule_scan(sources(spark, "w0 w1199\nw640"), pack).collect()
    assert {(r.line, r.rule) for r in got} == {(1, "r0"), (1, "r1199"), (2, "r640")}


def test_smells_see_what_the_scanner_sees(spark):
    text = sources(spark, "it('a', () => { setTimeout( run, 1) })")
    pattern = [("wide", r"setTimeout\(\srun", "m")]
    assert extract.smell_scan(text, pattern).count() == 1


def chain(spark, n):
    return spark.createDataFrame([("r", f"n{i + 1:03d}", f"n{i:03d}") for i in range(n)], "repo_id string, src string, dst string")


@pytest.mark.parametrize("depth,want", [(5, 5), (30, 30), (None, 30)])
def test_depth_is_what_was_asked(spark, depth, want):
    edges, start = chain(spark, 30), spark.createDataFrame([("r", "n000")], "repo_id string, node string")
    assert impact.propagate(edges, start, depth).count() == want
    assert graph.impact(edges, start, depth).agg(F.max("level")).first()[0] == want
    assert graph.focus(edges, start, depth)[0].count() == want + 1


def test_many_policies(spark):
    rows = [(f"r{i}", kind, pattern) for i in range(6000) for kind, pattern in (("include", f"src{i}/**"), ("ignore", "**/skip/**"))]
    policies = spark.createDataFrame([*rows, ("r1", "include", "a+b/*.js")], "repo_id string, kind string, pattern string")
    paths = [("r1", "src1/a.js"), ("r1", "a+b/x.js"), ("r1", "src2/a.js"), ("r5999", "src5999/skip/x"), ("r5999", "src5999/y"), ("free", "any")]
    got = filters.apply_repo_policies(spark.createDataFrame(paths, "repo_id string, path string"), policies)
    assert {tuple(r) for r in got.select("repo_id", "path").collect()} == {paths[0], paths[1], paths[4], paths[5]}


def test_full_ids_are_looked_up(spark):
    ids = ["abcdefghijklmnop0001", "abcdefghijklmnop0002", "short"]
    asked = ["abcdefghijklmnop0001", "doesnotexist0123456789", "abcdefghijklmnop", "abc", "sho", "zz"]
    got = filters.resolve_prefix(spark.createDataFrame([(i,) for i in ids], "task_id string"), spark.createDataFrame([(a,) for a in asked], "prefix string"))
    assert {r.prefix: (r.state, r.task_id) for r in got.collect()} == {
        asked[0]: ("ok", asked[0]), asked[1]: ("missing", None), asked[2]: ("missing", None), "abc": ("ambiguous", None), "sho": ("ok", "short"), "zz": ("missing", None)}


def test_scan_by_uri_and_in_either_case(spark, tmp_path):
    for rel in ("src/a.js", "B.JS", "deep/x/y.Py", "n.txt"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("line\n")
    want = {"src/a.js", "B.JS", "deep/x/y.Py"}
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/", f"{tmp_path}/"):
        assert {r.path for r in files.scan_files(spark, root, "r").collect()} == want


def test_last_update_wins(spark):
    tasks = spark.createDataFrame([(1, "a", 2), (2, "b", 2)], "task_id long, title string, priority int")
    updates = spark.createDataFrame([(1, "z", 1, 1), (1, "y", None, 2), (1, None, 0, 3), (9, "q", 1, 4)], "task_id long, title string, priority int, seq int")
    after, counts = board.update_tasks(tasks, updates, ["title", "priority"], "seq")
    assert sorted(tuple(r) for r in after.collect()) == [(1, "y", 0), (2, "b", 2)]
    assert tuple(counts.first()) == (3, 1)


def test_rows_reach_user_functions_unchanged(spark):
    df = spark.createDataFrame([(1, None, [1, 2]), (2, 7, None)], "id long, n int, a array<int>")
    got = enrich.enrich(df, lambda r: f"{r['n']!r} {r['a']!r}", "id").collect()
    assert {r.id: r.result for r in got} == {1: "None [1, 2]", 2: "7 None"}


def test_pages_of_a_hot_key(spark):
    df = spark.range(3000).select(F.lit("hot").alias("k"), "id")
    got = windows.page(df, ["k"], [F.col("id")], 2500, 20).collect()
    assert sorted(r.id for r in got) == list(range(2500, 2520)) and {r.total for r in got} == {3000}


def test_entropy_lines_stay_linear(spark):
    """Long files: the time of the line checks follows the length."""
    import time

    def seconds(n):
        df = sources(spark, "\n".join(["x = 1"] * n + ["// TODO"]))
        start = time.perf_counter()
        assert [r.line for r in entropy.todo_markers(df).collect()] == [n + 1]
        return time.perf_counter() - start

    seconds(100)
    assert seconds(200_000) < 30


def brute_blocks(text):
    import re
    out = []
    for m in scanners._BLOCK.finditer(text):
        depth, stop = 1, len(text)
        for b in re.finditer(r"[{}]", text[m.end():]):
            depth += 1 if b.group() == "{" else -1
            if not depth:
                stop = m.end() + b.end()
                break
        out.append((m.group(1), text[m.end():stop - 1]))
    return out


def test_blocks_with_one_stack():
    import random
    rng = random.Random(5)
    bits = ["it('a', () => {", "test(\"b\", async ({ x }) => {", "{", "}", "x", "\n", "});", "{}"]
    for _ in range(400):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert [(b["name"], b["body"]) for b in scanners.find_test_blocks(text)] == brute_blocks(text)
    assert isinstance(scanners.test_block_array.func(pd.Series(["it('a', () => {" * 20_000])), pd.Series)  # broken, and still linear


def test_latest_row_of_equal_times_is_fixed(spark):
    """Repeated runs at one time give the same answer whatever the partitioning."""
    from repotide.operators import joins

    modules = spark.createDataFrame([("r", 1, True)], "repo_id string, module_id long, enable_audit boolean")
    runs = spark.createDataFrame([("r", 1, 1, s, w, 5) for s, w in (("failed", "a"), ("timeout", "b"), ("failed", "c"))],
                                 "repo_id string, run long, module_id long, status string, reason string, at long")
    for n in (1, 2, 5):
        assert joins.overlay_failures(modules, runs.repartition(n)).first()["error"] == "b"


def test_policy_keys_equal_the_regular_expressions(spark):
    """Every pattern over every path, alone as include and as ignore, against the plain regular expression."""
    patterns = ["", "src", "src/", "src/a.js", "src/**", "src/*", "/**", "/src", "**", "*", "**/", "**//**", "**/*", "**/a", "**/a/b", "**/a/", "**/a/**", "**/a/*",
                "**/a/b/**", "**/*.js", "**/*.test.js", "**/*.", "*.js", "src/*.js", "src/**/a.js", "src/***", "src/***/b", "src/****/b", "a*/b", "sr?/a.js", "(x)/[y]", "a+b/**", "**/a.js/**", "x\\y"]
    paths = ["", "/", "src", "src/", "/src", "/src/a", "src/a.js", "src/a.jsx", "src/x/a.js", "src/x/y/a.js", "srcs/a.js", "a", "a/b", "x/a", "x/a/b", "x/a/b/c", "x/a/", "ba/b", "a/bc",
             "a//b", "a.js/b", "k.test.js", "x/k.test.js", "x/.js", "x/k.", "abc/b", "(x)/[y]", "(x)/[y]/z", "a+b/c", "aab/c", "x\\y", None]
    rows = [(f"{kind}{i}", p) for kind in ("include", "ignore") for i in range(len(patterns)) for p in paths]
    rules = [(f"{kind}{i}", kind, p) for kind in ("include", "ignore") for i, p in enumerate(patterns)]
    df = spark.createDataFrame([*rows, *rows[:3], ("free", None), ("free", "a"), (None, "a")], "repo_id string, path string")
    policies = spark.createDataFrame([*rules, ("free", "other", "a"), ("free", "include", None)], "repo_id string, kind string, pattern string")
    hit = lambda i, p: p is not None and re.search(globs.glob_regex([patterns[i]]), p) is not None
    want = [(f"{kind}{i}", p) for kind, i, p in ((k, i, p) for k in ("include", "ignore") for i in range(len(patterns)) for p in paths)
            if p is not None and hit(i, p) == (kind == "include")]
    want += [r for r in rows[:3] if r in want] + [("free", None), ("free", "a"), (None, "a")]
    got = [tuple(r) for r in filters.apply_repo_policies(df, policies).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    plan = filters.apply_repo_policies(df, policies)._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_test_map_joins_on_file_numbers(spark, tmp_path):
    part = [(4 * i, "red a" if i % 3 == 0 else "blue a", "B#1", "T A", size) for i in range(12) for size in (20, 4 + i)]
    part += [(None, "red a", "B#1", "T A", 20), (8, "red a", "B#1", "T A", 20), (3, "red b", None, "T A", 20)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    shipped = [(i % 52 if i % 9 else None, datetime.date(2020, 1, 1 + i % 28)) for i in range(400)]
    spark.createDataFrame(shipped, "l_partkey long, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fixtures.table(spark, str(tmp_path), "fx_test_map")
    want = spark.sql(fixtures.with_views("SELECT * FROM fx_test_map"))
    on_pairs = [" IN (" in df._jdf.queryExecution().sparkPlan().toString() for df in (got, want)]
    assert on_pairs == [False, True]  # the join has only equal keys, the SQL's has a condition on all pairs
    assert got.columns == want.columns
    assert got.count() and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_files_and_results_send_no_table_to_the_driver(spark, tmp_path):
    """Null and repeated keys, null dates, parts without shipments: the SQL's rows, and what grows joins by sort-merge."""
    part = [(4 * i, "red a" if i % 3 == 0 else "blue a", "B#1", "T A", size) for i in range(12) for size in (20, 4 + i, 20)]
    part += [(None, "red a", "B#1", "T A", 20), (8, None, "B#1", "T A", 20), (3, "red b", "B#1", "T A", None), (100, "red c", "B#1", "T A", 9)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    shipped = [(i % 52 if i % 9 else None, datetime.date(2020, 1, 1 + i % 28) if i % 52 != 4 and i % 5 else None) for i in range(400)]
    spark.createDataFrame(shipped, "l_partkey long, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = [(i, datetime.datetime(2020, 1, 1 + i % 9), i % 15 if i % 7 else None, ("error", "signup", "view", None)[i % 4], i / 3 if i % 8 else None) for i in range(90)]
    spark.createDataFrame([*seen, *seen[:20]], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    for name, joins in (("fx_files", 1), ("fx_test_map", 3), ("fx_test_results", 2)):
        got = fixtures.table(spark, str(tmp_path), name)
        want = spark.sql(fixtures.with_views(f"SELECT * FROM {name}"))
        assert got.columns == want.columns and got.schema == want.schema
        assert got.count() and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == joins


def test_tree_is_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """The files lie in the folders that Spark's writer would make, with the same bytes; a task writes a few."""
    odd = ["a_b.c", "x=1#2%", "quo'te\"", "b[0]{z]^", "q?*:\\w", "", None]
    rows = [(repo, folder, text) for repo in ("r1", None) for folder in odd for text in ("one\ntwo", "ümlaut", "", None, "one\ntwo")]
    code = session.cut(spark.createDataFrame(rows, "repo_id string, folder string, value string").coalesce(1))
    code.write.option("maxRecordsPerFile", 1).partitionBy("repo_id", "folder").text(f"{tmp_path}/spark")
    monkeypatch.setattr(source_queries, "FILES_A_TASK", 10)
    source_queries.write_tree(code, (tmp_path / "tasks").as_uri(), len(rows))
    tree = lambda d: Counter((str(f.parent.relative_to(d)), f.read_bytes()) for f in d.rglob("part-*.txt"))
    assert len(list((tmp_path / "tasks").rglob("*.txt"))) == len(rows)
    assert tree(tmp_path / "tasks") == tree(tmp_path / "spark")
