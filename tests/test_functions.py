"""Literal cases for path, glob and text functions."""

import pytest
from pyspark.sql import functions as F

from repotide.functions import globs, paths, scanners, text


def ev(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("dialect,pattern,path,want", [
    ("anchored", "src/**/*.js", "src/a.js", True),
    ("anchored", "src/**/*.js", "src/a/b/c.js", True),
    ("anchored", "src/*", "src/a/b.js", True),
    ("anchored", "src/*.js", "src/a/b.js", False),
    ("anchored", "a+b", "a+b/c", True),
    ("anchored", "a.b", "axb", False),
    ("simple", "ignored/**", "ignored/x.js", True),
    ("simple", "ignored/**", "ignored/x/y.js", True),
    ("simple", "a/*.js", "a/b/c.js", False),
    ("full", "*.test.js", "deep/x.test.js", True),
    ("full", "dir/**", "dir", True),
    ("full", "./dir/**/", "dir/a/b", True),
    ("full", "src/*.js", "src/a.js", True),
    ("full", "src/*.js", "src/a.jsx", False),
])
def test_globs(spark, dialect, pattern, path, want):
    assert ev(spark, globs.glob_match(F.col("p"), [pattern], dialect), p=path) is want


def test_empty_pattern_list_matches_nothing(spark):
    assert ev(spark, globs.glob_match(F.col("p"), []), p="a") is False


def test_test_policy():
    include, ignore = globs.test_policy(["js/a/**", "docs/**"], ["tests/**", "**/*.spec.js", "js/x/**"])
    assert include == ["tests/unit/a/**", "tests/integration/a/**", "tests/a/**"]
    assert ignore == ["js/x/**"]
    assert globs.test_policy(["docs/**"], [])[0] == ["docs/**"]


@pytest.mark.parametrize("raw,want", [
    ("./a/b/", "a/b"), ("a\\b", "a/b"), ("a/./b/../c", "a/c"), ("", "."), ("./", "."), ("../a", "../a"),
    ("a/../../b", "../b"), ("/a//b/", "/a/b"), ("a/..", "."),
])
def test_norm_path(spark, raw, want):
    assert ev(spark, paths.norm_path(F.col("p")), p=raw) == want


@pytest.mark.parametrize("path,want", [("a/b/c", ["a/b", "a", "."]), ("a", ["."]), (".", ["."])])
def test_ancestors(spark, path, want):
    assert ev(spark, paths.ancestors(F.col("p")), p=path) == want


@pytest.mark.parametrize("path,rule,want", [
    ("a.js", "first", "."), ("a.js", "root", "(root)"), ("js/agents/core/k.js", "layered", "js/agents/core"),
    ("js/util/x.js", "layered", "js/util"), ("lib/x.js", "layered", "lib"), ("tests/unit/agents/core/k.test.js", "change", "js/agents/core"),
    ("tests/integration/x.js", "change", "tests/integration"), ("README.md", "change", "other"),
])
def test_module_of(spark, path, rule, want):
    assert ev(spark, paths.module_of(F.col("p"), rule), p=path) == want


@pytest.mark.parametrize("path,want", [
    ("node_modules/x.js", False), ("a/.hidden/x.js", False), ("a/b.js", True), ("x.js", True), ("./x.js", True)])
def test_not_excluded(spark, path, want):
    assert ev(spark, paths.not_excluded(F.col("p")), p=path) is want


@pytest.mark.parametrize("path,want", [
    ("a/x.test.ts", "test"), ("a/x.spec.js", "test"), ("a/X.JS", "code"), ("a/x.md", "doc"), ("a/x.test.md", "doc"), ("Makefile", "other")])
def test_file_kind(spark, path, want):
    assert ev(spark, paths.file_kind(F.col("p")), p=path) == want


@pytest.mark.parametrize("title,desc,want", [
    ("Missing export", "unused import", "export_missing"), ("Unused import", "", "unused_import"), ("JSDoc", "todo", "missing_jsdoc"),
    ("Poor error", "handling", "missing_error_handling"), ("x", "y", "unknown")])
def test_issue_type_order(spark, title, desc, want):
    assert ev(spark, text.infer_issue_type(F.col("t"), F.col("d")), t=title, d=desc) == want


@pytest.mark.parametrize("code,err,want", [
    (429, "", "transient"), (1, "HTTP 429", "transient"), (1, "Rate Limit hit", "transient"), (1, "too many requests", "transient"),
    (1, "400 No available account", "transient"), (1, "400 bad input", "other"), (1, "boom 4290", "other"), (0, "", "other")])
def test_failure_class(spark, code, err, want):
    assert ev(spark, text.failure_class(F.col("c"), F.col("e")), c=code, e=err) == want


@pytest.mark.parametrize("ms,want", [(999, "999ms"), (1000, "1.0s"), (90000, "1.5min"), (5400000, "1.5h")])
def test_duration_label(spark, ms, want):
    assert ev(spark, text.duration_label(F.col("ms")), ms=ms) == want


def test_head_lines(spark):
    assert ev(spark, text.head_lines(F.col("t"), 2), t="a\nb\nc\nd") == "a\nb\n... (2 more lines)"
    assert ev(spark, text.head_lines(F.col("t"), 2), t="a\nb") == "a\nb"


def test_line_count(spark):
    assert ev(spark, text.line_count(F.col("t")), t="a\nb\n") == 3


@pytest.mark.parametrize("answer,want", [
    ('ok {"severity":"high","issues":[]} bye', "ok"), ("{broken \"severity\": }", "parse_error"), ("none", "unclear")])
def test_extract_json(spark, answer, want):
    assert ev(spark, text.extract_json(F.col("a"), "severity STRING"), a=answer)["status"] == want


def test_assertion(spark):
    got = ev(spark, text.assertion(F.col("m")), m="Expected: 1\nReceived: 2\n- a\n+ b")
    assert (got["expected"], got["received"], got["diff"]) == ("1", "2", "- a\n+ b")


@pytest.mark.parametrize("raw,want", [
    ("a // b\nc", "a" + " " * 4 + "\nc"), ("x /* y\nz */ w", "x" + " " * 4 + "\n" + " " * 4 + "w"),
    ("'// no' // yes", "'// no'" + " " * 6), ('"a\\"//b"', '"a\\"//b"'), ("`/* t */`", "`/* t */`"), ("a /* open", "a" + " " * 7)])
def test_strip_comments_keeps_strings(raw, want):
    assert scanners._TOKEN.sub(scanners._blank, raw) == want


def test_test_blocks():
    blocks = scanners.find_test_blocks("x\nit('a', () => { if (x) { y } });\ntest(\"b\", async (d) => {}")
    assert [(b["name"], b["line"]) for b in blocks] == [("a", 2), ("b", 3)]
    assert blocks[0]["body"] == " if (x) { y } "
