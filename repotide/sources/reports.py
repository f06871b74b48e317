"""Test reports of several frameworks as rows; parsed with declared schemas on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JEST = """testResults ARRAY<STRUCT<name: STRING, status: STRING, message: STRING, failureMessage: STRING,
 assertionResults: ARRAY<STRUCT<status: STRING, title: STRING, fullName: STRING,
   ancestorTitles: ARRAY<STRING>, failureMessages: ARRAY<STRING>>>>>,
 numTotalTests BIGINT, numPassedTests BIGINT, numFailedTests BIGINT, numPendingTests BIGINT, numTodoTests BIGINT"""
PYTEST = """tests ARRAY<STRUCT<nodeid: STRING, outcome: STRING, call: STRUCT<longrepr: STRING>>>,
 summary STRUCT<passed: BIGINT, failed: BIGINT, skipped: BIGINT>, duration DOUBLE"""
GO_EVENT = "Action STRING, Package STRING, Test STRING, Output STRING"


def _first_line(col: Column) -> Column:
    return F.substring_index(col, "\n", 1)


def _count(report: Column, *statuses: str) -> Column:
    per_file = F.transform(
        F.coalesce(report["testResults"], F.array()),
        lambda f: F.size(F.filter(F.coalesce(f["assertionResults"], F.array()),
                                  lambda t: F.lower(t["status"]).isin(*statuses))))
    return F.aggregate(per_file, F.lit(0), lambda a, x: a + x).cast("bigint")


def parse_test_reports(df: DataFrame, column: str, framework: str = "jest") -> tuple[DataFrame, DataFrame]:
    """(counts per run, failures) for ``jest`` / ``vitest``, ``pytest`` or ``go`` reports.

    ``df`` has ``run_id`` and the report text.
    """
    if framework in ("jest", "vitest"):
        return _jest(df, column)
    if framework == "pytest":
        return _pytest(df, column)
    if framework == "go":
        return _go(df, column)
    raise ValueError(f"unknown framework {framework!r}")


def _jest(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    parsed = df.select("run_id", F.from_json(column, JEST).alias("r"))
    r = F.col("r")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    given = zero(r["numTotalTests"]) > 0
    passed = F.when(given, zero(r["numPassedTests"])).otherwise(_count(r, "passed"))
    failed = F.when(given, zero(r["numFailedTests"])).otherwise(_count(r, "failed"))
    skipped = F.when(given, zero(r["numPendingTests"]) + zero(r["numTodoTests"])).otherwise(
        _count(r, "pending", "skipped", "skip", "todo"))
    total = F.when(given, zero(r["numTotalTests"])).otherwise(passed + failed + skipped)
    counts = parsed.select("run_id", total.alias("total"), passed.alias("passed"),
                           failed.alias("failed"), skipped.alias("skipped"))
    file = parsed.select("run_id", F.explode("r.testResults").alias("f"))
    suite_text = F.trim(F.coalesce(F.nullif("f.message", F.lit("")), F.col("f.failureMessage"), F.lit("")))
    suites = file.filter(
        (F.col("f.status") == "failed") & (F.size(F.coalesce("f.assertionResults", F.array())) == 0)
        & (suite_text != "")
    ).select("run_id", F.col("f.name").alias("test_file"), F.lit("(suite)").alias("test"),
             _first_line(suite_text).alias("message"), suite_text.alias("stack"))
    case = file.select("run_id", F.col("f.name").alias("test_file"), F.col("f.message").alias("_fm"),
                       F.explode("f.assertionResults").alias("t")).filter(F.lower("t.status") == "failed")
    title = F.coalesce(F.nullif("t.fullName", F.lit("")), F.nullif("t.title", F.lit("")))
    above = F.when(F.size("t.ancestorTitles") > 0,
                   F.concat(F.array_join("t.ancestorTitles", " > "), F.lit(" > (unknown)")))
    raw = F.nullif(F.trim(F.array_join(
        F.filter(F.coalesce("t.failureMessages", F.array()), lambda m: m != ""), "\n")), F.lit(""))
    cases = case.select(
        "run_id", "test_file", F.coalesce(title, above, F.lit("(unknown)")).alias("test"),
        _first_line(F.coalesce(raw, F.nullif("_fm", F.lit("")), F.lit("Test failed"))).alias("message"),
        F.coalesce(raw, F.col("_fm"), F.lit("")).alias("stack"))
    return counts, suites.unionByName(cases)


def _pytest(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    parsed = df.select("run_id", F.from_json(column, PYTEST).alias("r"))
    n = lambda c: F.coalesce(F.col(f"r.summary.{c}"), F.lit(0).cast("bigint"))
    counts = parsed.select("run_id", (n("passed") + n("failed") + n("skipped")).alias("total"),
                           n("passed").alias("passed"), n("failed").alias("failed"), n("skipped").alias("skipped"))
    text = F.coalesce(F.nullif("t.call.longrepr", F.lit("")), F.lit("Unknown error"))
    failures = parsed.select("run_id", F.explode("r.tests").alias("t")).filter(
        F.col("t.outcome") == "failed"
    ).select("run_id", F.coalesce(F.substring_index("t.nodeid", "::", 1), F.lit("")).alias("test_file"),
             F.coalesce("t.nodeid", F.lit("")).alias("test"), text.alias("message"),
             F.coalesce("t.call.longrepr", F.lit("")).alias("stack"))
    return counts, failures


def _go(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    line = df.select("run_id", F.explode(F.split(column, "\n")).alias("line"))
    event = line.select("run_id", F.from_json("line", GO_EVENT).alias("e")).filter(
        F.coalesce("e.Test", F.lit("")) != "")
    events = df.select("run_id").distinct().join(event, "run_id", "left")
    counted = lambda a: F.count_if(F.col("e.Action") == a)
    counts = events.groupBy("run_id").agg(
        (counted("pass") + counted("fail")).alias("total"), counted("pass").alias("passed"),
        counted("fail").alias("failed"), F.lit(0).cast("bigint").alias("skipped"))
    failures = event.filter(F.col("e.Action") == "fail").select(
        "run_id", F.coalesce("e.Package", F.lit("")).alias("test_file"), F.col("e.Test").alias("test"),
        F.coalesce(F.nullif("e.Output", F.lit("")), F.lit("Test failed")).alias("message"),
        F.lit("").alias("stack"))
    return counts, failures


def parse_test_text(df: DataFrame, column: str, exit_code: str | None = None) -> DataFrame:
    """Counts from raw output. With an exit code, a non-zero one means at least one failure."""
    text = F.col(column)
    grab = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("bigint")
    zero = F.lit(0).cast("bigint")
    if exit_code is None:
        passed, failed, skipped = (F.coalesce(grab(rf"(?i)(\d+)\s+{w}\b"), zero)
                                   for w in ("passed", "failed", "skipped"))
    else:
        passed = F.coalesce(grab(r"(?i)(\d+)\s*(?:passing|passed|ok)"), zero)
        failed = F.coalesce(grab(r"(?i)(\d+)\s*(?:failing|failed|error)"),
                            F.when(F.col(exit_code) != 0, 1).otherwise(0).cast("bigint"))
        skipped = F.coalesce(grab(r"(?i)(\d+)\s*(?:skipped|pending|ignored)"), zero)
    return df.select("run_id", (passed + failed + skipped).alias("total"), passed.alias("passed"),
                     failed.alias("failed"), skipped.alias("skipped"))


def parse_file_summary(df: DataFrame, column: str) -> DataFrame:
    """Passed and failed test files from the last ``Test Files`` line of a console tail."""
    usual = r"(?s).*Test Files\s+(\d+)\s+passed\s+\((\d+)\)(?:\s*\|\s*(\d+)\s+failed)?"
    other = r"Test Files\s+(\d+)\s+failed\s*\|\s*(\d+)\s+passed\s+\((\d+)\)"
    grab = lambda p, i: F.nullif(F.regexp_extract(column, p, i), F.lit("")).try_cast("bigint")
    part, rare = (lambda i: grab(usual, i)), (lambda i: grab(other, i))
    return df.select("run_id", F.coalesce(part(1), rare(2)).alias("passed"),
                     F.when(part(1).isNotNull(), F.coalesce(
                         part(3), F.greatest(part(2) - part(1), F.lit(0)))).otherwise(rare(1)).alias("failed"))
