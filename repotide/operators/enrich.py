"""User hooks: row functions with outcome capture and retry, and registered SQL functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repotide.functions import scanners
from repotide.sources.audit_docs import ISSUE_HEADING, ISSUE_START, SNIPPET, field_pattern


def enrich(df: DataFrame, fn: Callable[[dict[str, Any]], str | None], id_col: str, retries: int = 0,
           transient: Callable[[str], bool] | None = None, backoff_s: float = 0.0) -> DataFrame:
    """Apply ``fn`` to each row: (id, status, result, error, duration_ms, attempts).

    An exception fails only its row. Failures that ``transient`` accepts are tried again up to
    ``retries`` times with doubling pauses. The work is spread over the partitions of ``df``.
    """
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("status", T.StringType()),
        T.StructField("result", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("duration_ms", T.LongType()), T.StructField("attempts", T.IntegerType())])

    def one(row: dict[str, Any]) -> dict[str, Any]:
        start, attempt = time.monotonic(), 0
        while True:
            attempt += 1
            try:
                status, result, error = "completed", fn(row), None
            except Exception as failure:  # the row's own outcome
                status, result, error = "failed", None, str(failure)
                if attempt <= retries and transient is not None and transient(error):
                    time.sleep(backoff_s * 2 ** (attempt - 1))
                    continue
            return {id_col: row[id_col], "status": status, "result": result, "error": error,
                    "duration_ms": int((time.monotonic() - start) * 1000), "attempts": attempt}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:  # Python values as they are: nulls stay None, integers stay integers
            rows = [one(r) for r in part.to_pylist()]
            ids = pa.array([r[id_col] for r in rows], part.schema.field(id_col).type)
            rest = [pa.array([r[n] for r in rows], t) for n, t in (
                ("status", pa.string()), ("result", pa.string()), ("error", pa.string()), ("duration_ms", pa.int64()), ("attempts", pa.int32()))]
            yield pa.RecordBatch.from_arrays([ids, *rest], names=schema.fieldNames())

    return df.mapInArrow(batches, schema)


def tasks_from(df: DataFrame, builder: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Task rows from a user's batch function over file rows."""
    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield builder(part)

    return df.mapInPandas(batches, schema)


_TEST_BLOCKS = """
CREATE OR REPLACE TEMPORARY FUNCTION test_blocks(content STRING) RETURNS TABLE (name STRING, line INT, body STRING)
RETURN SELECT b.name, b.line, b.body FROM (SELECT explode(test_block_array(content)) AS b)"""


def _bracket_issues() -> str:
    field = lambda name: f"trim(regexp_extract(block, r'{field_pattern(name)}', 1))"
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION bracket_issues(content STRING)
RETURNS TABLE (seq BIGINT, severity STRING, title STRING, file STRING, line INT, description STRING, suggestion STRING, snippet STRING)
RETURN
  WITH blocks AS (
    SELECT posexplode(filter(split(content, r'{ISSUE_START}'), b -> startswith(b, '###') AND b RLIKE r'{ISSUE_HEADING}')) AS (seq, block)),
  fields AS (SELECT *, {field("File")} AS place FROM blocks)
  SELECT CAST(seq AS BIGINT), regexp_extract(block, r'{ISSUE_HEADING}', 1), trim(regexp_extract(block, r'{ISSUE_HEADING}', 2)),
    trim(split_part(place, ':', 1)),
    coalesce(try_cast(nullif(regexp_extract(split_part(place, ':', 2), r'^\\s*(\\d+)', 1), '') AS INT), 0),
    {field("Description")}, {field("Suggestion")}, regexp_extract(block, r'{SNIPPET}', 1)
  FROM fields"""


def register_functions(spark: SparkSession) -> None:
    """Register ``strip_comments(text)`` and ``test_block_array(text)`` for SQL, in Arrow batches, and the table
    functions ``test_blocks(text)`` and ``bracket_issues(text)`` for ``LATERAL`` use.

    The table functions are SQL: the first explodes the batched scanner's array, the second has the rows of
    ``parse_bracket_issues`` (but for the inferred type and flag) and stays on the JVM. A null text has no rows.
    """
    spark.udf.register("strip_comments", scanners.strip_comments)
    spark.udf.register("test_block_array", scanners.test_block_array)
    spark.sql(_TEST_BLOCKS)
    spark.sql(_bracket_issues())
