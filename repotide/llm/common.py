"""Helpers shared by the operators: table access, ASCII lower case, bound values, hot-key numbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where the body uses it in inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is.

    The engine's ``lower`` is fast but also changes other letters, so it serves only texts without any
    upper-case letter outside ASCII.
    """
    other = text.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


#: What operators keep in a Python worker between tasks: name -> how to drop it.
_KEPT: dict[str, Callable[[], object]] = {}


def keeps(name: str, drop: Callable[[], object]) -> None:
    """Say that this worker may keep something for the operator ``name``."""
    _KEPT[name] = drop


def begin_task(name: str) -> None:
    """Drop what other operators left in this worker: Spark uses workers again, so memory would add up over the jobs."""
    for other, drop in _KEPT.items():
        if other != name:
            drop()


def rows_in(df: DataFrame) -> int:
    """Number of rows (a count over no columns, which a Parquet scan answers from its footers)."""
    return df.count()


#: Rows of a small side (ids and a few numbers) that may go to every task.
FITTING_ROWS = 500_000


def fitted(side: DataFrame, most: int = FITTING_ROWS) -> DataFrame:
    """``side`` written down and, if it has at most ``most`` rows, marked for broadcast.

    The texts of the other side then stay where they are; a larger side meets them in a shuffle.
    """
    side = cut(side)
    return F.broadcast(side) if side.count() <= most else side


def numbered(df: DataFrame, keys: list[str], spread: list[str], out: str, rows: int, per_task: int = 50_000) -> DataFrame:
    """Add ``out``: a gapless number from 0 inside each key, in no particular order.

    No task holds a key: rows are dealt to (key, bucket) by a hash of the columns in ``spread``, numbered
    there and shifted by the counts of the key's earlier buckets. ``rows`` sets the number of buckets, so
    their size stays the same as the input grows. Reads ``df`` twice; cut it first if it is expensive.
    """
    buckets = max(8, rows // per_task)
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    counts = dealt.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*spread)
    ranked = dealt.withColumn("__row", F.row_number().over(inside) - 1)
    same = [ranked[k].eqNullSafe(offsets[f"__k{i}"]) for i, k in enumerate(keys)]
    on = ranked["__bucket"] == offsets["__b"]
    for c in same:
        on = on & c
    return ranked.join(offsets, on).select(*df.columns, (F.col("__row") + F.col("__offset")).cast("long").alias(out))
