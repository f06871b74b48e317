"""Numbering, retention, paging and ordering that do not gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repotide.functions.paths import path_depth
from repotide.functions.text import rank_of
from repotide.session import cut


def _cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in ([names] if isinstance(names, (str, Column)) else names)]


def ordered_prefix(df: DataFrame, keys: list[str], order: list[Column], number: str = "rn",
                   sums: dict[str, str] | None = None) -> DataFrame:
    """1-based position inside each key, and running sums (``{output: input}``), at any group size.

    Rows are range-partitioned and sorted by key and order, fixed by writing them, and numbered
    inside each slice; the offsets of the slices come from one small row per (slice, key). ``order``
    must be unique inside a key.
    """
    sums = sums or {}
    by = [*_cols(keys), *order]
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by)  # no fixed number: adaptive execution sizes the slices
    laid = cut(laid.withColumn("_at", F.monotonically_increasing_id())
               .withColumn("_slice", F.shiftright("_at", 33)))
    per_slice = laid.groupBy("_slice", *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"),
        *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = per_slice.select(
        "_slice", *keys, "_first", before("_n").alias("_before"),
        *[before(f"_t_{o}").alias(f"_b_{o}") for o in sums])
    out = laid.join(offsets, ["_slice", *keys])
    out = out.withColumn(number, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    local = Window.partitionBy("_slice", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    for o, c in sums.items():
        out = out.withColumn(o, F.sum(c).over(local) + F.col(f"_b_{o}"))
    return out.drop("_at", "_slice", "_first", "_before", *[f"_b_{o}" for o in sums])


def number_rows(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Stable ids 1..n per key in the given order."""
    return ordered_prefix(df, keys, order, name)


def rank_sources(plan: DataFrame, keys: list[str], order: list[Column], name: str = "source_rank") -> DataFrame:
    """0-based rank of sources in a plan."""
    return number_rows(plan, keys, order, name).withColumn(name, F.col(name) - 1)


def batches(df: DataFrame, keys: list[str], order: list[Column], size: int, name: str = "batch") -> DataFrame:
    """Consecutive groups of ``size`` rows per key, numbered from 0."""
    return number_rows(df, keys, order, "_rn").withColumn(
        name, F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def newest_per(df: DataFrame, keys: list[str], ts: str, tie: str, pick: list[str]) -> DataFrame:
    """Newest row per key (smallest ``tie`` among equals); an aggregate, so it combines map-side."""
    best = F.min_by(F.struct(ts, *[c for c in dict.fromkeys([tie, *pick]) if c != ts]),
                    F.struct(-F.unix_micros(F.col(ts).cast("timestamp")), F.col(tie)))
    out = df.groupBy(*keys).agg(best.alias("_best"))
    return out.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in dict.fromkeys([ts, tie, *pick])])


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in ``order`` (newest first for histories).

    The rank limit is applied per task before the shuffle, so a hot key sends ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return keep_last(df, keys, order, 1)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    return ordered_prefix(df, keys, order, "_rn", {name: value}).drop("_rn")


def page(df: DataFrame, keys: list[str], order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` per key with the range shown and what follows.

    Rows are numbered in slices, so a deep page of a hot key is no heavier than the first one.
    """
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    shown = number_rows(df, keys, order).filter((F.col("rn") > offset) & (F.col("rn") <= offset + limit))
    end = F.least(F.lit(offset + limit).cast("bigint"), F.col("total"))
    return shown.join(totals, keys).select(
        *keys, *[c for c in df.columns if c not in keys], F.col("rn").cast("bigint").alias("rn"), "total",
        F.lit(offset + 1).cast("bigint").alias("showing_from"), end.alias("showing_to"),
        (end < F.col("total")).alias("has_more"),
        F.when(end < F.col("total"), end).alias("next_offset"))


def rank_order(df: DataFrame, col: str, ranks: dict[str, int], *ties) -> DataFrame:
    """Global order by a custom rank, then the tie-breakers."""
    return df.orderBy(rank_of(F.col(col), ranks), *ties)


def deepest_first(df: DataFrame, path: str = "path") -> DataFrame:
    return df.orderBy(path_depth(F.col(path)).desc(), path)


def top_rows(df: DataFrame, k: int, *order) -> DataFrame:
    """First ``k`` rows overall (top-k per task, then merged)."""
    return df.orderBy(*order).limit(k)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def unique_sorted(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def remaining(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose key is not done yet."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def merge_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Earlier results that were not retried, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
