"""Structured Streaming jobs over task events, counts and file changes.

Sinks are keyed by batch id and overwritten on replay, so a restarted query leaves the same rows.
Event time columns must be TIMESTAMP; ``event_time`` casts the zone-less ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from repotide.functions.text import rank_of
from repotide.operators.freshness import judge_artefacts, merge_newest, newest_sources
from repotide.operators.joins import changed_since, own_files
from repotide.session import REPO

# Later states win when two updates carry the same time.
STATE_ORDER = {"pending": 0, "running": 1, "cancelled": 2, "timeout": 3, "failed": 4, "completed": 5}


def event_time(df: DataFrame, column: str = "updated_at") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def fold_task_state(stream: DataFrame, fields=("status", "duration_ms")) -> DataFrame:
    """Latest known value of every field per task; out-of-order updates are folded by their time.

    A streaming aggregation (``update`` or ``complete`` mode): null fields keep the earlier value.
    """
    at = F.struct(F.col("updated_at"), rank_of(F.col("status"), STATE_ORDER, -1))
    return stream.groupBy(REPO, "task_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields], F.max("updated_at").alias("updated_at"))


def status_counts(stream: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Updates per repository, status and tumbling window, emitted when the window has closed."""
    counted = stream.withWatermark("updated_at", delay).groupBy(F.window("updated_at", width), REPO, "status").agg(
        F.count(F.lit(1)).alias("n"))
    return counted.select(REPO, "status", F.col("window.start").alias("window_start"), "n")


def stalled_runs(stream: DataFrame, silence: str = "35 minutes", delay: str = "0 minutes") -> DataFrame:
    """Runs silent for longer than ``silence``: the closed sessions of updates per run, with counts.

    ``crashed`` is true when the last update said ``running``.
    """
    n = lambda s: F.count_if(F.col("status") == s)
    sessions = stream.withWatermark("updated_at", delay).groupBy(F.session_window("updated_at", silence), REPO, "module_id").agg(
        F.max("updated_at").alias("last_update"), F.max_by("status", F.struct(F.col("updated_at"), rank_of(F.col("status"), STATE_ORDER, -1))).alias("last_status"),
        n("completed").alias("processed"), n("pending").alias("pending"))
    return sessions.select(REPO, "module_id", "last_update", "processed", "pending", (F.col("last_status") == "running").alias("crashed"))


def fresh_results(stream: DataFrame, keys: list[str], max_age: str = "24 hours") -> DataFrame:
    """Results reported once; repeats within ``max_age`` and results later than that are dropped."""
    return stream.withWatermark("updated_at", max_age).dropDuplicatesWithinWatermark(keys)


class _GrowthAlert(StatefulProcessor):
    """Keeps the last count of a repository."""

    def __init__(self, variant: str, threshold: int):
        self.variant, self.threshold = variant, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else 0
        for row in sorted(rows, key=lambda r: r.day):  # one row per snapshot day
            change = row.n - last
            moved = change > self.threshold if self.variant == "growth" else abs(change) >= self.threshold
            yield Row(repo_id=key[0], day=row.day, n=row.n, last=last, change=change, notify=moved or (row.n > 0 and last == 0))
            last = row.n
        self.last.update((last,))

    def close(self) -> None:
        pass


ALERT = T.StructType([
    T.StructField(REPO, T.StringType()), T.StructField("day", T.DateType()), T.StructField("n", T.LongType()),
    T.StructField("last", T.LongType()), T.StructField("change", T.LongType()), T.StructField("notify", T.BooleanType())])


def stale_alert_stream(counts: DataFrame, variant: str = "growth", threshold: int = 3) -> DataFrame:
    """Alerts on growth against the previous count kept per repository (RocksDB state store)."""
    counts.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return counts.groupBy(REPO).transformWithState(
        statefulProcessor=_GrowthAlert(variant, threshold), outputStructType=ALERT, outputMode="append", timeMode="None")


def run(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", every: str | None = None,
        work: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Start a query that writes each micro-batch to ``target/batch=<id>``.

    ``work`` turns a micro-batch into the rows to write. Without ``every`` the query takes what is
    there and stops.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = work(batch, batch_id) if work else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def read_sink(spark: SparkSession, target: str, schema: T.StructType, latest_by: list[str] | None = None) -> DataFrame:
    """Rows of a sink; with ``latest_by`` the row of the newest batch per key (for update mode).

    The sink must have at least one batch.
    """
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option(
        "basePath", target).parquet(f"{target}/batch=*")
    if latest_by is None:
        return rows.drop("batch")
    rest = [c for c in schema.fieldNames() if c not in latest_by]
    best = rows.groupBy(*latest_by).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return best.select(*latest_by, *[F.col(f"r.{c}").alias(c) for c in rest])


def stale_stream(changes: DataFrame, docs: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Changed files newer than the document that owns them, as they arrive (stream-static join)."""
    def work(batch: DataFrame, _: int) -> DataFrame:
        return changed_since(own_files(batch, docs)).select(REPO, F.col("owner").alias("dir"), "path", "mtime")

    return run(changes, target, checkpoint, every=every, work=work)


def new_files(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows of files as they arrive in a folder; a file already seen is not read again."""
    return spark.readStream.schema(schema).parquet(folder)


def refresh_stream(changes: DataFrame, artefacts: DataFrame, state: str, target: str, checkpoint: str,
                   every: str | None = "60 seconds", doc_scope: str = "") -> StreamingQuery:
    """Each round: reduce the arrived files to their newest per artefact, then say what to rebuild.

    Each round merges its changes with the state of the round before (a few rows per repository) into a
    new state and reads no older one. ``scanned`` counts the file changes seen.
    """
    spark = changes.sparkSession
    schema = newest_sources(spark.createDataFrame([], changes.schema), doc_scope).schema

    def work(batch: DataFrame, batch_id: int) -> DataFrame:
        now = newest_sources(batch, doc_scope)
        if batch_id > 0:
            last = spark.read.schema(schema).parquet(f"{state}/batch={batch_id - 1}")
            now = merge_newest(now.unionByName(last)).select(*schema.fieldNames())
        now.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        return judge_artefacts(artefacts, spark.read.schema(schema).parquet(f"{state}/batch={batch_id}"))

    return run(changes, target, checkpoint, every=every, work=work)
