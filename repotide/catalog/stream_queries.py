"""Streaming jobs, run to the end of the given data and read back from their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repotide.catalog.freshness_queries import CODE, OWNED
from repotide.catalog.registry import query
from repotide.fixtures import table
from repotide.functions.paths import file_kind
from repotide.session import checkpoint_dir
from repotide.streaming import jobs


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of task updates."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    status = (F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending")
              .when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "timeout").otherwise("completed"))
    return e.select(F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("repo_id"), F.col("event_id").alias("task_id"),
                    F.col("user_id").alias("module_id"), F.col("ts").cast("timestamp").alias("updated_at"), status.alias("status"),
                    F.floor(F.col("value") * 100).alias("duration_ms"))


def _finish(spark, stream, name, mode="append", latest_by=None, work=None):
    target = _scratch(spark, name)
    jobs.run(stream, target, f"{target}-checkpoint", mode, work=work).awaitTermination()
    return jobs.read_sink(spark, target, stream.schema, latest_by)


def _landing(spark: SparkSession, df: DataFrame, name: str) -> str:
    folder = _scratch(spark, name)
    df.write.mode("append").parquet(folder)
    return folder


@query("j01_task_state_fold", """SELECT repo_id, module_id AS task_id, arg_max(status, updated_at) AS status, arg_max(duration_ms, updated_at) AS duration_ms, max(updated_at) AS updated_at FROM fx_tasks GROUP BY 1, 2""")
def _(spark, sf):
    stream = _events(spark, sf).withColumn("task_id", F.col("module_id"))
    got = _finish(spark, jobs.fold_task_state(stream), "fold", "update", ["repo_id", "task_id"])
    return got.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("j02_status_counts", """WITH m AS (SELECT max(updated_at) - INTERVAL 10 MINUTE AS wm FROM fx_tasks), w AS (SELECT repo_id, status, time_bucket(INTERVAL 1 HOUR, updated_at) AS window_start, count(*) AS n FROM fx_tasks GROUP BY 1, 2, 3)
 SELECT repo_id, status, window_start, n FROM w, m WHERE window_start + INTERVAL 1 HOUR <= wm""")
def _(spark, sf):
    got = _finish(spark, jobs.status_counts(_events(spark, sf), "1 hour"), "counts")
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("j03_stalled_runs", """WITH g AS (SELECT *, CASE WHEN updated_at - lag(updated_at) OVER w < INTERVAL 35 MINUTE THEN 0 ELSE 1 END AS b FROM fx_tasks WINDOW w AS (PARTITION BY module_id ORDER BY updated_at)),
  s AS (SELECT *, sum(b) OVER (PARTITION BY module_id ORDER BY updated_at) AS sid FROM g), a AS (SELECT repo_id, module_id, sid, max(updated_at) AS last_update, arg_max(status, updated_at) AS st, count(*) FILTER (status = 'completed') AS processed, count(*) FILTER (status = 'pending') AS pending FROM s GROUP BY 1, 2, 3)
 SELECT repo_id, module_id, last_update, processed, pending, st = 'running' AS crashed FROM a WHERE last_update + INTERVAL 35 MINUTE <= (SELECT max(updated_at) FROM fx_tasks)""")
def _(spark, sf):
    got = _finish(spark, jobs.stalled_runs(_events(spark, sf)), "stalled")
    return got.withColumn("last_update", F.col("last_update").cast("timestamp_ntz"))


@query("j04_fresh_results", "SELECT task_id, status FROM fx_tasks")
def _(spark, sf):
    # Every result is delivered twice.
    twice = _events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _finish(spark, jobs.fresh_results(twice, ["task_id"]), "fresh").select("task_id", "status")


@query("j05_growth_alerts", """WITH t AS (SELECT repo_id, day, CAST(sum(issues) AS BIGINT) AS n FROM fx_snapshots GROUP BY 1, 2), p AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY repo_id ORDER BY day), 0) AS last FROM t)
 SELECT *, n - last AS change, n - last > 3 OR (n > 0 AND last = 0) AS notify FROM p""")
def _(spark, sf):
    counts = table(spark, sf, "fx_snapshots").groupBy("repo_id", "day").agg(F.sum("issues").alias("n"))
    folder = _landing(spark, counts, "counts")
    return _finish(spark, jobs.stale_alert_stream(jobs.new_files(spark, folder, counts.schema)), "alerts")


@query("j06_stale_stream", f"WITH {OWNED} SELECT repo_id, owner AS dir, path, mtime FROM owned WHERE mtime > doc_mtime")
def _(spark, sf):
    files = table(spark, sf, "fx_files").filter(file_kind(F.col("path")).isin("code", "test"))
    changes = jobs.new_files(spark, _landing(spark, files, "changes"), files.schema)
    target = _scratch(spark, "stale")
    jobs.stale_stream(changes, table(spark, sf, "fx_docs"), target, f"{target}-checkpoint").awaitTermination()
    schema = files.select("repo_id", "dir", "path", "mtime").schema
    return jobs.read_sink(spark, target, schema)


@query("j07_resume", "SELECT task_id, status FROM fx_tasks")
def _(spark, sf):
    stream, target = _events(spark, sf).select("task_id", "status"), _scratch(spark, "resume")
    for _turn in range(2):  # the second start finds everything done
        jobs.run(stream, target, f"{target}-checkpoint").awaitTermination()
    return jobs.read_sink(spark, target, stream.schema)


@query("j08_new_files", "SELECT repo_id, file_id, CASE WHEN path LIKE '%.js' THEN 1 ELSE 2 END AS arrival FROM fx_files")
def _(spark, sf):
    files = table(spark, sf, "fx_files").select("repo_id", "file_id", "path")
    folder, target = _landing(spark, files.filter("path LIKE '%.js'"), "arrivals"), _scratch(spark, "seen")
    stream = jobs.new_files(spark, folder, files.schema)
    first = lambda n: jobs.run(stream, target, f"{target}-checkpoint", work=lambda b, _: b.withColumn("arrival", F.lit(n))).awaitTermination()
    first(1)
    files.filter("path NOT LIKE '%.js'").write.mode("append").parquet(folder)
    first(2)
    schema = files.withColumn("arrival", F.lit(0)).schema
    return jobs.read_sink(spark, target, schema).drop("path")


@query("j09_periodic_refresh", f"""WITH a AS (SELECT DISTINCT repo_id FROM fx_files), n AS (SELECT repo_id, max(mtime) AS m, first(path ORDER BY mtime DESC, path) AS p FROM fx_files WHERE {CODE} GROUP BY 1), art AS (SELECT repo_id, 'test' AS target, (SELECT min(doc_mtime) FROM fx_docs) AS g FROM a)
 SELECT art.repo_id, target, m > g AS stale, p AS newest_source FROM art JOIN n USING (repo_id)""")
def _(spark, sf):
    files = table(spark, sf, "fx_files").select("repo_id", "path", "mtime")
    stream = jobs.new_files(spark, _landing(spark, files, "inventory"), files.schema)
    built = table(spark, sf, "fx_docs").agg(F.min("doc_mtime").alias("generated_at"))
    artefacts = files.select("repo_id").distinct().withColumn("target", F.lit("test")).join(F.broadcast(built))  # one row
    target = _scratch(spark, "refresh")
    jobs.refresh_stream(stream, artefacts, f"{target}-newest", target, f"{target}-checkpoint", every=None).awaitTermination()
    from repotide.operators.freshness import artefact_staleness
    schema = artefact_staleness(files, artefacts).schema
    return jobs.read_sink(spark, target, schema, ["repo_id", "target"]).select("repo_id", "target", "stale", "newest_source")
