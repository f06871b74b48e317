"""Streams over several micro-batches: order, lateness, state across restarts."""

import datetime as dt

from repotide.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
TASKS = "repo_id string, task_id long, module_id long, status string, duration_ms long, updated_at timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def add(spark, folder, rows, schema=TASKS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    schema = spark.createDataFrame([], TASKS).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def go(spark, tmp, stream, mode="append", latest_by=None):
    target = str(tmp / "out")
    jobs.run(stream, target, str(tmp / "cp"), mode).awaitTermination()
    return [r.asDict() for r in jobs.read_sink(spark, target, stream.schema, latest_by).collect()]


def test_fold_ignores_arrival_order_and_keeps_unset_fields(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, [("r", 1, 1, "completed", 70, at(9)), ("r", 2, 2, "running", None, at(1))])
    stream = jobs.fold_task_state(source(spark, folder))
    go(spark, tmp_path, stream, "update", ["repo_id", "task_id"])
    add(spark, folder, [("r", 1, 1, "running", 5, at(2)), ("r", 2, 2, "failed", 30, at(4)), ("r", 2, 2, None, None, at(5))])
    rows = {r["task_id"]: (r["status"], r["duration_ms"]) for r in go(spark, tmp_path, stream, "update", ["repo_id", "task_id"])}
    assert rows == {1: ("completed", 70), 2: ("failed", 30)}


def test_repeats_and_old_results_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, [("r", 1, 1, "completed", 1, at(0)), ("r", 9, 9, "completed", 1, at(60 * 48))])
    stream = jobs.fresh_results(source(spark, folder), ["task_id"])
    go(spark, tmp_path, stream)
    # 1 is older than 24 hours by now, 9 is a repeat, 3 is new.
    add(spark, folder, [("r", 2, 2, "completed", 1, at(5)), ("r", 9, 9, "completed", 1, at(60 * 48 + 1)), ("r", 3, 3, "failed", 1, at(60 * 47))])
    assert sorted(r["task_id"] for r in go(spark, tmp_path, stream)) == [1, 3, 9]


def test_stalled_run_is_reported_once_silent(spark, tmp_path):
    folder = str(tmp_path / "in")
    add(spark, folder, [("r", i, 1, s, 1, at(m)) for i, (s, m) in enumerate([("pending", 0), ("running", 10)])]
        + [("r", 9, 2, "completed", 1, at(20)), ("r", 10, 3, "running", 1, at(100))])
    rows = {r["module_id"]: r["crashed"] for r in go(spark, tmp_path, jobs.stalled_runs(source(spark, folder)))}
    assert rows == {1: True, 2: False}


def test_alert_state_survives_a_restart(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "repo_id string, day date, n long"
    add(spark, folder, [("r", dt.date(2024, 1, 1), 2)], schema)
    counts = jobs.new_files(spark, folder, spark.createDataFrame([], schema).schema)
    stream = jobs.stale_alert_stream(counts)
    go(spark, tmp_path, stream)
    add(spark, folder, [("r", dt.date(2024, 1, 2), 5), ("r", dt.date(2024, 1, 3), 9)], schema)
    rows = sorted((r["day"].day, r["last"], r["change"], r["notify"]) for r in go(spark, tmp_path, stream))
    assert rows == [(1, 0, 2, True), (2, 2, 3, False), (3, 5, 4, True)]


def test_refresh_reads_one_earlier_state(spark, tmp_path):
    """Three rounds; before the last one the oldest state is made unreadable."""
    folder, state, schema = str(tmp_path / "in"), tmp_path / "state", "repo_id string, path string, mtime timestamp"
    artefacts = spark.createDataFrame([("r", "deps", at(5))], "repo_id string, target string, generated_at timestamp")

    def refresh():
        stream = jobs.new_files(spark, folder, spark.createDataFrame([], schema).schema)
        jobs.refresh_stream(stream, artefacts, str(state), str(tmp_path / "out"), str(tmp_path / "cp"), every=None).awaitTermination()

    for round_, minutes in enumerate((1, 9, 3)):
        add(spark, folder, [("r", f"src/f{round_}.js", at(minutes))], schema)
        if round_ == 2:
            (state / "batch=0" / "part-broken.parquet").write_bytes(b"not parquet")
        refresh()
    last = spark.read.parquet(str(state / "batch=2")).filter("target = 'deps'").first()
    assert (last["newest_source"], last["scanned"]) == ("src/f1.js", 3)
