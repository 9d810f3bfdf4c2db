from __future__ import annotations

import time
from datetime import datetime

import pytest
from oracle import compare, duck
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runsieve.catalog import all_oracles, all_queries
from runsieve.session import fresh_dir
from runsieve.sources.sinks import read_log
from runsieve.streaming import lifecycle as S
from runsieve.streaming import runs as R
from runsieve.streaming.io import drain, file_stream


def _files(spark, label, schema, *batches):
    """A folder with one file per batch, read one file per micro-batch in order."""
    folder = fresh_dir(spark, label)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    static = spark.read.parquet(folder).schema
    return file_stream(spark, folder, static, max_files=1)


def _ts(stream, *names):
    for name in names:
        stream = stream.withColumn(name, F.to_timestamp(name))
    return stream


def test_redelivered_jobs_are_dropped_across_batches(spark):
    schema = "dedup_id string, ts string"
    stream = _files(spark, "jobs", schema, [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:01:00")], [("a", "2024-01-01 00:02:00"), ("c", "2024-01-01 00:03:00")])
    log = drain(_ts(stream, "ts"), "unique", lambda b: S.job_keys(b, ["dedup_id"]))
    assert sorted(r["dedup_id"] for r in S.unique_jobs(log, ["dedup_id"]).collect()) == ["a", "b", "c"]
    assert log.select("batch_id").distinct().count() >= 2


def test_progress_counts_each_shard_once(spark):
    schema = "eval_run_id string, shard_id bigint, n_cases bigint, ts string"
    day = "2024-01-01 00:00:00"
    stream = _files(spark, "done", schema, [("r", 0, 8, day), ("r", 0, 8, day), ("s", 0, 1, day)], [("r", 0, 8, day), ("r", 1, 2, day)])
    log = drain(stream, "progress", S.finished_shards)
    got = {r["eval_run_id"]: (r["completed_shards"], r["completed_cases"]) for r in S.run_progress(log).collect()}
    assert got == {"r": (2, 10), "s": (1, 1)}


def test_timeouts_by_event_time(spark):
    starts = [("late", "2024-01-01 00:00:00"), ("done", "2024-01-01 00:00:00"), ("slow", "2024-01-01 00:00:00"), ("open", "2024-01-01 02:50:00"), ("end", "2024-01-01 03:00:00")]
    ends = [("done", "2024-01-01 00:10:00"), ("slow", "2024-01-01 02:00:00"), ("x", "2024-01-01 03:00:00")] + [("done", "2024-01-01 00:10:00")] * 50
    started = _ts(_files(spark, "starts", "eval_run_id string, created_at string", starts), "created_at")
    finished = _ts(_files(spark, "ends", "eval_run_id string, finished_at string", ends), "finished_at")
    as_of = F.lit("2024-01-01 03:00:00").cast("timestamp")
    log = drain(started, "s", S.started_runs)
    due = S.run_timeouts(log, drain(finished, "f", S.finished_runs), 1800, as_of)
    assert sorted(r["eval_run_id"] for r in due.collect()) == ["late", "slow"]
    # A fleet that reports nothing is what the sweep is for.
    none = spark.createDataFrame([], "eval_run_id string, finished_at timestamp")
    assert sorted(r["eval_run_id"] for r in S.run_timeouts(log, none, 1800, as_of).collect()) == ["done", "late", "slow"]


def _outcomes(spark, batches, root):
    """Each batch is a further file and a restart of the stream from its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, R.EVENT).coalesce(1).write.mode("append").parquet(f"{root}/events")
        events = file_stream(spark, f"{root}/events", StructType.fromDDL(R.EVENT), max_files=1)
        R.start_tracking(R.track_runs(events, 1800, by_event_time=True), root, availableNow=True).awaitTermination(60)
    return _told(spark, root)


def _told(spark, root):
    log = read_log(spark, f"{root}/log", StructType.fromDDL(R.OUTCOME))
    return sorted((r["eval_run_id"], r["outcome"], r["shard_id"] or "") for r in log.collect())


def test_runs_complete_once_or_time_out(spark):
    def at(minute):
        return datetime(2024, 1, 1, minute // 60, minute % 60)

    def start(run, total, minute=0):
        return ("start", run, at(minute), total, None, None, None, None)

    def shard(run, shard_id, minute):
        return ("shard", run, None, None, shard_id, 8, at(minute), None)

    rows = [
        start("whole", 2), shard("whole", "0", 5), shard("whole", "1", 6), shard("whole", "0", 5),
        start("dead", 3), start("part", 2), shard("part", "0", 5), shard("part", "1", 45), start("young", 1, 170),
        shard("before", "0", 3), shard("before", "0", 3), start("before", 1),
    ]
    clock, after = ("clock", None, None, None, None, None, None, at(180)), [shard("dead", "2", 7), shard("whole", "1", 6), start("whole", 2)]
    want = [
        ("before", "complete", ""), ("dead", "late", "2"), ("dead", "timeout", ""), ("part", "late", "1"), ("part", "timeout", ""), ("whole", "complete", ""),
    ]
    assert _outcomes(spark, [rows, [clock], after], fresh_dir(spark, "once")) == want
    assert _outcomes(spark, [rows[5:], rows[:5], rows[3:], [clock], after, after], fresh_dir(spark, "many")) == want


class _Store:
    """A state variable and a handle in one, which counts its calls."""

    def __init__(self):
        self.value, self.entries, self.timers, self.calls = None, {}, [], 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        return self.get() is not None

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def containsKey(self, key):
        self.calls += 1
        return key in self.entries

    def updateValue(self, key, value):
        self.calls += 1
        self.entries[key] = value

    def iterator(self):
        self.calls += 1
        return iter(list(self.entries.items()))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def _tracked(batches):
    """Outcomes and state calls of one run over batches of ``(kind, shard, size, at)``."""
    store, tracker = _Store(), R.RunTracker(10, 100)
    tracker.init(store)
    told = []
    for batch in batches:
        rows = [Row(kind=k, shard_id=s, size=n, at_ms=t, total_shards=n, n_cases=n, created_ms=t, finished_ms=t) for k, s, n, t in batch]
        told += [(r["outcome"], r["shard_id"], r["completed_shards"], r["completed_cases"]) for r in tracker.handleInputRows(("r",), iter(rows), None)]
    return told, store


def test_runs_take_few_state_calls():
    shards = [("shard", str(i), 2, 5000) for i in range(10)]
    told, store = _tracked([[*shards, ("start", None, 10, 0), *shards], shards, shards])
    assert told == [("complete", None, 10, 20)] and store.timers == [10001]
    assert store.calls <= 6


def test_large_runs_keep_every_shard():
    """More shards than the run's record holds, some late, before and after the start, all delivered again."""
    shards = [("shard", str(i), 2, 20000 if i % 10 == 0 else 5000) for i in range(300)]
    late = sorted(("late", str(i)) for i in range(0, 300, 10))
    for batches in ([[*shards, ("start", None, 270, 0), *shards], shards], [shards[:150], shards[:150], [*shards[100:], ("start", None, 270, 0)], shards]):
        told, store = _tracked(batches)
        assert [t for t in told if t[0] == "complete"] == [("complete", None, 270, 540)]
        assert sorted(t[:2] for t in told if t[0] == "late") == late and len(store.entries) == 300 - R.NEAR_SHARDS


def test_runs_time_out_by_the_clock_of_the_cluster(spark):
    """Nothing arrives after the starts; only the clock goes on."""
    root, rows = fresh_dir(spark, "wall"), [("start", run, datetime(year, 1, 1), 1, None, None, None, None) for run, year in (("dead", 2024), ("young", 2099))]
    spark.createDataFrame(rows, R.EVENT).coalesce(1).write.parquet(f"{root}/events")
    query = R.start_tracking(R.track_runs(file_stream(spark, f"{root}/events", StructType.fromDDL(R.EVENT)), 1800), root, processingTime="1 second")
    until = time.time() + 60
    while not _told(spark, root) and time.time() < until:
        time.sleep(1)
    query.stop()
    assert _told(spark, root) == [("dead", "timeout", "")]


def test_late_results_policy(spark):
    schema = "eval_run_id string, ts string, force boolean"
    rows = [("a", "2024-01-01 00:00:00", False), ("a", "2024-01-03 00:00:00", False), ("b", "2024-01-03 00:00:00", True), ("c", "2024-01-03 00:00:00", False)]
    gates = spark.createDataFrame([("a", "2024-01-02 00:00:00"), ("b", "2024-01-02 00:00:00")], "eval_run_id string, gated_at string")
    gates = gates.withColumn("gated_at", F.to_timestamp("gated_at"))
    log = drain(S.late_results(_ts(_files(spark, "late", schema, rows), "ts"), gates, force=F.col("force")), "late")
    assert sorted(r["outcome"] for r in log.collect()) == ["late_result", "on_time", "on_time", "regate"]


def test_tumbling_means_across_batches(spark):
    schema = "name string, value double, ts string"
    first = [("m", 0.85, "2024-01-01 01:00:00")] * 3 + [("m", 1.0, "2024-01-02 01:00:00")]
    second = [("m", 0.85, "2024-01-01 05:00:00")] * 4
    stream = _ts(_files(spark, "avg", schema, first, second), "ts")
    log = drain(stream, "avg", lambda b: S.window_sums(b, "ts", ["name"], "value", "1 day"))
    means = S.window_means(log, ["name"]).orderBy("window_start").collect()
    assert [(r["n"], r["mean"]) for r in means] == [(7, 0.85), (1, 1.0)]


STREAMS = ["stream_dedup_jobs", "stream_run_progress", "stream_run_timeouts", "stream_run_outcomes", "late_results", "metric_tumbling_avg"]


@pytest.mark.parametrize("max_files", [1, 1000])
@pytest.mark.parametrize("name", STREAMS)
def test_streams_do_not_depend_on_files_or_batches(spark, monkeypatch, name, max_files, shuffled_tables):
    """Rows dealt at random over the part files of a directory, in one batch or a batch per file."""
    import runsieve.catalog.streams as C

    monkeypatch.setattr(C, "file_stream", lambda *a, **k: file_stream(*a, **{**k, "max_files": max_files}))
    ok, text = compare(spark, duck("/root/testdata/sf0.001"), shuffled_tables, all_queries()[name], all_oracles()[name])
    assert ok, text


def test_sweep_sees_all_runs_of_the_tables(spark, tmp_path):
    """Runs of every year are swept, and the clock goes on although completions stop early."""
    starts = [(1, "1996-01-01"), (2, "1999-01-01"), (3, "2000-06-01"), (4, "2001-08-01"), (5, "2001-01-01"), (6, "2000-01-01")]
    ends = [(1, "1996-02-01"), (3, "2000-07-01"), (6, "2001-06-01")]
    orders = spark.createDataFrame(starts, "o_orderkey bigint, o_orderdate string")
    orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.createDataFrame(ends, "l_orderkey bigint, l_shipdate string")
    lines.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = all_queries()["stream_run_timeouts"](spark, str(tmp_path)).collect()
    assert sorted((r["eval_run_id"], r["created_on"]) for r in got) == [("2", "1999-01-01"), ("6", "2000-01-01")]


@pytest.fixture(scope="module")
def shuffled_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shuffled"))
    for name in ("events", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(4).write.parquet(f"{folder}/{name}.parquet")
    return folder
