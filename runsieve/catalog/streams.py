"""Streaming queries, run over the given tables as file streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsieve.catalog import views as V
from runsieve.catalog import lifecycle as _lifecycle  # noqa: F401 - registers results_dedup
from runsieve.catalog.ingest import golden_documents
from runsieve.catalog.registry import ORACLES, query
from runsieve.catalog.sql import exact_mean, exact_units, rnd, with_views
from runsieve.functions.numbers import round_exact
from runsieve.operators.aggregate import latest_results
from runsieve.schemas import GOLDEN
from runsieve.session import fresh_dir
from runsieve.sources.golden import write_golden
from runsieve.sources.sinks import read_log
from runsieve.streaming import lifecycle as S
from runsieve.streaming import runs as R
from runsieve.streaming.io import drain, file_stream, table_glob

RUN = "eval_run_id"


def _stream(spark, sf, name):
    return file_stream(spark, table_glob(sf, name), V.table(spark, sf, name).schema)


@query(
    "stream_dispatch",
    with_views(
        ["v_lines"],
        """SELECT 'doc-' || doc_id AS dataset_id, pos // 8 AS shard_id, count(*) AS n_cases, min('L' || pos) AS first_case
           FROM (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS pos FROM v_lines) GROUP BY 1, 2""",
    ),
)
def stream_dispatch(spark, sf):
    folder = fresh_dir(spark, "golden")
    write_golden(golden_documents(spark, sf), folder)
    arrived = file_stream(spark, f"{folder}/*.json.gz", GOLDEN, "json")
    cases = drain(S.dispatch_stream(arrived).select("dataset_id", "shard_id", "pos", "case_id"), "dispatch")
    return cases.groupBy("dataset_id", "shard_id").agg(F.count("*").alias("n_cases"), F.min("case_id").alias("first_case"))


@query(
    "stream_dedup_jobs",
    """SELECT DISTINCT user_id || '-' || event_type || '-' || strftime(ts, '%Y%m%d') AS dedup_id FROM events""",
)
def stream_dedup_jobs(spark, sf):
    key = F.concat_ws("-", "user_id", "event_type", F.date_format("ts", "yyyyMMdd")).alias("dedup_id")
    jobs = _stream(spark, sf, "events").select(key)
    return S.unique_jobs(drain(jobs, "jobs", lambda b: S.job_keys(b, ["dedup_id"])), ["dedup_id"])


@query(
    "stream_run_progress",
    """SELECT CAST(user_id AS VARCHAR) AS eval_run_id, count(DISTINCT CAST(ts AS DATE)) AS completed_shards,
              CAST(sum(DISTINCT day(ts)) AS BIGINT) AS completed_cases, count(DISTINCT CAST(ts AS DATE)) >= 26 AS complete FROM events GROUP BY 1""",
)
def stream_run_progress(spark, sf):
    done = _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias(RUN),
        F.date_format("ts", "yyyy-MM-dd").alias("shard_id"),
        F.dayofmonth("ts").cast("bigint").alias("n_cases"),
    )
    return S.run_progress(drain(done, "progress", S.finished_shards)).withColumn("complete", F.col("completed_shards") >= 26)


_YEAR = 365 * 86400


@query(
    "stream_run_timeouts",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS eval_run_id, strftime(o_orderdate, '%Y-%m-%d') AS created_on FROM orders
        WHERE o_orderdate + INTERVAL '{_YEAR} seconds' < (SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)))
          AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL '{_YEAR} seconds')""",
)
def stream_run_timeouts(spark, sf):
    started = _stream(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias(RUN), F.col("o_orderdate").alias("created_at"))
    finished = _stream(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias(RUN), F.col("l_shipdate").alias("finished_at"))
    starts, ends = drain(started, "starts", S.started_runs), drain(finished, "ends", S.finished_runs)
    # The sweep comes when all has arrived: its time is the newest that either log knows.
    sweep = F.greatest(starts.agg(F.max("created_at")).scalar(), ends.agg(F.max("finished_at")).scalar())
    late = S.run_timeouts(starts.drop("batch_id"), ends.drop("batch_id"), _YEAR, sweep)
    return late.select(RUN, F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


_CLOCK = "2010-01-01 00:00:00"


@query(
    "stream_run_outcomes",
    f"""WITH firsts AS (SELECT o_custkey, min(o_orderdate) + INTERVAL '{2 * _YEAR} seconds' AS due FROM orders GROUP BY 1),
             counted AS (
               SELECT o_custkey, count(*) FILTER (WHERE o_orderdate <= due) AS shards,
                      CAST(coalesce(sum(day(o_orderdate)) FILTER (WHERE o_orderdate <= due), 0) AS BIGINT) AS cases
               FROM orders JOIN firsts USING (o_custkey) GROUP BY 1)
        SELECT CAST(o_custkey AS VARCHAR) AS eval_run_id, CASE WHEN o_custkey % 3 = 0 THEN 'timeout' ELSE 'complete' END AS outcome,
               CAST(NULL AS VARCHAR) AS shard_id, shards AS completed_shards, cases AS completed_cases FROM counted
        UNION ALL
        SELECT CAST(o_custkey AS VARCHAR), 'late', CAST(o_orderkey AS VARCHAR), NULL, NULL
        FROM orders JOIN firsts USING (o_custkey) WHERE o_orderdate > due""",
)
def stream_run_outcomes(spark, sf):
    """Customers as runs, their orders as shards, each delivered twice; every third run misses a shard."""
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    due = F.min("at").over(Window.partitionBy("o_custkey")) + F.expr(f"INTERVAL {2 * _YEAR} SECONDS")
    sized = orders.withColumn("in_time", F.col("at") <= due).groupBy("o_custkey").agg(F.min("at").alias("at"), F.count_if("in_time").alias("n"))
    total = F.col("n") + (F.col("o_custkey") % 3 == 0).cast("int")
    root = fresh_dir(spark, "outcomes")
    starts = R.start_events(sized, F.col("o_custkey"), F.col("at"), total)
    shards = R.shard_events(orders, F.col("o_custkey"), F.col("o_orderkey"), F.dayofmonth("at"), F.col("at"))
    shards.unionAll(starts).unionAll(shards).write.parquet(f"{root}/events")
    _track(spark, root)
    # The sweep comes when all has arrived: the stream goes on where it stopped.
    R.clock_events(spark.range(1), F.lit(_CLOCK).cast("timestamp")).write.mode("append").parquet(f"{root}/events")
    _track(spark, root)
    told = read_log(spark, f"{root}/log", T.StructType.fromDDL(R.OUTCOME))
    own = F.col("outcome") != "late"
    return told.select(RUN, "outcome", "shard_id", *[F.when(own, F.col(c)).alias(c) for c in ("completed_shards", "completed_cases")])


def _track(spark, root):
    # A batch visits every run that it has rows of, so small batches would visit each run many times.
    events = file_stream(spark, f"{root}/events", T.StructType.fromDDL(R.EVENT))
    R.start_tracking(R.track_runs(events, 2 * _YEAR, by_event_time=True), root, availableNow=True).awaitTermination()


@query(
    "late_results",
    """SELECT e.event_id, coalesce(e.ts > g.gated_at, false) AS late,
              CASE WHEN NOT coalesce(e.ts > g.gated_at, false) THEN 'on_time' WHEN e.user_id % 10 = 0 THEN 'regate' ELSE 'late_result' END AS outcome
       FROM events e LEFT JOIN (SELECT user_id, max(ts) AS gated_at FROM events WHERE event_type = 'signup' GROUP BY 1) g USING (user_id)""",
)
def late_results(spark, sf):
    gates = (
        V.table(spark, sf, "events")
        .filter(F.col("event_type") == "signup")
        .groupBy(F.col("user_id").cast("string").alias(RUN))
        .agg(F.max("ts").cast("timestamp").alias("gated_at"))
    )
    results = _stream(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias(RUN), "ts", "user_id")
    log = drain(S.late_results(results, gates, force=F.col("user_id") % 10 == 0), "late")
    return log.select("event_id", "late", "outcome")


@query("stream_upsert", ORACLES["results_dedup"])
def stream_upsert(spark, sf):
    rows = _stream(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias(RUN), F.col("l_linenumber").cast("string").alias("case_id"), *V.DELIVERY_ORDER
    )
    # Deliveries carry their own total order, so the batch number does not decide.
    last = latest_results(drain(rows, "upsert").drop("batch_id"), V.DELIVERY_ORDER)
    return last.withColumn("delivered_on", F.date_format("l_shipdate", "yyyy-MM-dd")).drop("l_shipdate")


@query(
    "metric_tumbling_avg",
    with_views(
        [],
        f"""SELECT event_type, window_start, n, {rnd('avg')} AS mean FROM (
              SELECT event_type, window_start, n, {exact_mean('units', 'n')} AS avg FROM (
                SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*) AS n, sum({exact_units('value')}) AS units
                FROM events GROUP BY 1, 2))""",
    ),
)
def metric_tumbling_avg(spark, sf):
    values = _stream(spark, sf, "events").select("ts", "event_type", "value")
    log = drain(values, "averages", lambda b: S.window_sums(b, "ts", ["event_type"], "value", "1 day"))
    means = S.window_means(log, ["event_type"])
    return means.select(
        "event_type", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n", round_exact("mean").alias("mean")
    )
