"""Queries on dispatch, shards, run state, completeness and decisions over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsieve.catalog import views as V
from runsieve.catalog.registry import query
from runsieve.catalog.sql import with_views
from runsieve.operators import dispatch
from runsieve.operators import gate as G
from runsieve.operators import runs as R
from runsieve.operators.aggregate import latest_results
from runsieve.session import fresh_dir
from runsieve.sources import shards, state

RUN = "eval_run_id"
_AS_OF = "1998-06-01 00:00:00"
_TIMEOUT = 30 * 86400


def _as_of():
    return F.lit(_AS_OF).cast("timestamp")


def _case_keys(spark, sf):
    turns = V.table(spark, sf, "conversations").filter(F.col("role") == "user")
    return turns.select(
        F.concat(F.lit("run-"), F.col("conv_id") % 8).alias(RUN), F.concat_ws("-", "conv_id", "turn").alias("case_id"), "conv_id", "turn"
    )


def _sharded(spark, sf):
    return dispatch.assign_shards(_case_keys(spark, sf), ["conv_id", "turn"])


_SHARDED = {
    "placed": """
        SELECT eval_run_id, case_id, row_number() OVER (PARTITION BY eval_run_id ORDER BY conv_id, turn) - 1 AS pos
        FROM (SELECT 'run-' || (conv_id % 8) AS eval_run_id, conv_id || '-' || turn AS case_id, conv_id, turn
              FROM conversations WHERE role = 'user')""",
    "sharded": "SELECT *, pos // 8 AS shard_id, pos // 80 AS batch_id FROM placed",
}


@query("shard_assignment", with_views([], "SELECT eval_run_id, case_id, pos, shard_id, batch_id FROM sharded", _SHARDED))
def shard_assignment(spark, sf):
    return _sharded(spark, sf).select(RUN, "case_id", "pos", "shard_id", "batch_id")


@query(
    "dispatch_totals",
    with_views(
        [],
        "SELECT eval_run_id, count(*) AS total_cases, CAST(ceil(count(*) / 8.0) AS BIGINT) AS total_shards FROM sharded GROUP BY 1",
        _SHARDED,
    ),
)
def dispatch_totals(spark, sf):
    return dispatch.dispatch_totals(_sharded(spark, sf))


@query(
    "shard_jobs",
    with_views(
        [],
        """SELECT eval_run_id, shard_id, batch_id, string_agg(case_id, ',' ORDER BY pos) AS case_ids, 'offline' AS eval_mode,
                  eval_run_id || '-' || lpad(CAST(shard_id AS VARCHAR), 4, '0') AS group_id,
                  eval_run_id || '-shard-' || lpad(CAST(shard_id AS VARCHAR), 4, '0') AS dedup_id,
                  'runs/' || eval_run_id || '/shards/' || lpad(CAST(shard_id AS VARCHAR), 4, '0') || '.json' AS shard_key
           FROM sharded GROUP BY eval_run_id, shard_id, batch_id""",
        _SHARDED,
    ),
)
def shard_jobs(spark, sf):
    settings = _case_keys(spark, sf).select(RUN).distinct().withColumn("eval_mode", F.lit("offline"))
    jobs = dispatch.shard_jobs(_sharded(spark, sf), settings)
    return jobs.withColumn("case_ids", F.array_join("case_ids", ","))


@query(
    "snk_shard_layout",
    with_views(
        [],
        """SELECT eval_run_id, shard_id, shard_id // 1024 AS shard_block, count(*) AS n_cases, min(pos) AS first_pos, max(pos) AS last_pos
           FROM sharded GROUP BY 1, 2, 3""",
        _SHARDED,
    ),
)
def snk_shard_layout(spark, sf):
    path = fresh_dir(spark, "shards")
    shards.write_shards(_sharded(spark, sf), path)
    stored = shards.read_shards(spark, path)
    return stored.groupBy(RUN, "shard_id", F.col("shard_block").cast("bigint").alias("shard_block")).agg(
        F.count("*").alias("n_cases"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


@query(
    "shard_ids",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'r' || l_orderkey || '-' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS group_id,
              substr('r' || l_orderkey || '-shard-' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0'), 1, 128) AS dedup_id,
              'r' || l_orderkey || '-shard-' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '-result' AS result_dedup_id,
              'runs/r' || l_orderkey || '/results/shard-' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '.json' AS result_key,
              'eval-' || strftime(l_shipdate, '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(length(l_orderkey::VARCHAR) || ':' || l_orderkey || ';' || length(l_linenumber::VARCHAR) || ':' || l_linenumber || ';'), 1, 8) AS run_id
       FROM lineitem""",
)
def shard_ids(spark, sf):
    run, shard = F.concat(F.lit("r"), "l_orderkey"), F.col("l_linenumber")
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        dispatch.group_id(run, shard).alias("group_id"),
        dispatch.transport_id(dispatch.dedup_id(run, shard)).alias("dedup_id"),
        dispatch.result_dedup_id(run, shard).alias("result_dedup_id"),
        dispatch.run_paths(run, shard)["result_key"].alias("result_key"),
        dispatch.run_id(F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")).alias("run_id"),
    )


@query(
    "dispatch_resolve",
    with_views(
        ["v_last_manifests"],
        """SELECT t.c_custkey, CASE WHEN m.dataset_id IS NOT NULL THEN m.s3_uri WHEN t.dataset_key <> '' THEN 's3://in/' || t.dataset_key END AS dataset_uri,
                  CASE WHEN m.dataset_id IS NOT NULL THEN m.dataset_id WHEN t.dataset_key <> '' THEN
                       CASE WHEN t.dataset_id <> '' THEN t.dataset_id WHEN t.git_sha <> '' THEN t.git_sha ELSE 'golden' END END AS manifest_id,
                  m.dataset_id IS NULL AND coalesce(t.dataset_key <> '', false) AS insert_manifest,
                  CASE WHEN m.dataset_id IS NULL AND NOT coalesce(t.dataset_key <> '', false)
                       THEN 'a dataset key or a known dataset id is required' END AS error,
                  CASE WHEN c_mktsegment = 'BUILDING' THEN 'online' ELSE 'offline' END AS eval_mode, 'judge-default' AS judge_model_id
           FROM (SELECT c_custkey, c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'x' || c_custkey WHEN 2 THEN '' END AS dataset_id,
                        CASE WHEN c_custkey % 3 = 0 THEN 'sha' || c_custkey END AS git_sha,
                        CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'golden/' || c_custkey || '.json' END AS dataset_key FROM customer) t
           LEFT JOIN v_last_manifests m ON m.dataset_id = t.dataset_id""",
    ),
)
def dispatch_resolve(spark, sf):
    k = F.col("c_custkey")
    triggers = V.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("x"), k)).when(k % 4 == 2, "").alias("dataset_id"),
        F.when(k % 3 == 0, F.concat(F.lit("sha"), k)).alias("git_sha"),
        F.lit("golden").alias("dataset_name"),
        F.lit("in").alias("dataset_bucket"),
        F.when(k % 5 == 0, "").when(k % 5 != 1, F.concat(F.lit("golden/"), k, F.lit(".json"))).alias("dataset_key"),
        F.when(F.col("c_mktsegment") == "BUILDING", "online").alias("eval_mode"),
    )
    ready = dispatch.resolve_settings(triggers, {"eval_mode": "offline", "judge_model_id": ""}, {"eval_mode": "candidate", "judge_model_id": "judge-default"})
    found = dispatch.resolve_datasets(ready, _latest_manifests(spark, sf))
    return found.select("c_custkey", "dataset_uri", "manifest_id", "insert_manifest", "error", "eval_mode", "judge_model_id")


def _latest_manifests(spark, sf):
    items = state.manifest_items(V.manifest_writes(spark, sf))
    kept = items.withColumn("payload", F.when(F.col("seq") % 5 != 0, F.col("payload")))
    return state.latest_manifests(kept, ["written_at", "seq"])


@query(
    "manifest_latest",
    with_views(
        ["v_last_manifests"],
        """SELECT dataset_id, CASE WHEN o_orderkey % 5 = 0 THEN git_sha ELSE coalesce(git_sha, '') END AS git_sha, s3_uri, version,
                  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 = 0 THEN '' ELSE name END AS name, case_count
           FROM v_last_manifests""",
    ),
)
def manifest_latest(spark, sf):
    return _latest_manifests(spark, sf)


@query(
    "run_state_decode",
    with_views(
        ["v_runs"],
        """SELECT eval_run_id, CASE WHEN o_custkey % 6 = 0 THEN CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE status END ELSE 'aggregating' END AS status,
                  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE total_cases END AS total_cases,
                  CASE WHEN o_custkey % 4 <> 0 THEN completed_shards + 1 WHEN o_custkey % 11 = 0 THEN NULL ELSE completed_shards END AS completed_shards,
                  CASE WHEN o_custkey % 11 = 0 THEN 'item has no payload' END AS decode_error FROM v_runs""",
    ),
)
def run_state_decode(spark, sf):
    c = F.col("o_custkey")
    items = (
        state.run_items(V.runs(spark, sf).withColumn("created_at", G.iso_text(F.col("created_at"))))
        .withColumn("payload", F.when(c % 11 != 0, F.col("payload")))
        .withColumn("status", F.when(c % 6 == 0, "odd").otherwise("aggregating"))
        .withColumn("completed_shards", F.when(c % 4 != 0, F.col("completed_shards") + 1))
        .withColumn("completed_cases", F.lit(None).cast("bigint"))
    )
    return state.decode_runs(items).select(RUN, "status", "total_cases", "completed_shards", "decode_error")


@query("open_runs", with_views(["v_runs"], "SELECT eval_run_id, status FROM v_runs WHERE status IN ('pending', 'running', 'aggregating')"))
def open_runs(spark, sf):
    return G.open_runs(V.runs(spark, sf)).select(RUN, "status")


_ACTIONS = f"""
    SELECT *, n_results >= total_cases OR completed_shards >= total_shards AS complete,
           epoch(TIMESTAMP '{_AS_OF}') - epoch(created_at) >= {_TIMEOUT} AS timed_out FROM v_runs"""


@query(
    "run_timeouts",
    with_views(
        ["v_runs"],
        "SELECT eval_run_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, timed_out FROM acted",
        {"acted": _ACTIONS},
    ),
)
def run_timeouts(spark, sf):
    text = G.iso_text(F.col("created_at"))
    rows = V.runs(spark, sf).select(RUN, text.alias("created_at"))
    return rows.withColumn("timed_out", G.timed_out(G.utc_instant(F.col("created_at")), _as_of(), _TIMEOUT))


@query(
    "run_actions",
    with_views(
        ["v_runs"],
        """SELECT eval_run_id, complete, timed_out, timed_out AND NOT complete AS gate_timed_out,
                  CASE WHEN status IN ('pass', 'fail') AND NOT force THEN 'skip'
                       WHEN NOT complete AND NOT timed_out AND NOT force THEN 'wait' ELSE 'aggregate' END AS action FROM acted""",
        {"acted": _ACTIONS},
    ),
)
def run_actions(spark, sf):
    return G.run_actions(V.runs(spark, sf), _as_of(), _TIMEOUT).select(RUN, "complete", "timed_out", "gate_timed_out", "action")


@query(
    "run_status_latest",
    """SELECT CAST(o_custkey AS VARCHAR) AS eval_run_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'aggregating' ELSE 'fail' END AS status,
              strftime(o_orderdate, '%Y-%m-%d') AS changed_on
       FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def run_status_latest(spark, sf):
    s = F.col("o_orderstatus")
    log = V.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias(RUN),
        F.when(s == "O", "running").when(s == "P", "aggregating").otherwise("fail").alias("status"),
        "o_orderdate",
        "o_orderkey",
    )
    last = R.latest_status(log, ["o_orderdate", "o_orderkey"])
    return last.select(RUN, "status", F.date_format("o_orderdate", "yyyy-MM-dd").alias("changed_on"))


@query(
    "run_manifest_join",
    with_views(
        [],
        """SELECT CAST(r.l_orderkey AS VARCHAR) AS eval_run_id, r.l_linenumber, r.l_partkey, r.l_suppkey,
                  CASE WHEN a.o_orderkey IS NOT NULL THEN 'state' WHEN b.o_orderkey IS NOT NULL THEN 'file' ELSE 'missing' END AS manifest_source,
                  coalesce(a.o_orderpriority, b.o_orderpriority) AS dataset_version
           FROM lineitem r LEFT JOIN orders a ON a.o_orderkey = r.l_orderkey AND a.o_orderstatus = 'O'
                LEFT JOIN orders b ON b.o_orderkey = r.l_orderkey AND b.o_orderstatus <> 'P'""",
    ),
)
def run_manifest_join(spark, sf):
    orders = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias(RUN), F.col("o_orderpriority").alias("dataset_version"), "o_orderstatus"
    )
    results = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias(RUN), "l_linenumber", "l_partkey", "l_suppkey"
    )
    live = orders.filter(F.col("o_orderstatus") == "O")
    stored = orders.filter(F.col("o_orderstatus") != "P")
    return R.join_manifests(results, live, stored, ["dataset_version"])


@query(
    "missing_cases",
    with_views(
        ["v_redelivered"],
        """SELECT DISTINCT eval_run_id, case_id FROM v_redelivered d
           WHERE NOT EXISTS (SELECT 1 FROM v_redelivered r WHERE r.eval_run_id = d.eval_run_id AND r.case_id = d.case_id AND r.l_returnflag <> 'R')""",
    ),
)
def missing_cases(spark, sf):
    rows = V.redelivered(spark, sf)
    dispatched = rows.select(RUN, "case_id").distinct()
    return R.missing_cases(dispatched, rows.filter(F.col("l_returnflag") != "R").select(RUN, "case_id"))


@query(
    "results_dedup",
    with_views(
        ["v_redelivered"],
        """SELECT eval_run_id, case_id, strftime(l_shipdate, '%Y-%m-%d') AS delivered_on, l_partkey, l_suppkey, l_quantity, l_extendedprice
           FROM v_redelivered QUALIFY row_number() OVER (PARTITION BY eval_run_id, case_id
             ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1""",
    ),
)
def results_dedup(spark, sf):
    rows = V.redelivered(spark, sf).select(RUN, "case_id", *V.DELIVERY_ORDER)
    last = latest_results(rows, V.DELIVERY_ORDER)
    return last.withColumn("delivered_on", F.date_format("l_shipdate", "yyyy-MM-dd")).drop("l_shipdate")


@query(
    "shard_summary",
    with_views(
        ["v_redelivered"],
        "SELECT eval_run_id, shard_id, count(*) AS cases, count(*) FILTER (error <> '') AS errors FROM v_redelivered GROUP BY 1, 2",
    ),
)
def shard_summary(spark, sf):
    return R.shard_summary(V.redelivered(spark, sf))


@query(
    "shard_progress",
    with_views(
        ["v_redelivered"],
        """SELECT eval_run_id, count(*) AS completed_shards, CAST(sum(n) AS BIGINT) AS completed_cases, CAST(sum(d) AS BIGINT) AS deliveries
           FROM (SELECT eval_run_id, shard_id, CAST(max(l_quantity) AS BIGINT) AS n, count(*) AS d FROM v_redelivered GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def shard_progress(spark, sf):
    done = V.redelivered(spark, sf).select(RUN, "shard_id", F.col("l_quantity").cast("bigint").alias("n_cases"))
    return R.shard_progress(done)


@query(
    "dead_letters",
    """SELECT l_orderkey, l_linenumber, count(*) AS attempts FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def dead_letters(spark, sf):
    failed = V.table(spark, sf, "lineitem").filter(F.col("l_returnflag") != "N")
    return R.dead_letters(failed, ["l_orderkey", "l_linenumber"], max_receives=3)
