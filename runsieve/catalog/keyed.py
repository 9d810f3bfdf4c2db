"""Queries over keyed tables: state with deltas and compaction, reports from stored partials."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsieve.catalog import aggregates as A
from runsieve.catalog import views as V
from runsieve.catalog.registry import ORACLES, query
from runsieve.catalog.sql import with_views
from runsieve.operators import aggregate as agg
from runsieve.plans import attempts as at
from runsieve.plans.incremental import deliver, partials_table, regate
from runsieve.session import fresh_dir
from runsieve.sources.keyed import KeyedTable

RUN = "eval_run_id"
_ROWS = "eval_run_id string, shard_id bigint, l_shipdate date, l_partkey bigint, l_suppkey bigint, flag string"
_BATCHES = ("N", "A", "R")
_LAST = """SELECT '{label}' AS state, eval_run_id, shard_id, strftime(l_shipdate, '%Y-%m-%d') AS delivered_on, l_partkey, l_suppkey, l_returnflag AS flag
           FROM v_redelivered WHERE l_returnflag IN ({flags}) QUALIFY row_number() OVER (PARTITION BY eval_run_id, shard_id
             ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END DESC,
                      l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1"""


@query(
    "keyed_shard_state",
    with_views(
        ["v_redelivered"],
        "SELECT * FROM before_last UNION ALL SELECT * FROM at_last",
        {"before_last": _LAST.format(label="before", flags="'N', 'A'"), "at_last": _LAST.format(label="now", flags="'N', 'A', 'R'")},
    ),
)
def keyed_shard_state(spark, sf):
    """Three batches of deliveries with a replay and a compaction; the state now and before the last batch."""
    state = KeyedTable(spark, fresh_dir(spark, "shard-state"), _ROWS, (RUN, "shard_id"), (RUN,), buckets=8)
    rows = V.redelivered(spark, sf).withColumn("flag", F.col("l_returnflag"))
    versions = {}
    for i, flag in enumerate(_BATCHES):
        batch = rows.filter(F.col("flag") == flag)
        for _ in range(2 if flag == "A" else 1):
            versions[flag] = state.upsert(batch, V.DELIVERY_ORDER, "deliveries", i)
        if flag == "A":
            state.compact()
    both = [state.read(v).withColumn("state", F.lit(label)) for label, v in (("before", versions["A"]), ("now", None))]
    found = both[0].unionByName(both[1])
    return found.withColumn("delivered_on", F.date_format("l_shipdate", "yyyy-MM-dd")).drop("l_shipdate")


@query("incremental_reports", ORACLES["run_report"])
def incremental_reports(spark, sf):
    """Every shard (user, day) is delivered; those of odd days came as errors first and come again whole."""
    day = F.element_at(F.split("case_id", "/"), -1)
    scores, flags = (rows.withColumn("shard_id", day) for rows in (A._event_scores(spark, sf), A._event_flags(spark, sf)))
    odd = F.substring("shard_id", -2, 2).cast("int") % 2 == 1
    table = partials_table(spark, fresh_dir(spark, "partials"), buckets=8)
    early = flags.withColumn("has_error", F.col("has_error") | odd)
    deliver(table, agg.long_facts(scores.filter(~odd), early, keep=("shard_id",)), "results", 0)
    for _ in range(2):
        deliver(table, agg.long_facts(scores.filter(odd), flags.filter(odd), keep=("shard_id",)), "results", 1)
    table.compact()
    return A.report_columns(regate(table, A._event_runs(spark, sf)).withColumn("judge_model_id", F.lit("judge-a")))


_AS_OF = "1995-06-17 00:30:00"


@query(
    "attempt_states",
    f"""WITH told AS (
          SELECT l_orderkey, l_shipdate::DATE AS d, l_returnflag AS flag, l_linenumber FROM lineitem
          QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey ORDER BY l_shipdate::DATE DESC, l_returnflag = 'N' DESC, l_returnflag DESC) = 1),
        counted AS (
          SELECT l_orderkey, count(*) FILTER (flag <> 'N') AS failures, bool_or(flag = 'N') AS done,
                 max(d) FILTER (flag <> 'N') AS last FROM told GROUP BY 1),
        timed AS (SELECT *, CASE WHEN NOT done AND failures < 3 THEN last::TIMESTAMP + to_seconds(least(3600, 60 * 2 ** (failures - 1))::BIGINT) END AS due FROM counted)
        SELECT l_orderkey::VARCHAR AS message_id, failures, coalesce(strftime(due, '%Y-%m-%d %H:%M:%S'), '') AS due_at,
               CASE WHEN done THEN 'done' WHEN failures >= 3 THEN 'quarantined' WHEN due <= TIMESTAMP '{_AS_OF}' THEN 'due' ELSE 'waiting' END AS state
        FROM timed""",
)
def attempt_states(spark, sf):
    """Every line is an attempt on its order; two batches, the second one told twice, and a compaction between."""
    ledger = at.attempt_ledger(spark, fresh_dir(spark, "attempts"), buckets=8)
    failed = F.col("l_returnflag") != "N"
    receipt = F.concat_ws("-", "l_linenumber", "l_suppkey")
    code = F.when(failed, F.concat("l_returnflag", F.lit("Throttled")))
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("message_id"), receipt.alias("receipt"), F.to_date("l_shipdate").cast("timestamp").alias("ended_at"),
        (~failed).alias("ok"), code.alias("code"), code.alias("error"), (F.col("l_orderkey") % 2).alias("half"),
    )
    for half in (0, 1, 1):
        at.record(ledger, rows.filter(F.col("half") == half).drop("half"), "queue", half)
        if half == 0:
            ledger.compact()
    states = at.message_states(ledger.read(), F.lit(_AS_OF).cast("timestamp"))
    return states.select("message_id", "failures", F.coalesce(F.date_format("due_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("due_at"), "state")
