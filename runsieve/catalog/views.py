"""Evaluation inputs derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.functions.text import strip
from runsieve.session import spread

_NO_TEXTS = "cast(array() AS array<string>)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, spread over the cores."""
    return spread(table(spark, sf_dir, name))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per user turn; the recorded answer is the assistant's next turn."""
    turns, docs = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents")
    said = turns.filter("role = 'assistant'")
    reply = said.selectExpr("conv_id", "turn - 1 AS turn", "text AS reply")
    later = said.selectExpr("conv_id", "turn - 3 AS turn", "text AS later")
    wanted = docs.selectExpr("doc_id AS conv_id", "text AS wanted")
    found = docs.selectExpr("doc_id - 1 AS conv_id", "text AS found")
    joined = (
        spread(turns.filter("role = 'user'"))
        .join(reply, ["conv_id", "turn"], "left")
        .join(later, ["conv_id", "turn"], "left")
        .join(wanted, "conv_id", "left")
        .join(found, "conv_id", "left")
    )
    tools = """
        CASE conv_id % 3 WHEN 0 THEN array('search_docs') WHEN 1 THEN array('create_ticket', 'lookup_oncall')
             ELSE array('search_docs', ' warehouse_query ', '') END"""
    called = f"""
        CASE floor(turn / 2) % 4 WHEN 0 THEN expected_tools WHEN 1 THEN slice(expected_tools, 1, 1)
             WHEN 2 THEN concat(expected_tools, array('delete_bucket', 'search_docs')) ELSE {_NO_TEXTS} END"""
    trace = f"""
        CASE WHEN reply IS NOT NULL THEN named_struct(
            'answer', reply,
            'retrieved_contexts', CASE WHEN conv_id % 2 = 1 THEN {_NO_TEXTS} ELSE array_compact(array(reply, found)) END,
            'tool_calls', transform({called}, n -> named_struct('name', n, 'arguments', '{{}}', 'result', string(NULL))),
            'latency_ms', conv_id % 100,
            'metadata', '{{}}') END"""
    return joined.withColumn("expected_tools", F.expr(tools)).selectExpr(
        "concat('run-', conv_id % 8) AS eval_run_id",
        "concat_ws('-', conv_id, turn) AS case_id",
        "conv_id",
        "turn",
        "CASE conv_id % 3 WHEN 0 THEN 'rag' WHEN 1 THEN 'tool_calling' ELSE 'hybrid' END AS suite",
        "text AS query",
        "CASE WHEN (conv_id + turn) % 4 = 0 THEN reply ELSE later END AS expected_answer",
        f"CASE WHEN conv_id % 5 = 0 THEN {_NO_TEXTS} ELSE array_compact(array(wanted)) END AS expected_contexts",
        "expected_tools",
        f"{trace} AS recorded_trace",
        "'{}' AS metadata",
        "CASE WHEN conv_id % 8 < 3 THEN 'offline' WHEN conv_id % 8 < 6 THEN 'candidate' ELSE 'online' END AS eval_mode",
        "CASE WHEN conv_id % 8 <> 7 THEN 'https://agent.example' END AS agent_endpoint",
        "later AS live_answer",
    )


def live_responses(cases_df: DataFrame) -> DataFrame:
    """Live replies for the online cases, as normalised rows."""
    return cases_df.filter(F.col("live_answer").isNotNull()).select(
        "eval_run_id",
        "case_id",
        F.col("live_answer").alias("answer"),
        F.col("expected_contexts").alias("retrieved_contexts"),
        F.array().cast("array<struct<name:string,arguments:string,result:string>>").alias("tool_calls"),
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their non-blank lines, stripped, in order."""
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    return texts(spark, sf_dir, "documents").withColumn("lines", lines)


def doc_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tool cases: first half of the words expected, the rest called."""
    words = texts(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    return words.select(
        "doc_id",
        F.when(half > 0, F.slice("w", F.lit(1), half)).otherwise(F.array().cast("array<string>")).alias("expected_tools"),
        F.slice("w", half + 1, F.size("w") - half).alias("tool_names"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric deliveries: run = user, case = (user, day)."""
    name = (
        F.when(F.col("event_type") == "click", "faithfulness")
        .when(F.col("event_type") == "view", "answer_relevance")
        .when(F.col("event_type") == "purchase", "tool_selection_precision")
        .when(F.col("event_type") == "signup", "politeness")
    )
    score = F.least(F.lit(1.0), F.lit(0.5) + F.col("value") / F.lit(60.0))
    return (
        table(spark, sf_dir, "events")
        .withColumn("metric", name)
        .filter(F.col("metric").isNotNull())
        .select(*_case_key(), "metric", score.alias("score"), (score >= 0.7).alias("passed"), "ts", "event_id")
    )


def _case_key() -> list:
    day = F.date_format("ts", "yyyy-MM-dd")
    return [F.col("user_id").cast("string").alias("eval_run_id"), F.concat_ws("/", "user_id", day).alias("case_id")]


def score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, day): error text when a costly error event happened."""
    bad = (F.col("event_type") == "error") & (F.col("value") > 150)
    keyed = table(spark, sf_dir, "events").select(*_case_key(), F.when(bad, F.col("event_id")).alias("bad"))
    found = keyed.groupBy("eval_run_id", "case_id").agg(F.max("bad").alias("bad"))
    return found.select("eval_run_id", "case_id", F.concat(F.lit("ToolError: event "), "bad").alias("error"))


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as result deliveries: run = order, case and shard = line number."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("eval_run_id"),
        F.col("l_linenumber").cast("string").alias("case_id"),
        F.col("l_linenumber").cast("bigint").alias("shard_id"),
        "l_shipdate",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
        F.when(F.col("l_returnflag") == "R", "returned").alias("error"),
    )


DELIVERY_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest order of each customer as a run, with its number of lines."""
    from runsieve.operators.ranking import latest_by

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    last = latest_by(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_linestatus") == "F").alias("n_done"))
    )
    n = F.coalesce("n_lines", F.lit(0))
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "pending")
    return last.join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").cast("string").alias("eval_run_id"),
        status.otherwise("pass").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        n.alias("n_results"),
        (n + F.col("o_custkey") % 3 - 1).alias("total_cases"),
        F.coalesce("n_done", F.lit(0)).alias("completed_shards"),
        (n + 1).alias("total_shards"),
        (F.col("o_custkey") % 10 == 0).alias("force"),
        "o_custkey",
    )


def manifest_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dataset-manifest writes keyed by customer."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").cast("string").alias("dataset_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("sha"), "o_orderkey")).otherwise("").alias("git_sha"),
        F.concat(F.lit("s3://golden/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".json")).alias("s3_uri"),
        F.col("o_orderpriority").alias("version"),
        F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("set-"), "o_custkey")).otherwise("").alias("name"),
        (F.col("o_orderkey") % 50).alias("case_count"),
        F.col("o_orderdate").alias("written_at"),
        F.col("o_orderkey").alias("seq"),
    )


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as judge replies in ten textual shapes; one without a label is judged not passed."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    points = F.lpad((F.col("n_chars") % 101).cast("string"), 3, "0")
    number = F.concat(F.substring(points, 1, 1), F.lit("."), F.substring(points, 2, 2))
    flag = F.when(F.col("quality") == 1, "true").otherwise("false")
    body = F.concat(
        F.lit('{"score": '), number, F.lit(', "passed": '), flag, F.lit(', "reasoning": "doc '), F.col("doc_id"),
        F.lit('", "claims": [{"claim": "a", "supported": '), flag, F.lit("}]}"),
    )
    quoted = F.lit('"')
    shapes = [
        body,
        F.concat(F.lit("Let me think.\n```json\n"), body, F.lit("\n```\nDone.")),
        F.concat(F.lit("The verdict is "), body, F.lit(" as asked.")),
        F.concat(F.lit('{"score": '), number, F.lit(',"passed": '), flag, F.lit(',"claims": [1,2,],}')),
        F.concat(F.lit('{"score": "'), number, F.lit('", "passed": '), flag, F.lit("}")),
        F.concat(F.lit('{"score": '), number, F.lit(', "passed": '), quoted, flag, quoted, F.lit("}")),
        F.concat(F.lit('{"score": '), number, F.lit(', "reasoning": null}')),
        F.concat(F.lit('{"score": 1'), number, F.lit(', "passed": '), flag, F.lit("}")),
        F.concat(F.lit("no verdict for document "), F.col("doc_id")),
        F.lit("  \n "),
    ]
    kind = (F.col("doc_id") % 10).cast("int")
    return d.select(
        "doc_id", "quality", "toxic", F.element_at(F.array(*shapes), kind + 1).alias("reply_text")
    )
