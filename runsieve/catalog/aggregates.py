"""Queries on metric aggregates, run rates, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsieve.catalog import views as V
from runsieve.catalog.registry import query
from runsieve.catalog.sql import exact_mean, exact_units, fixed, percent, rnd, with_views
from runsieve.functions.numbers import fixed_sql
from runsieve.operators import aggregate as agg
from runsieve.operators import reports as rep
from runsieve.operators import runs as run_ops
from runsieve.plans.evaluate import build_reports, evaluate_dataset

RUN = "eval_run_id"
_NAMES = "['faithfulness', 'answer_relevance', 'tool_selection_precision']"


def aggregate_steps(scores: str, runs: str, rates: str | None = None) -> dict[str, str]:
    """CTEs from a score view and a run list to aggregates, counts and gates.

    ``scores`` has eval_run_id, metric, score; ``runs`` eval_run_id, total_cases,
    timed_out; ``rates`` completed, passed, failed, error cases and tokens.
    """
    at = "(n - 1) * 0.95::DOUBLE"
    steps = {
        "wanted": f"SELECT r.eval_run_id, m.metric FROM {runs} r, (SELECT unnest({_NAMES}) AS metric) m",
        "ordered": f"""
            SELECT eval_run_id, metric, score, row_number() OVER (PARTITION BY eval_run_id, metric ORDER BY score) - 1 AS i,
                   count(*) OVER (PARTITION BY eval_run_id, metric) AS n FROM {scores}""",
        "stats": f"""
            SELECT eval_run_id, metric, max(n) AS n, sum({exact_units('score')}) AS units, min(score) AS lo, max(score) AS hi,
                   count(*) FILTER (score >= 0.85::DOUBLE) / max(n)::DOUBLE AS rate,
                   max(score) FILTER (i = (n - 1) // 2) AS m1, max(score) FILTER (i = n // 2) AS m2,
                   max(score) FILTER (i = floor({at})) AS q1, max(score) FILTER (i = ceil({at})) AS q2
            FROM ordered GROUP BY 1, 2""",
        "means": f"""
            SELECT *, {exact_mean('units', 'n')} AS avg, CASE WHEN m1 = m2 THEN m1 ELSE (m1 + m2) / 2 END AS med,
                   CASE WHEN floor({at}) = ceil({at}) THEN q1
                        ELSE q1 * (1.0::DOUBLE - ({at} - floor({at}))) + q2 * ({at} - floor({at})) END AS q95
            FROM stats""",
        "aggs": f"""
            SELECT w.eval_run_id, w.metric, coalesce({rnd('avg')}, 0.0) AS mean, coalesce({rnd('med')}, 0.0) AS p50,
                   coalesce({rnd('q95')}, 0.0) AS p95, coalesce({rnd('lo')}, 0.0) AS "min", coalesce({rnd('hi')}, 0.0) AS "max",
                   coalesce(n, 0) AS n, coalesce({rnd('rate')}, 0.0) AS pass_rate, 0.85::DOUBLE AS threshold,
                   coalesce(avg < 0.85::DOUBLE, true) AS gated
            FROM wanted w LEFT JOIN means s ON s.eval_run_id = w.eval_run_id AND s.metric = w.metric""",
        "sums": f"""
            SELECT eval_run_id, sum({exact_units('mean')}) FILTER (n > 0) AS units, count(*) FILTER (n > 0) AS k
            FROM aggs GROUP BY 1""",
        "avgs": f"SELECT eval_run_id, CASE WHEN k > 0 THEN {exact_mean('units', 'greatest(k, 1)')} END AS avg FROM sums",
        "overall": f"SELECT eval_run_id, coalesce({rnd('avg')}, 0.0::DOUBLE) AS overall_score FROM avgs",
    }
    if rates is not None:
        steps["rates"] = f"""
            SELECT r.eval_run_id, r.total_cases, r.timed_out, coalesce(completed_cases, 0) AS completed_cases,
                   coalesce(passed_cases, 0) AS passed_cases, coalesce(failed_cases, 0) AS failed_cases,
                   coalesce(error_cases, 0) AS error_cases,
                   CASE WHEN completed_cases > 0 THEN passed_cases / completed_cases::DOUBLE ELSE 0.0::DOUBLE END AS raw_pass,
                   CASE WHEN completed_cases > 0 THEN error_cases / completed_cases::DOUBLE
                        WHEN r.total_cases <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS raw_error
            FROM {runs} r LEFT JOIN {rates} c ON c.eval_run_id = r.eval_run_id"""
        steps["gated"] = f"""
            SELECT *, list_filter([
                     CASE WHEN timed_out THEN 'timed out with ' || completed_cases || ' of ' || total_cases || ' cases done' END,
                     CASE WHEN completed_cases = 0 THEN 'no case has a result' END,
                     CASE WHEN raw_error > 0.05::DOUBLE THEN 'error rate ' || {percent('raw_error', 2)} || ' is above 5.00%' END,
                     CASE WHEN overall_score < 0.85::DOUBLE
                          THEN 'overall score ' || {fixed('overall_score', 3)} || ' is below 0.850' END],
                     lambda x: x IS NOT NULL) AS failures
            FROM rates JOIN overall USING (eval_run_id)"""
        steps["decided"] = f"""
            SELECT *, CASE WHEN timed_out AND completed_cases = 0 THEN 'timeout' WHEN len(failures) > 0 THEN 'fail' ELSE 'pass' END AS status,
                   len(failures) = 0 AS gate_passed, {rnd('raw_pass')} AS pass_rate, {rnd('raw_error')} AS error_rate
            FROM gated"""
    return steps


_EVENT_RUNS = {
    "x_counts": """
        SELECT eval_run_id, count(*) AS completed_cases, count(*) FILTER (case_passed) AS passed_cases,
               count(*) FILTER (NOT case_passed AND NOT has_error) AS failed_cases, count(*) FILTER (has_error) AS error_cases
        FROM v_case_flags GROUP BY 1""",
    "x_runs": """
        SELECT CAST(c_custkey AS VARCHAR) AS eval_run_id, 30::BIGINT AS total_cases, c_custkey % 4 = 0 AS timed_out
        FROM customer""",
}


def _event_runs(spark, sf):
    """Every customer is a run of 30 cases; only some have events."""
    key = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(
        key.cast("string").alias(RUN), F.lit(30).cast("bigint").alias("total_cases"), (key % 4 == 0).alias("timed_out")
    )


def _event_flags(spark, sf):
    return agg.case_flags(V.scores(spark, sf), V.score_cases(spark, sf))


def _event_scores(spark, sf):
    return agg.metric_map(V.scores(spark, sf), ["ts", "event_id"])


def _event_reports(spark, sf):
    facts = agg.long_facts(_event_scores(spark, sf), _event_flags(spark, sf))
    return build_reports(facts, _event_runs(spark, sf)).withColumn("judge_model_id", F.lit("judge-a"))


@query(
    "metric_map_last",
    with_views(["v_last_scores"], "SELECT eval_run_id, case_id, metric, score, passed FROM v_last_scores"),
)
def metric_map_last(spark, sf):
    return _event_scores(spark, sf)


@query(
    "case_passed",
    with_views(["v_case_flags"], "SELECT eval_run_id, case_id, n_metrics, has_error, case_passed FROM v_case_flags"),
)
def case_passed(spark, sf):
    return _event_flags(spark, sf).select(RUN, "case_id", "n_metrics", "has_error", "case_passed")


@query(
    "metric_aggregates",
    with_views(
        ["v_last_scores"],
        'SELECT eval_run_id, metric, mean, p50, p95, "min", "max", n, pass_rate, threshold, gated FROM aggs',
        {"x_runs": _EVENT_RUNS["x_runs"], **aggregate_steps("v_last_scores", "x_runs")},
    ),
)
def metric_aggregates(spark, sf):
    return agg.metric_aggregates(_event_scores(spark, sf), _event_runs(spark, sf))


@query(
    "metric_percentiles",
    with_views(
        ["v_scores"],
        """SELECT eval_run_id, metric, n, CASE WHEN n % 2 = 1 THEN m1 ELSE m1 * (1.0::DOUBLE - 0.5::DOUBLE) + m2 * 0.5::DOUBLE END AS p50,
                  CASE WHEN floor(at95) = ceil(at95) THEN q1 ELSE q1 * (1.0::DOUBLE - (at95 - floor(at95))) + q2 * (at95 - floor(at95)) END AS p95
           FROM (SELECT eval_run_id, metric, max(n) AS n, max((n - 1) * 0.95::DOUBLE) AS at95,
                        max(score) FILTER (i = (n - 1) // 2) AS m1, max(score) FILTER (i = n // 2) AS m2,
                        max(score) FILTER (i = floor((n - 1) * 0.95::DOUBLE)) AS q1, max(score) FILTER (i = ceil((n - 1) * 0.95::DOUBLE)) AS q2
                 FROM (SELECT *, row_number() OVER (PARTITION BY eval_run_id, metric ORDER BY score) - 1 AS i,
                              count(*) OVER (PARTITION BY eval_run_id, metric) AS n FROM v_scores) GROUP BY 1, 2)""",
    ),
)
def metric_percentiles(spark, sf):
    return agg.metric_percentiles(V.scores(spark, sf), {"p50": 0.5, "p95": 0.95})


_STEPS = {**_EVENT_RUNS, **aggregate_steps("v_last_scores", "x_runs", "x_counts")}
_VIEWS = ["v_last_scores", "v_case_flags"]


@query(
    "run_case_counts",
    with_views(
        _VIEWS,
        """SELECT eval_run_id, total_cases, completed_cases, passed_cases, failed_cases, error_cases FROM rates""",
        _STEPS,
    ),
)
def run_case_counts(spark, sf):
    hist = agg.fact_histogram(agg.outcome_facts(_event_flags(spark, sf)))
    counts = agg.run_case_counts(hist, _event_runs(spark, sf))
    return counts.select(RUN, "total_cases", "completed_cases", "passed_cases", "failed_cases", "error_cases")


@query(
    "run_rates",
    with_views(_VIEWS, "SELECT eval_run_id, raw_pass AS pass_rate, raw_error AS error_rate FROM rates", _STEPS),
)
def run_rates(spark, sf):
    hist = agg.fact_histogram(agg.outcome_facts(_event_flags(spark, sf)))
    counts = agg.run_case_counts(hist, _event_runs(spark, sf))
    return agg.with_rates(counts).select(RUN, "pass_rate", "error_rate")


@query("overall_score", with_views(_VIEWS, "SELECT eval_run_id, overall_score FROM overall", _STEPS))
def overall_score(spark, sf):
    aggregates = agg.metric_aggregates(_event_scores(spark, sf), _event_runs(spark, sf))
    return agg.overall_scores(aggregates).select(RUN, "overall_score")


_FAILURES = "array_to_string(failures, '; ') AS failures"


@query(
    "gate_decision",
    with_views(_VIEWS, f"SELECT eval_run_id, status, gate_passed, {_FAILURES} FROM decided", _STEPS),
)
def gate_decision(spark, sf):
    report = _event_reports(spark, sf)
    return report.select(RUN, "status", "gate_passed", F.array_join("failures", "; ").alias("failures"))


_METRIC_CELLS = ", ".join(
    ["m.metric", fixed_sql("m.mean", 4), fixed_sql("m.p50", 4), fixed_sql("m.p95", 4), "m.n", fixed_sql("m.pass_rate", 4)]
)
_METRIC_LINE = f"array_join(transform(metrics, m -> concat_ws(':', {_METRIC_CELLS})), ',')"
_METRIC_TEXT = f"""
    SELECT eval_run_id, string_agg(metric || ':' || {fixed('mean', 4)} || ':' || {fixed('p50', 4)} || ':' || {fixed('p95', 4)} || ':' || n || ':' ||
           {fixed('pass_rate', 4)}, ',' ORDER BY list_position({_NAMES}, metric)) AS metrics,
           max(mean) FILTER (metric = 'answer_relevance') AS relevance_mean
    FROM aggs GROUP BY 1"""


def report_columns(reports):
    """Reports with their metrics as one line and the mean of answer relevance."""
    report = rep.pick_metric(reports, "answer_relevance", "mean", "relevance_mean")
    return report.select(
        RUN, "status", "gate_passed", F.array_join("failures", "; ").alias("failures"), "overall_score", "total_cases",
        "completed_cases", "passed_cases", "failed_cases", "error_cases", "pass_rate", "error_rate",
        F.expr(_METRIC_LINE).alias("metrics"), "relevance_mean",
    )


@query(
    "run_report",
    with_views(
        _VIEWS,
        f"""SELECT eval_run_id, status, gate_passed, {_FAILURES}, overall_score, total_cases, completed_cases, passed_cases,
                   failed_cases, error_cases, pass_rate, error_rate, metrics, relevance_mean
            FROM decided JOIN texts USING (eval_run_id)""",
        {**_STEPS, "texts": _METRIC_TEXT},
    ),
)
def run_report(spark, sf):
    return report_columns(_event_reports(spark, sf))


_DATASET = {
    "d_scores": f"""
        SELECT eval_run_id, unnest({_NAMES}) AS metric, unnest([faithfulness, answer_relevance, tool_selection_precision]) AS score
        FROM v_metrics""",
    "d_counts": """
        SELECT eval_run_id, count(*) AS completed_cases,
               count(*) FILTER (least(faithfulness, answer_relevance, tool_selection_precision) >= 0.85::DOUBLE) AS passed_cases,
               count(*) FILTER (least(faithfulness, answer_relevance, tool_selection_precision) < 0.85::DOUBLE) AS failed_cases,
               0::BIGINT AS error_cases FROM v_metrics GROUP BY 1""",
    "d_runs": "SELECT eval_run_id, completed_cases AS total_cases, false AS timed_out FROM d_counts",
    **aggregate_steps("d_scores", "d_runs", "d_counts"),
    "texts": _METRIC_TEXT,
}


@query(
    "evaluate_dataset",
    with_views(
        ["v_metrics"],
        f"""SELECT eval_run_id, status, gate_passed, {_FAILURES}, overall_score, total_cases, completed_cases, passed_cases,
                   failed_cases, error_cases, pass_rate, error_rate, metrics
            FROM decided JOIN texts USING (eval_run_id)""",
        _DATASET,
    ),
)
def evaluate_dataset_query(spark, sf):
    return evaluate_dataset(V.cases(spark, sf)).select(
        RUN, "status", "gate_passed", F.array_join("failures", "; ").alias("failures"), "overall_score", "total_cases",
        "completed_cases", "passed_cases", "failed_cases", "error_cases", "pass_rate", "error_rate", F.expr(_METRIC_LINE).alias("metrics"),
    )


_COST = f"""
    SELECT eval_run_id, input_tokens, output_tokens, {rnd('raw', 6)} AS estimated_cost_usd FROM (
      SELECT *, input_tokens / 1e6::DOUBLE * 0.8::DOUBLE + output_tokens / 1e6::DOUBLE * 4.0::DOUBLE AS raw FROM (
        SELECT CAST(l_orderkey AS VARCHAR) AS eval_run_id, CAST(sum(CAST(l_quantity * 100 AS BIGINT)) AS BIGINT) AS input_tokens,
               CAST(sum(l_linenumber * 50) AS BIGINT) AS output_tokens FROM lineitem GROUP BY 1))"""


@query("cost_per_run", _COST)
def cost_per_run(spark, sf):
    usage = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias(RUN)).agg(
        F.sum((F.col("l_quantity") * 100).cast("bigint")).alias("input_tokens"),
        F.sum(F.col("l_linenumber").cast("bigint") * 50).alias("output_tokens"),
    )
    return agg.with_cost(usage)


@query(
    "case_tokens",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity * 100 AS BIGINT) + l_linenumber * 7 AS input_tokens,
              CAST(l_linenumber * 50 AS BIGINT) AS output_tokens FROM lineitem""",
)
def case_tokens(spark, sf):
    q, n = (F.col("l_quantity") * 100).cast("bigint"), F.col("l_linenumber").cast("bigint")
    metric = F.struct(q.alias("input_tokens"), (n * 50).alias("output_tokens"))
    second = F.struct((n * 7).alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"))
    totals = agg.case_tokens(F.col("m"))
    rows = V.table(spark, sf, "lineitem").withColumn("m", F.array(metric, second)).withColumn("t", totals)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t.input_tokens", "t.output_tokens")


@query(
    "gate_metrics_long",
    with_views(
        _VIEWS,
        """SELECT eval_run_id, 'test' AS environment, git_sha, metric_name, value FROM (
             SELECT eval_run_id, CASE WHEN CAST(eval_run_id AS BIGINT) % 3 = 0 THEN 'unknown'
                                 ELSE substr(sha256(eval_run_id), 1, 40) END AS git_sha,
                    unnest(['OverallScore', 'PassRate', 'ErrorRate', 'GatePass']) AS metric_name,
                    unnest([overall_score, pass_rate, error_rate, CASE WHEN gate_passed THEN 1.0 ELSE 0.0 END]) AS value FROM decided
             UNION ALL
             SELECT eval_run_id, CASE WHEN CAST(eval_run_id AS BIGINT) % 3 = 0 THEN 'unknown'
                                 ELSE substr(sha256(eval_run_id), 1, 40) END,
                    CASE metric WHEN 'faithfulness' THEN 'Faithfulness' WHEN 'answer_relevance' THEN 'AnswerRelevance' ELSE 'ToolPrecision' END,
                    mean FROM aggs)""",
        _STEPS,
    ),
)
def gate_metrics_long(spark, sf):
    sha = F.when(F.col(RUN).cast("bigint") % 3 != 0, F.sha2(RUN, 256)).otherwise(F.lit(""))
    return rep.gate_metrics_long(_event_reports(spark, sf), "test", sha)


_TITLE = f"""'Evaluation ' || CASE WHEN gate_passed THEN 'passed' ELSE 'failed' END || ': overall ' || {fixed('overall_score', 3)}
             || ' against 0.85 in ' || eval_run_id"""


@query("report_titles", with_views(_VIEWS, f"SELECT eval_run_id, {_TITLE} AS title FROM decided", _STEPS))
def report_titles(spark, sf):
    return rep.titles(_event_reports(spark, sf)).select(RUN, "title")


_NL = "chr(10)"
_MARKDOWN = {
    "rows_md": f"""
        SELECT eval_run_id, string_agg('| ' || metric || ' | ' || {fixed('mean', 3)} || ' | ' || {fixed('p50', 3)} || ' | ' || {fixed('p95', 3)}
               || ' | 0.85 | ' || {percent('pass_rate')} || ' | ' || CASE WHEN NOT gated AND n > 0 THEN 'ok' ELSE 'below' END || ' |',
               {_NL} ORDER BY list_position({_NAMES}, metric)) AS lines
        FROM aggs GROUP BY 1""",
    "marked": f"""
        SELECT *, array_to_string(list_concat([
            '# Evaluation ' || CASE WHEN gate_passed THEN 'PASS' ELSE 'FAIL' END, '',
            '* overall score ' || {fixed('overall_score', 3)} || ', needed 0.85', '* run ' || eval_run_id, '* judge judge-a',
            '* cases passed ' || passed_cases || ' of ' || completed_cases || ' (' || {percent('pass_rate')} || '), errors ' || {percent('error_rate')},
            '* estimated cost USD 0.0000', '', '| metric | mean | p50 | p95 | threshold | pass rate | flag |', '|---|---|---|---|---|---|---|', lines],
            CASE WHEN len(failures) > 0 THEN list_concat(['', 'Reasons:'], list_transform(failures, lambda f: '* ' || f)) ELSE CAST([] AS VARCHAR[]) END),
            {_NL}) AS markdown
        FROM decided JOIN rows_md USING (eval_run_id)""",
}


@query(
    "markdown_reports",
    with_views(_VIEWS, "SELECT eval_run_id, markdown FROM marked", {**_STEPS, **_MARKDOWN}),
)
def markdown_reports(spark, sf):
    return rep.markdown(_event_reports(spark, sf)).select(RUN, "markdown")


_KEY = "CAST(eval_run_id AS BIGINT)"


@query(
    "notification_outbox",
    with_views(
        _VIEWS,
        f"""SELECT eval_run_id, chat_skip_reason,
                   CASE WHEN chat_skip_reason IS NULL THEN 'Evaluation FAILED for ' || coalesce(repo, 'repo') || ' at ' || coalesce(sha, '-')
                        || ': overall ' || {fixed('overall_score', 3)} || ', needed 0.85' || {_NL}
                        || array_to_string(list_transform(failures[1:8], lambda f: '- ' || f), {_NL}) END AS chat_text,
                   CASE WHEN chat_skip_reason IS NULL THEN substr(markdown, 1, 2500) END AS chat_block,
                   CASE WHEN repo IS NULL OR sha IS NULL THEN 'missing_credentials_or_context' END AS check_skip_reason,
                   CASE WHEN repo IS NOT NULL AND sha IS NOT NULL THEN CASE WHEN gate_passed THEN 'success' ELSE 'failure' END END AS check_conclusion,
                   CASE WHEN repo IS NOT NULL AND sha IS NOT NULL THEN {_TITLE} END AS check_title,
                   CASE WHEN repo IS NOT NULL AND sha IS NOT NULL THEN markdown END AS check_summary,
                   CASE WHEN repo IS NOT NULL AND sha IS NOT NULL AND pr <> 0 THEN markdown END AS comment_body,
                   repo, sha AS git_sha, pr AS pr_number
            FROM (SELECT *, CASE WHEN gate_passed THEN 'gate_passed' WHEN {_KEY} % 5 = 0 THEN 'missing_webhook' END AS chat_skip_reason,
                         CASE WHEN {_KEY} % 7 <> 0 THEN 'acme/agent' END AS repo, CASE WHEN {_KEY} % 3 <> 0 THEN 'sha' || eval_run_id END AS sha,
                         {_KEY} % 4 AS pr FROM marked)""",
        {**_STEPS, **_MARKDOWN},
    ),
)
def notification_outbox(spark, sf):
    key = F.col(RUN).cast("bigint")
    return rep.notification_outbox(
        _event_reports(spark, sf),
        repo=F.when(key % 7 != 0, "acme/agent").otherwise(""),
        git_sha=F.when(key % 3 != 0, F.concat(F.lit("sha"), RUN)),
        pr_number=key % 4,
        has_webhook=key % 5 != 0,
        has_token=F.lit(True),
    )


@query(
    "batch_run_ids",
    "SELECT DISTINCT CAST(user_id AS VARCHAR) AS eval_run_id FROM events WHERE event_type <> 'error'",
)
def batch_run_ids(spark, sf):
    run = F.when(F.col("event_type") != "error", F.col("user_id").cast("string"))
    return run_ops.run_ids(V.table(spark, sf, "events").select(run.alias(RUN)))
