"""From case results to per-run numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.functions.arrays import explode_once
from runsieve.functions.numbers import as_exact, exact_ratio, round_exact
from runsieve.functions.text import n_items, or_str
from runsieve.operators.ranking import interpolate, latest_by, materialise, percentile_parts, weighted_ranks
from runsieve.schemas import INPUT_USD_PER_MTOK, METRICS, OUTPUT_USD_PER_MTOK, Thresholds

RUN = "eval_run_id"
CASE_KEY = [RUN, "case_id"]
OUTCOMES = ("#passed", "#failed", "#error")


def latest_results(results: DataFrame, order: list[str]) -> DataFrame:
    """Last delivery of each case; ``order`` is numeric shard, position, path."""
    return latest_by(results, CASE_KEY, order)


def metric_scores(results: DataFrame) -> DataFrame:
    """Long form of the metrics array: one row per metric of a case, with its position."""
    return explode_once(results.select(*CASE_KEY, "metrics"), "metrics", "_m", "metric_pos").select(
        *CASE_KEY, "metric_pos", F.col("_m.name").alias("metric"), F.col("_m.score"), F.col("_m.passed")
    )


def last_copies(metrics: Column) -> Column:
    """Metrics of a case with repeated names reduced to the last copy."""

    def is_last(m: Column, i: Column) -> Column:
        later = F.slice(metrics, i + 2, F.greatest(F.size(metrics), F.lit(1)))
        return ~F.exists(later, lambda o: o["name"] == m["name"])

    return F.filter(metrics, is_last)


def metric_map(scores: DataFrame, order: list[str]) -> DataFrame:
    """Last score of each (case, metric) from a long table of deliveries."""
    return latest_by(scores, [*CASE_KEY, "metric"], order, ["score", "passed"])


def case_passed(error: Column, metrics: Column) -> Column:
    """No error, at least one metric, and every metric passed (repeats included)."""
    all_passed = F.coalesce(F.forall(metrics, lambda m: m["passed"]), F.lit(False))
    return or_str(error).isNull() & (n_items(metrics) > 0) & all_passed


def case_flags(scores: DataFrame, cases: DataFrame) -> DataFrame:
    """Case flags from a long metric table; every delivered copy counts.

    ``cases`` has one row per case with its ``error``.
    """
    per_case = scores.groupBy(*CASE_KEY).agg(
        F.count("*").alias("n_metrics"), F.min(F.col("passed").cast("int")).alias("_all")
    )
    joined = cases.join(per_case, CASE_KEY, "left").withColumn("n_metrics", F.coalesce("n_metrics", F.lit(0)))
    has_error = or_str(F.col("error")).isNotNull()
    return (
        joined.withColumn("has_error", has_error)
        .withColumn("case_passed", ~has_error & (F.col("n_metrics") > 0) & F.coalesce(F.col("_all") == 1, F.lit(False)))
        .drop("_all")
    )


def case_tokens(metrics: Column) -> Column:
    """Struct of the input and output tokens of a case's metrics."""

    def total(field: str) -> Column:
        return F.aggregate(metrics, F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(m[field], F.lit(0)))

    return F.struct(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"))


def run_thresholds(runs: DataFrame) -> DataFrame:
    """One row per run and metric with its threshold, whether or not it has scores."""
    limits = F.col("thresholds")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), limits[m].alias("threshold")) for m in METRICS])
    return runs.select(RUN, F.explode(rows).alias("_t")).select(RUN, "_t.metric", "_t.threshold")


def with_thresholds(runs: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Give runs a ``thresholds`` struct unless they carry one."""
    if "thresholds" in runs.columns:
        return runs
    return runs.withColumn("thresholds", (thresholds or Thresholds()).as_column())


def valid_scores(scores: DataFrame) -> DataFrame:
    """Scores from 0 to 1. Missing, NaN and other values are violations of the score check and have no part
    in counts, means and ranks."""
    return scores.filter(F.col("score").between(0.0, 1.0))


def score_histogram(scores: DataFrame) -> DataFrame:
    """Rows per (run, metric, score): combined on the map side before any shuffle."""
    return valid_scores(scores).groupBy(RUN, "metric", "score").agg(F.count("*").alias("c"))


def metric_aggregates(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Count, mean, p50, p95, min, max, pass rate and flag per run and metric.

    ``scores`` holds one row per (run, case, metric); ``runs`` names the runs that
    must appear and may carry a ``thresholds`` struct. Metrics without a score
    appear with zeros and are flagged. The flag compares the unrounded mean.
    """
    return aggregates_from_histogram(score_histogram(scores.filter(F.col("metric").isin(*METRICS))), runs)


def aggregates_from_histogram(hist: DataFrame, runs: DataFrame) -> DataFrame:
    """``metric_aggregates`` from a score histogram (run, metric, score, c)."""
    limits = run_thresholds(with_thresholds(runs))
    ranked = weighted_ranks(hist, [RUN, "metric"], "score", "c", attach=limits)
    p50, p95 = percentile_parts(0.5, "score", "c"), percentile_parts(0.95, "score", "c")
    counted = F.col("c").cast("decimal(15,0)")
    stats = ranked.groupBy(RUN, "metric").agg(
        F.first("_total").alias("n"),
        F.sum(as_exact(F.col("score")) * counted).alias("_sum"),
        F.min("score").alias("_min"),
        F.max("score").alias("_max"),
        F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("c")).otherwise(0)).alias("_passed"),
        p50[0].alias("_l50"),
        p50[1].alias("_h50"),
        p95[0].alias("_l95"),
        p95[1].alias("_h95"),
    )
    n = F.col("n")
    stats = (
        stats.withColumn("_mean", exact_ratio(F.col("_sum"), n))
        .withColumn("_p50", F.when(F.col("_l50") == F.col("_h50"), F.col("_l50")).otherwise((F.col("_l50") + F.col("_h50")) / 2))
        .withColumn("_p95", interpolate(F.col("_l95"), F.col("_h95"), n, 0.95))
        .withColumn("_rate", F.col("_passed") / n)
    )
    whole = limits.join(stats, [RUN, "metric"], "left")

    def rounded(c: str) -> Column:
        return F.coalesce(round_exact(c), F.lit(0.0))

    return whole.select(
        RUN,
        "metric",
        rounded("_mean").alias("mean"),
        rounded("_p50").alias("p50"),
        rounded("_p95").alias("p95"),
        rounded("_min").alias("min"),
        rounded("_max").alias("max"),
        F.coalesce(n, F.lit(0)).alias("n"),
        rounded("_rate").alias("pass_rate"),
        "threshold",
        F.coalesce(F.col("_mean") < F.col("threshold"), F.lit(True)).alias("gated"),
    )


def metric_percentiles(scores: DataFrame, percentiles: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per run and metric, unrounded."""
    ranked = weighted_ranks(score_histogram(scores), [RUN, "metric"], "score", "c")
    parts = []
    for name, pct in percentiles.items():
        low, high = percentile_parts(pct, "score", "c")
        parts += [low.alias(f"_l_{name}"), high.alias(f"_h_{name}")]
    found = ranked.groupBy(RUN, "metric").agg(F.first("_total").alias("n"), *parts)
    return found.select(
        RUN,
        "metric",
        "n",
        *[
            interpolate(F.col(f"_l_{name}"), F.col(f"_h_{name}"), F.col("n"), pct).alias(name)
            for name, pct in percentiles.items()
        ],
    )


def case_outcome(cases: DataFrame) -> Column:
    """Which of the three outcome facts a case counts as."""
    return F.when(F.col("has_error"), OUTCOMES[2]).when(F.col("case_passed"), OUTCOMES[0]).otherwise(OUTCOMES[1])


def result_facts(results: DataFrame) -> DataFrame:
    """One row per metric of a case (last copy of a name) and one per case outcome.

    Everything a report needs, so that scored cases are read once: (run, metric,
    score, input_tokens, output_tokens); outcome rows carry the tokens.
    """
    none = F.lit(None).cast("bigint")
    metric = F.transform(
        last_copies(F.col("metrics")),
        lambda m: F.struct(
            m["name"].alias("metric"), m["score"].alias("score"), none.alias("input_tokens"), none.alias("output_tokens")
        ),
    )
    outcome = F.struct(
        case_outcome(results).alias("metric"),
        F.lit(None).cast("double").alias("score"),
        F.col("input_tokens").cast("bigint").alias("input_tokens"),
        F.col("output_tokens").cast("bigint").alias("output_tokens"),
    )
    facts = F.concat(F.coalesce(metric, F.array()), F.array(outcome))
    return explode_once(results.select(RUN, facts.alias("_facts")), "_facts", "_f").select(RUN, "_f.*")


def outcome_facts(cases: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Outcome facts alone, from a table of case flags; ``keep`` names further columns to carry."""
    tokens = [
        (F.col(c).cast("bigint") if c in cases.columns else F.lit(0).cast("bigint")).alias(c)
        for c in ("input_tokens", "output_tokens")
    ]
    return cases.select(RUN, *keep, case_outcome(cases).alias("metric"), F.lit(None).cast("double").alias("score"), *tokens)


def long_facts(scores: DataFrame, cases: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same facts from a long score table and a table of case flags; ``keep`` names columns of both to carry."""
    none = F.lit(None).cast("bigint")
    metrics = valid_scores(scores).select(RUN, *keep, "metric", "score", none.alias("input_tokens"), none.alias("output_tokens"))
    return metrics.unionByName(outcome_facts(cases, keep))


def fact_histogram(facts: DataFrame) -> DataFrame:
    """Facts counted per (run, metric, score), stored so that later steps reread it."""
    counted = facts.groupBy(RUN, "metric", "score").agg(
        F.count("*").alias("c"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    return materialise(counted)


def run_case_counts(hist: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Completed, passed, failed and error cases and token sums of every run.

    Runs of ``runs`` without a result are kept with zeros; without ``runs`` the
    runs are those with results and ``total_cases`` is their case count.
    """

    def cases(*kinds: str) -> Column:
        return F.sum(F.when(F.col("metric").isin(*kinds), F.col("c")).otherwise(0))

    counts = hist.groupBy(RUN).agg(
        cases(*OUTCOMES).alias("completed_cases"),
        cases(OUTCOMES[0]).alias("passed_cases"),
        cases(OUTCOMES[1]).alias("failed_cases"),
        cases(OUTCOMES[2]).alias("error_cases"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    if runs is None:
        return counts.withColumn("total_cases", F.col("completed_cases"))
    names = [c for c in counts.columns if c != RUN]
    return runs.join(counts, RUN, "left").fillna(0, subset=names)


def with_rates(counts: DataFrame) -> DataFrame:
    """Add unrounded pass_rate and error_rate; needs total_cases."""
    done = F.col("completed_cases")
    return counts.withColumn(
        "pass_rate", F.when(done > 0, F.col("passed_cases") / F.nullif(done, F.lit(0))).otherwise(0.0)
    ).withColumn(
        "error_rate",
        F.when(done > 0, F.col("error_cases") / F.nullif(done, F.lit(0)))
        .when(F.coalesce(F.col("total_cases"), F.lit(0)) != 0, 1.0)
        .otherwise(0.0),
    )


def overall_scores(aggregates: DataFrame) -> DataFrame:
    """Mean of the rounded metric means of a run, rounded again; 0.0 without any.

    Also packs the aggregates into ``metrics`` in fixed order (three per run).
    """
    order = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric"))
    packed = F.struct(
        order.alias("o"), "metric", "mean", "p50", "p95", "min", "max", "n", "pass_rate", "threshold", "gated"
    )
    scored = F.when(F.col("n") > 0, as_exact(F.col("mean")))
    grouped = aggregates.groupBy(RUN).agg(
        F.sum(scored).alias("_sum"), F.count(scored).alias("_n"), F.array_sort(F.collect_list(packed)).alias("metrics")
    )
    return (
        grouped.withColumn("_mean", exact_ratio(F.col("_sum"), F.col("_n")))
        .withColumn("overall_score", F.coalesce(round_exact("_mean"), F.lit(0.0)))
        .drop("_sum", "_n", "_mean")
    )


def with_cost(
    df: DataFrame, input_usd: float = INPUT_USD_PER_MTOK, output_usd: float = OUTPUT_USD_PER_MTOK
) -> DataFrame:
    """Add ``estimated_cost_usd`` (6 digits) from summed token counts."""
    raw = F.col("input_tokens") / F.lit(1e6) * F.lit(input_usd) + F.col("output_tokens") / F.lit(1e6) * F.lit(output_usd)
    return df.withColumn("_cost", raw).withColumn("estimated_cost_usd", round_exact("_cost", 6)).drop("_cost")
