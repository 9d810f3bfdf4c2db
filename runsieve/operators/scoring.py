"""Deterministic scorers: context overlap, relevance, tool selection.

Each step that is used several times later is its own projection, so that it is
computed once per row; all steps run in one stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsieve.functions.numbers import fixed_sql, round_exact_sql
from runsieve.functions.text import quoted_list_sql, strip_sql, stripped_names_sql, ws_tokens_sql
from runsieve.schemas import METRICS, PASS_CUTOFF

_PROBE = 80  # fixed value: characters compared when looking for a passage in an answer

_NO_TEXTS = "cast(array() AS array<string>)"
_SAME = f"coalesce(expected_answer <> '' AND {strip_sql('expected_answer')} = {strip_sql('answer')}, false)"


def _add(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def context_overlap(df: DataFrame, contexts: str, answer: str, out: str = "score") -> DataFrame:
    """Lexical support of ``answer`` by ``contexts``, added as ``out``.

    A passage hits when its first 80 characters occur in the answer or the
    answer's first 80 occur in it. The empty string occurs in every string, so an
    empty answer with any context scores 1.0; ``empty_answer`` flags those rows.
    With hits the score is 0.6 + 0.4 * share, unrounded; without, it is the
    share of answer tokens found in the contexts.
    """
    hit = f"contains(_a, substring(c, 1, {_PROBE})) OR contains(c, substring(_a, 1, {_PROBE}))"
    low = _add(df, _a=f"lower({answer})", _c=f"transform({contexts}, c -> lower(c))")
    low = _add(
        low,
        _hits=f"size(filter(_c, c -> {hit}))",
        _at=ws_tokens_sql("_a"),
        _ct=ws_tokens_sql("array_join(_c, ' ')"),
    )
    low = _add(low, _share="try_divide(size(array_intersect(_at, _ct)), size(_at))")
    scored = _add(
        low,
        empty_answer=f"{answer} = ''",
        **{
            out: f"""
            CASE WHEN coalesce(size(_c), 0) = 0 THEN CASE WHEN {strip_sql(answer)} <> '' THEN 1D ELSE 0D END
                 WHEN _hits > 0 THEN least(1D, 0.6D + 0.4D * _hits / size(_c))
                 WHEN size(_at) = 0 OR size(_ct) = 0 THEN 0D
                 ELSE {round_exact_sql("_share")} END"""
        },
    )
    return scored.drop("_a", "_c", "_hits", "_at", "_ct", "_share")


def faithfulness(df: DataFrame) -> DataFrame:
    """Add ``faithfulness``: 1.0 on the expected answer, else context overlap."""
    chosen = f"CASE WHEN size(retrieved_contexts) > 0 THEN retrieved_contexts ELSE coalesce(expected_contexts, {_NO_TEXTS}) END"
    scored = context_overlap(_add(df, _contexts=chosen), "_contexts", "answer", "_overlap")
    return _add(scored, faithfulness=f"CASE WHEN {_SAME} THEN 1D ELSE _overlap END").drop("_contexts", "_overlap")


def answer_relevance(df: DataFrame) -> DataFrame:
    """Add ``answer_relevance`` from token overlap with query and expectation."""
    tokens = _add(
        df, _q=ws_tokens_sql("query"), _t=ws_tokens_sql("answer"), _e=ws_tokens_sql("coalesce(expected_answer, '')")
    )
    shares = _add(
        tokens,
        _on_query="least(1D, try_divide(2 * size(array_intersect(_q, _t)), size(_q)))",
        _on_expected="size(array_intersect(_t, _e)) / greatest(size(_e), 1)",
    )
    rounded = _add(shares, _on_query=round_exact_sql("_on_query"), _on_expected=round_exact_sql("_on_expected"))
    return _add(
        rounded,
        answer_relevance=f"""
        CASE WHEN {_SAME} THEN 1D WHEN size(_q) = 0 OR size(_t) = 0 THEN 0D
             WHEN expected_answer <> '' THEN greatest(_on_query, _on_expected) ELSE _on_query END""",
    ).drop("_q", "_t", "_e", "_on_query", "_on_expected")


def _ratios(df: DataFrame, expected: str, actual: str, both: str) -> DataFrame:
    """Add _p, _r and _f (F1) from three set sizes, with the empty-set rules."""
    ratios = _add(
        df,
        _p=f"CASE WHEN {expected} = 0 AND {actual} = 0 THEN 1D WHEN {expected} = 0 OR {actual} = 0 THEN 0D ELSE {both} / {actual} END",
        _r=f"CASE WHEN {expected} = 0 THEN 1D WHEN {actual} = 0 THEN 0D ELSE {both} / {expected} END",
    )
    return _add(ratios, _f="CASE WHEN _p + _r = 0 THEN 0D ELSE 2 * _p * _r / (_p + _r) END")


_ROUNDED = {"tool_precision": round_exact_sql("_p"), "tool_recall": round_exact_sql("_r"), "tool_f1": round_exact_sql("_f")}


def tool_selection(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Score tool names held as arrays in the row.

    Adds ``tool_expected`` / ``tool_actual`` (stripped, repeats kept),
    ``tool_precision`` / ``tool_recall`` / ``tool_f1`` rounded to 4,
    ``tool_selection_precision`` (the score), ``tool_reasoning`` and ``tool_thought``.
    """
    sets = _add(
        df,
        tool_expected=stripped_names_sql(f"coalesce({expected}, {_NO_TEXTS})"),
        tool_actual=stripped_names_sql(f"coalesce({actual}, {_NO_TEXTS})"),
    )
    sets = _add(sets, _es="array_sort(array_distinct(tool_expected))", _as="array_sort(array_distinct(tool_actual))")
    sets = _add(
        sets,
        _both="array_intersect(_es, _as)",
        _extra="array_except(_as, _es)",
        _missing="array_except(_es, _as)",
    )
    scored = _ratios(sets, "size(_es)", "size(_as)", "size(_both)")
    reasoning = f"""
        CASE WHEN size(_es) = 0 AND size(_as) = 0 THEN 'no tool was expected or called'
             WHEN size(_as) = 0 THEN 'no tool was called; expected ' || {quoted_list_sql("_es")}
             WHEN size(_es) = 0 THEN 'no tool was expected; called ' || {quoted_list_sql("_as")}
             ELSE concat_ws('; ', 'shared=' || {quoted_list_sql("_both")},
                            CASE WHEN size(_extra) > 0 THEN 'extra=' || {quoted_list_sql("_extra")} END,
                            CASE WHEN size(_missing) > 0 THEN 'not_called=' || {quoted_list_sql("_missing")} END) END"""
    return _add(
        scored,
        **_ROUNDED,
        tool_selection_precision=_ROUNDED["tool_precision"],
        tool_reasoning=reasoning,
        tool_thought=f"concat('recall=', {fixed_sql('_r', 3)}, ' f1=', {fixed_sql('_f', 3)})",
    ).drop("_es", "_as", "_both", "_extra", "_missing", "_p", "_r", "_f")


def tool_selection_from_log(expected: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """The same scores from long tables of (keys, tool), one row per name.

    Names collapse to one row per (case, tool) on the map side and only three
    counters per case are shuffled on, so a case with a huge call log is safe.
    """
    expected = expected.select(*keys, "tool", F.lit(1).alias("_e"), F.lit(0).alias("_a"))
    calls = calls.select(*keys, "tool", F.lit(0).alias("_e"), F.lit(1).alias("_a"))
    named = _add(expected.unionByName(calls), tool=strip_sql("tool")).filter("tool <> ''")
    per_tool = named.groupBy(*keys, "tool").agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
    sizes = per_tool.groupBy(*keys).agg(
        F.sum("_e").alias("n_expected"), F.sum("_a").alias("n_actual"), F.expr("sum(_e * _a)").alias("n_both")
    )
    return _add(_ratios(sizes, "n_expected", "n_actual", "n_both"), **_ROUNDED).drop("_p", "_r", "_f")


def score_traces(df: DataFrame) -> DataFrame:
    """Add the three heuristic scores to rows holding a case and its trace.

    Needs query, answer, expected_answer, expected_contexts, retrieved_contexts,
    expected_tools and tool_names. One narrow stage: no shuffle.
    """
    return tool_selection(answer_relevance(faithfulness(df)), "expected_tools", "tool_names")


def metric_array(df: DataFrame, out: str = "metrics") -> DataFrame:
    """Pack the three scores into an array of metric structs in fixed order."""
    texts = {
        METRICS[0]: ("'share of the answer found in its contexts'", "'lexical scorer'"),
        METRICS[1]: ("'tokens shared with the query or the expected answer'", "'lexical scorer'"),
        METRICS[2]: ("tool_reasoning", "tool_thought"),
    }
    items = [
        f"named_struct('name', '{name}', 'score', {name}, 'passed', {name} >= {PASS_CUTOFF}D, 'reasoning', {reasoning}, "
        f"'chain_of_thought', {thought}, 'input_tokens', 0L, 'output_tokens', 0L)"
        for name, (reasoning, thought) in texts.items()
    ]
    return _add(df, **{out: f"array({', '.join(items)})"})
