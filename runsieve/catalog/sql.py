"""SQL text shared by the oracle statements.

The statements state the expected results on their own; the views mirror the
rules of FIXTURES.md, and the rounding text mirrors ``functions.numbers``.
"""

from __future__ import annotations

from collections.abc import Iterable


def scaled(x: str, digits: int) -> str:
    """Half-to-even integer of ``x * 10**digits`` on the exact binary value."""
    s = f"{2 * 10**digits}::DOUBLE"
    p = f"({x} * {s})"
    high = f"({x} * 134217729::DOUBLE - ({x} * 134217729::DOUBLE - {x}))"
    e = f"(({high} * {s} - {p}) + ({x} - {high}) * {s})"
    k = f"floor({p} / 2)"
    q = f"({p} - {k} * 2 - 1)"
    return f"({k} + CASE WHEN {q} > -{e} OR ({q} = -{e} AND {k} - floor({k} / 2) * 2 = 1) THEN 1 ELSE 0 END)"


def rnd(x: str, digits: int = 4) -> str:
    return f"({scaled(x, digits)} / {10**digits}::DOUBLE)"


def fixed(x: str, digits: int) -> str:
    k = f"CAST({scaled(x, digits)} AS BIGINT)"
    if digits == 0:
        return f"CAST({k} AS VARCHAR)"
    unit = 10**digits
    return f"(CAST({k} // {unit} AS VARCHAR) || '.' || lpad(CAST({k} % {unit} AS VARCHAR), {digits}, '0'))"


def percent(x: str, digits: int = 0) -> str:
    return f"({fixed(f'({x} * 100.0::DOUBLE)', digits)} || '%')"


def exact_units(x: str) -> str:
    """A value in units of 1e-15, as an exact integer; read from its printed decimals."""
    return f"CAST(replace(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(20,15)) AS VARCHAR), '.', '') AS HUGEINT)"


def exact_mean(total: str, n: str) -> str:
    """Mean with 23 digits (half up) of a sum of exact units, as a double."""
    scale = "100000000000000000000000::HUGEINT"
    m = f"(({total} * 200000000::HUGEINT + {n}) // (2 * {n}))"
    return f"CAST(CAST({m} // {scale} AS VARCHAR) || '.' || lpad(CAST({m} % {scale} AS VARCHAR), 23, '0') AS DOUBLE)"


SP = r"[\s\x1c-\x1f]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({x}), '{SP}+'), lambda w: w <> ''))"


def alnum(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


_NONE = "CAST([] AS VARCHAR[])"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_cases": (
        (),
        f"""
        SELECT 'run-' || (c.conv_id % 8) AS eval_run_id, c.conv_id || '-' || c.turn AS case_id, c.conv_id, c.turn,
               CASE c.conv_id % 3 WHEN 0 THEN 'rag' WHEN 1 THEN 'tool_calling' ELSE 'hybrid' END AS suite,
               c.text AS query, a.text AS reply, l.text AS live_answer,
               CASE WHEN (c.conv_id + c.turn) % 4 = 0 THEN a.text ELSE l.text END AS expected_answer,
               CASE WHEN c.conv_id % 5 = 0 OR w.text IS NULL THEN {_NONE} ELSE [w.text] END AS expected_contexts,
               CASE WHEN c.conv_id % 2 = 1 OR a.text IS NULL THEN {_NONE}
                    WHEN f.text IS NULL THEN [a.text] ELSE [a.text, f.text] END AS retrieved_contexts,
               CASE c.conv_id % 3 WHEN 0 THEN ['search_docs'] WHEN 1 THEN ['create_ticket', 'lookup_oncall']
                    ELSE ['search_docs', ' warehouse_query ', ''] END AS expected_tools,
               CASE WHEN c.conv_id % 8 < 3 THEN 'offline' WHEN c.conv_id % 8 < 6 THEN 'candidate' ELSE 'online' END AS eval_mode,
               c.conv_id % 8 <> 7 AS has_endpoint
        FROM conversations c
        LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant'
        LEFT JOIN conversations l ON l.conv_id = c.conv_id AND l.turn = c.turn + 3 AND l.role = 'assistant'
        LEFT JOIN documents w ON w.doc_id = c.conv_id
        LEFT JOIN documents f ON f.doc_id = c.conv_id + 1
        WHERE c.role = 'user'""",
    ),
    "v_called": (
        ("v_cases",),
        f"""
        SELECT *, CASE WHEN reply IS NULL THEN {_NONE} ELSE
               CASE (turn // 2) % 4 WHEN 0 THEN expected_tools WHEN 1 THEN expected_tools[1:1]
                    WHEN 2 THEN list_concat(expected_tools, ['delete_bucket', 'search_docs']) ELSE {_NONE} END END AS tool_names
        FROM v_cases""",
    ),
    "v_traces": (
        ("v_called",),
        f"""
        SELECT eval_run_id, case_id, conv_id, turn, suite, query, expected_answer, expected_contexts, expected_tools, tool_names,
               CASE WHEN reply IS NOT NULL THEN reply ELSE coalesce(expected_answer, '') END AS answer,
               CASE WHEN reply IS NULL THEN {_NONE} ELSE retrieved_contexts END AS retrieved_contexts
        FROM v_called""",
    ),
    "v_lines": (
        (),
        rf"""
        SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS lines
        FROM documents""",
    ),
    "v_doc_tools": (
        (),
        """
        SELECT doc_id, w[1:len(w) // 2] AS expected_tools, w[len(w) // 2 + 1:] AS tool_names
        FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
    ),
    "v_scores": (
        (),
        """
        SELECT *, score >= 0.7::DOUBLE AS passed FROM (
          SELECT CAST(user_id AS VARCHAR) AS eval_run_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS case_id,
                 CASE event_type WHEN 'click' THEN 'faithfulness' WHEN 'view' THEN 'answer_relevance'
                      WHEN 'purchase' THEN 'tool_selection_precision' ELSE 'politeness' END AS metric,
                 least(1.0::DOUBLE, 0.5::DOUBLE + value / 60.0::DOUBLE) AS score, ts, event_id
          FROM events WHERE event_type IN ('click', 'view', 'purchase', 'signup'))""",
    ),
    "v_last_scores": (
        ("v_scores",),
        """
        SELECT * FROM v_scores
        QUALIFY row_number() OVER (PARTITION BY eval_run_id, case_id, metric ORDER BY ts DESC, event_id DESC) = 1""",
    ),
    "v_score_cases": (
        (),
        """
        SELECT CAST(user_id AS VARCHAR) AS eval_run_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS case_id,
               'ToolError: event ' || max(CASE WHEN event_type = 'error' AND value > 150 THEN event_id END) AS error
        FROM events GROUP BY 1, 2""",
    ),
    "v_case_flags": (
        ("v_scores", "v_score_cases"),
        """
        SELECT c.eval_run_id, c.case_id, c.error, c.error IS NOT NULL AS has_error, count(s.metric) AS n_metrics,
               c.error IS NULL AND count(s.metric) > 0 AND coalesce(bool_and(s.passed), false) AS case_passed
        FROM v_score_cases c LEFT JOIN v_scores s ON s.eval_run_id = c.eval_run_id AND s.case_id = c.case_id
        GROUP BY c.eval_run_id, c.case_id, c.error""",
    ),
    "v_redelivered": (
        (),
        """
        SELECT CAST(l_orderkey AS VARCHAR) AS eval_run_id, CAST(l_linenumber AS VARCHAR) AS case_id,
               CAST(l_linenumber AS BIGINT) AS shard_id, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'returned' END AS error
        FROM lineitem""",
    ),
    "v_runs": (
        (),
        """
        SELECT CAST(o.o_orderkey AS VARCHAR) AS eval_run_id,
               CASE o.o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE 'pass' END AS status,
               o.o_orderdate AS created_at, coalesce(n.n_lines, 0) AS n_results,
               coalesce(n.n_lines, 0) + o.o_custkey % 3 - 1 AS total_cases, coalesce(n.n_done, 0) AS completed_shards,
               coalesce(n.n_lines, 0) + 1 AS total_shards, o.o_custkey % 10 = 0 AS force, o.o_custkey
        FROM (SELECT * FROM orders
              QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o
        LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (l_linestatus = 'F') AS n_done
                   FROM lineitem GROUP BY 1) n ON n.l_orderkey = o.o_orderkey""",
    ),
    "v_last_manifests": (
        (),
        """
        SELECT o_custkey, o_orderkey, CAST(o_custkey AS VARCHAR) AS dataset_id,
               's3://golden/' || o_custkey || '/' || o_orderkey || '.json' AS s3_uri, o_orderpriority AS version,
               CASE WHEN o_orderkey % 3 <> 0 THEN 'sha' || o_orderkey END AS git_sha,
               CASE WHEN o_orderkey % 4 <> 0 THEN 'set-' || o_custkey ELSE 'golden' END AS name, o_orderkey % 50 AS case_count
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    ),
    "v_judge": (
        (),
        """
        SELECT d.doc_id, d.doc_id % 10 AS shape, (d.n_chars % 101) / 100.0::DOUBLE AS points, coalesce(l.quality = 1, false) AS good, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
}


def scored_views() -> dict[str, tuple[tuple[str, ...], str]]:
    """Heuristic scores of the default traces, step by step."""
    return {
        "v_tokens": (
            ("v_traces",),
            f"""
            SELECT *, lower(answer) AS a, {words('answer')} AS tks, {words('query')} AS qt,
                   {words("coalesce(expected_answer, '')")} AS et,
                   CASE WHEN len(retrieved_contexts) > 0 THEN retrieved_contexts ELSE expected_contexts END AS ctx
            FROM v_traces""",
        ),
        "v_hits": (
            ("v_tokens",),
            f"""
            SELECT *, len(ctx) AS n, {words("array_to_string(ctx, ' ')")} AS ct,
                   len(list_filter(ctx, lambda c: contains(a, substr(lower(c), 1, 80)) OR contains(lower(c), substr(a, 1, 80)))) AS hits,
                   coalesce(expected_answer <> '' AND {strip('expected_answer')} = {strip('answer')}, false) AS same
            FROM v_tokens""",
        ),
        "v_shares": (
            ("v_hits",),
            f"""
            SELECT *, {shared('tks', 'ct')} / nullif(len(tks), 0)::DOUBLE AS ctx_share,
                   least(1.0::DOUBLE, 2 * {shared('qt', 'tks')} / nullif(len(qt), 0)::DOUBLE) AS q_share,
                   {shared('tks', 'et')} / greatest(len(et), 1)::DOUBLE AS e_share,
                   list_filter(list_transform(expected_tools, lambda x: {strip('x')}), lambda x: x <> '') AS tool_expected,
                   list_filter(list_transform(tool_names, lambda x: {strip('x')}), lambda x: x <> '') AS tool_actual
            FROM v_hits""",
        ),
        "v_scored": (
            ("v_shares",),
            f"""
            SELECT *,
              CASE WHEN n = 0 THEN CASE WHEN {strip('answer')} <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
                   WHEN hits > 0 THEN least(1.0::DOUBLE, 0.6::DOUBLE + 0.4::DOUBLE * hits / n)
                   WHEN len(tks) = 0 OR len(ct) = 0 THEN 0.0::DOUBLE ELSE {rnd('ctx_share')} END AS overlap,
              CASE WHEN same THEN 1.0::DOUBLE WHEN len(qt) = 0 OR len(tks) = 0 THEN 0.0::DOUBLE
                   WHEN expected_answer <> '' THEN greatest({rnd('q_share')}, {rnd('e_share')})
                   ELSE {rnd('q_share')} END AS answer_relevance,
              len(list_distinct(tool_expected)) AS ne, len(list_distinct(tool_actual)) AS na,
              {shared('tool_expected', 'tool_actual')} AS nb
            FROM v_shares""",
        ),
        "v_metrics": (
            ("v_scored",),
            f"""
            SELECT *, CASE WHEN same THEN 1.0::DOUBLE ELSE overlap END AS faithfulness, {rnd('tp')} AS tool_selection_precision
            FROM (SELECT *, CASE WHEN ne = 0 AND na = 0 THEN 1.0::DOUBLE WHEN ne = 0 OR na = 0 THEN 0.0::DOUBLE
                                 ELSE nb / na::DOUBLE END AS tp FROM v_scored)""",
        ),
    }


VIEWS.update(scored_views())


def with_views(names: Iterable[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named views, their dependencies and extra CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({VIEWS[name][1].strip()})" for name in ordered]
    parts += [f"{name} AS ({text.strip()})" for name, text in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body.strip()
