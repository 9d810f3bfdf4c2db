"""Queries on sources, sinks and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsieve.catalog import views as V
from runsieve.catalog.aggregates import _STEPS, _VIEWS, _event_reports
from runsieve.catalog.registry import query
from runsieve.catalog.sql import fixed, strip, with_views
from runsieve.operators import reports as rep
from runsieve.operators import validate
from runsieve.operators.traces import default_traces
from runsieve.plans.evaluate import score_cases
from runsieve.session import fresh_dir
from runsieve.sources import golden, results, sinks, triggers

RUN = "eval_run_id"


def golden_documents(spark, sf):
    """Each document as a case set: one case per line, its answer the line itself."""
    texts = F.array().cast("array<string>")
    case = F.transform(
        "lines",
        lambda line, i: F.struct(
            F.concat(F.lit(" L"), i, F.lit(" ")).alias("id"),
            F.when(i % 3 == 0, "rag").when(i % 3 == 1, "tool_calling").alias("suite"),
            line.alias("query"),
            F.when(i % 2 == 0, line).alias("expected_answer"),
            F.array(line).alias("expected_contexts"),
            F.struct(line.alias("answer"), F.array(line).alias("retrieved_contexts"), F.array().cast("array<struct<name:string>>").alias("tool_calls")).alias("recorded_trace"),
        ),
    )
    rows = V.doc_lines(spark, sf).filter(F.size("lines") > 0)
    return rows.select(
        F.when(F.col("doc_id") % 2 == 0, "2.0").alias("version"), F.concat(F.lit("doc-"), "doc_id").alias("name"), case.alias("cases"), texts.alias("tags")
    )


@query(
    "src_golden_cases",
    with_views(
        ["v_lines"],
        """SELECT 'doc-' || doc_id AS dataset_id, CASE WHEN doc_id % 2 = 0 THEN '2.0' ELSE '1.0' END AS version, pos, 'L' || pos AS case_id,
                  CASE pos % 3 WHEN 0 THEN 'rag' WHEN 1 THEN 'tool_calling' ELSE 'hybrid' END AS suite, line AS query,
                  CASE WHEN pos % 2 = 0 THEN line END AS expected_answer, 1::BIGINT AS n_contexts, 0::BIGINT AS n_tools, line AS recorded_answer
           FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM v_lines)""",
    ),
)
def src_golden_cases(spark, sf):
    path = fresh_dir(spark, "golden")
    golden.write_golden(golden_documents(spark, sf), path)
    cases = golden.case_rows(golden.read_golden(spark, path, whole_files=False), F.col("name"))
    return cases.select(
        "dataset_id", "version", "pos", "case_id", "suite", "query", "expected_answer",
        F.size("expected_contexts").cast("bigint").alias("n_contexts"), F.size("expected_tools").cast("bigint").alias("n_tools"),
        F.col("recorded_trace.answer").alias("recorded_answer"),
    )


@query(
    "src_results_polymorphic",
    with_views(
        ["v_lines"],
        """SELECT 'doc-' || doc_id AS file_path, pos, 'L' || pos AS case_id, line AS answer, pos % 3 AS n_metrics
           FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM v_lines WHERE doc_id % 5 IN (0, 2))
           UNION ALL SELECT 'doc-' || doc_id, 0, 'one', text, 1 FROM documents WHERE doc_id % 5 = 1""",
    ),
)
def src_results_polymorphic(spark, sf):
    def metrics(n):
        one = F.struct(F.lit("faithfulness").alias("name"), F.lit(0.5).alias("score"))
        return F.slice(F.array(one, one), F.lit(1), n)

    listed = F.transform(
        "lines",
        lambda line, i: F.struct(F.concat(F.lit("L"), i).alias("case_id"), line.alias("answer"), metrics(i % 3).alias("metrics")),
    )
    single = F.to_json(F.struct(F.lit("one").alias("case_id"), F.col("text").alias("answer"), metrics(F.lit(1)).alias("metrics")))
    kind = F.col("doc_id") % 5
    content = (
        F.when(kind == 0, F.to_json(listed))
        .when(kind == 1, single)
        .when(kind == 2, F.to_json(F.struct(listed.alias("results"))))
        .when(kind == 3, F.to_json(F.struct(F.col("text").alias("other"))))
        .otherwise(F.col("text"))
    )
    docs = V.doc_lines(spark, sf).select(F.concat(F.lit("doc-"), "doc_id").alias("file_path"), content.alias("content"))
    rows = results.parse_result_documents(docs)
    return rows.select("file_path", "pos", "case_id", "answer", F.size("metrics").cast("bigint").alias("n_metrics"))


@query(
    "uri_parts",
    r"""SELECT page_id, ok AS is_valid, CASE WHEN ok THEN host END AS bucket, CASE WHEN ok THEN ltrim(path, '/') END AS key FROM (
          SELECT *, scheme = 'https' AND host <> '' AND path <> '' AS ok FROM (
            SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 1)) AS scheme,
                   regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 2) AS host,
                   regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 3) AS path FROM pages))""",
)
def uri_parts(spark, sf):
    return triggers.split_uri(V.table(spark, sf, "pages"), "url", scheme="https").select("page_id", "is_valid", "bucket", "key")


@query(
    "trigger_events_norm",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'record' WHEN 1 THEN 'detail' ELSE 'direct' END AS trigger,
              CASE page_id % 3 WHEN 2 THEN 'top' ELSE 'golden-sets' END AS dataset_bucket,
              CASE page_id % 3 WHEN 2 THEN 'a+b/' || url ELSE 'a b/' || url_decode(replace(url, '+', ' ')) END AS dataset_key,
              CASE WHEN page_id % 3 = 2 THEN 'set-' || page_id END AS dataset_id
       FROM pages""",
)
def trigger_events_norm(spark, sf):
    kind, key = F.col("page_id") % 3, F.concat(F.lit("a+b/"), "url")
    place = F.struct(
        F.struct(F.lit("golden-sets").alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object")
    )
    body = (
        F.when(kind == 0, F.to_json(F.struct(F.array(F.struct(place.alias("s3"))).alias("Records"))))
        .when(kind == 1, F.to_json(F.struct(place.alias("detail"))))
        .otherwise(
            F.to_json(
                F.struct(
                    F.struct(F.lit("inner").alias("dataset_bucket"), key.alias("dataset_key")).alias("detail"),
                    F.lit("top").alias("dataset_bucket"),
                    F.concat(F.lit("set-"), "page_id").alias("dataset_manifest_id"),
                )
            )
        )
    )
    events = V.table(spark, sf, "pages").select("page_id", body.alias("event"))
    return triggers.normalise_triggers(events).select("page_id", "trigger", "dataset_bucket", "dataset_key", "dataset_id")


_RAW_LINES = {
    "raw": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text <> ''",
    "ids": f"""SELECT CAST(doc_id AS VARCHAR) AS dataset_id, {strip('line')} AS case_id, length(line) % 4 = 3 AS odd FROM raw""",
}


@query(
    "dq_case_violations",
    with_views(
        [],
        """SELECT dataset_id, case_id, 'blank_id' AS violation, count(*) AS n FROM ids WHERE case_id = '' GROUP BY 1, 2
           UNION ALL SELECT dataset_id, case_id, 'unknown_suite', count(*) FROM ids WHERE odd GROUP BY 1, 2
           UNION ALL SELECT dataset_id, case_id, 'duplicate_id', count(*) FROM ids GROUP BY 1, 2 HAVING count(*) > 1
           UNION ALL SELECT CAST(doc_id AS VARCHAR), '', 'no_cases', 0 FROM documents WHERE coalesce(text, '') = ''""",
        _RAW_LINES,
    ),
)
def dq_case_violations(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dataset_id"), "text")
    filled = docs.filter("text <> ''")
    lines = filled.select("dataset_id", F.explode(F.split("text", "\n")).alias("case_id"))
    kind = F.length("case_id") % 4
    suite = F.when(kind == 0, "rag").when(kind == 1, "tool_calling").when(kind == 2, "hybrid").otherwise("other")
    cases = lines.withColumn("suite", suite)
    broken = validate.case_violations(cases)
    return broken.unionByName(validate.empty_datasets(docs.select("dataset_id"), filled.select("dataset_id")))


@query(
    "dq_score_violations",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(list_filter([
                CASE WHEN NOT (l_discount * 15 BETWEEN 0 AND 1) THEN 'score_out_of_range' END,
                CASE WHEN NOT (l_tax * 20 BETWEEN 0 AND 1) THEN 'threshold_out_of_range' END,
                CASE WHEN l_quantity * 3 NOT BETWEEN 1 AND 100 THEN 'shard_size_out_of_range' END,
                CASE WHEN l_linenumber * 4 NOT BETWEEN 0 AND 20 THEN 'queue_wait_seconds_out_of_range' END,
                CASE WHEN l_suppkey < 60 THEN 'run_timeout_seconds_out_of_range' END,
                CASE WHEN l_returnflag = 'R' THEN 'unknown_status' END], lambda x: x IS NOT NULL)) AS violation FROM lineitem""",
)
def dq_score_violations(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    flag = F.col("l_returnflag")
    rows = V.table(spark, sf, "lineitem").select(
        *keys,
        (F.col("l_discount") * 15).alias("score"),
        (F.col("l_tax") * 20).alias("threshold"),
        (F.col("l_quantity") * 3).alias("shard_size"),
        (F.col("l_linenumber") * 4).alias("queue_wait_seconds"),
        F.col("l_suppkey").alias("run_timeout_seconds"),
        F.when(flag == "A", "pass").when(flag == "N", "running").otherwise("returned").alias("status"),
    )
    scores = validate.range_violations(rows, keys, ["score", "threshold"])
    return scores.unionByName(validate.setting_violations(rows, keys)).unionByName(validate.enum_violations(rows, keys))


@query(
    "snk_report_json",
    with_views(
        _VIEWS,
        """SELECT eval_run_id, status, overall_score, error_rate, len(failures) AS n_failures, 3::BIGINT AS n_metrics,
                  's3://results/runs/' || eval_run_id || '/report.json' AS report_uri,
                  strftime(DATE '2024-01-01' + CAST(CAST(eval_run_id AS BIGINT) % 30 AS INTEGER), '%Y-%m-%d') AS run_date
           FROM decided""",
        _STEPS,
    ),
)
def snk_report_json(spark, sf):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col(RUN).cast("int") % 30)), "yyyy-MM-dd")
    reports = _event_reports(spark, sf).withColumn("run_date", day)
    path = fresh_dir(spark, "reports")
    sinks.write_reports(rep.report_json(reports, "s3://results").select(RUN, "report_uri", "report_json", "run_date"), path)
    shape = "status string, overall_score double, error_rate double, failures array<string>, metrics array<struct<metric:string>>"
    stored = sinks.read_reports(spark, path, f"{RUN} string, report_uri string, report_json string, run_date string")
    return stored.withColumn("r", F.from_json("report_json", shape)).select(
        RUN, "r.status", "r.overall_score", "r.error_rate", F.size("r.failures").cast("bigint").alias("n_failures"),
        F.size("r.metrics").cast("bigint").alias("n_metrics"), "report_uri", "run_date",
    )


@query(
    "audit_docs",
    with_views(
        ["v_metrics"],
        f"""SELECT unnest(['audit', 'cases']) AS index_name, eval_run_id || ':' || case_id AS doc_id, answer, 3::BIGINT AS n_thoughts,
                   'lexical scorer|lexical scorer|recall=' || {fixed('tr', 3)} || ' f1=' || {fixed('tf', 3)} AS thoughts,
                   len(tool_names) AS n_calls, len(retrieved_contexts) AS n_contexts
            FROM (SELECT *, CASE WHEN tp + tr = 0 THEN 0.0::DOUBLE ELSE 2 * tp * tr / (tp + tr) END AS tf FROM (
                    SELECT *, CASE WHEN ne = 0 THEN 1.0::DOUBLE WHEN na = 0 THEN 0.0::DOUBLE ELSE nb / ne::DOUBLE END AS tr FROM v_metrics))""",
    ),
)
def audit_docs(spark, sf):
    scored = score_cases(default_traces(V.cases(spark, sf)))
    rows = rep.audit_documents(
        scored.select(RUN, "case_id", "answer", "metrics", F.col("tool_calls").alias("tool_call_logs"), "retrieved_contexts")
    )
    a = "doc.audit"
    return rows.select(
        "index_name", "doc_id", "doc.answer", F.size(f"{a}.chain_of_thought").cast("bigint").alias("n_thoughts"),
        F.array_join(f"{a}.chain_of_thought", "|").alias("thoughts"), F.size(f"{a}.tool_call_logs").cast("bigint").alias("n_calls"),
        F.size(f"{a}.retrieved_contexts").cast("bigint").alias("n_contexts"),
    )
