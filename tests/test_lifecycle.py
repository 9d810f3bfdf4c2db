from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runsieve.operators import dispatch, runs, validate
from runsieve.operators.ranking import latest_by, with_position
from runsieve.sources import state, triggers


@pytest.mark.parametrize("parts", [1, 5])
def test_shards_of_ten_by_four(spark, parts):
    rows = [("a", i) for i in range(10)] + [("b", i) for i in range(3)]
    cases = spark.createDataFrame(rows, "eval_run_id string, n bigint").orderBy(F.desc("n")).repartition(parts)
    got = dispatch.assign_shards(cases, ["n"], size=4)
    sizes = {(r[0], r[1]): r[2] for r in got.groupBy("eval_run_id", "shard_id").count().collect()}
    assert sizes == {("a", 0): 4, ("a", 1): 4, ("a", 2): 2, ("b", 0): 3}
    assert got.filter("pos <> n").count() == 0
    totals = {r["eval_run_id"]: (r["total_cases"], r["total_shards"]) for r in dispatch.dispatch_totals(got).collect()}
    assert totals == {"a": (10, 3), "b": (3, 1)}
    with pytest.raises(ValueError):
        dispatch.assign_shards(got, size=0)


def test_positions_of_a_hot_group_span_partitions(spark):
    rows = [("hot", i * 7 % 1000, i) for i in range(1000)] + [(f"g{i}", 0, i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, k bigint, id bigint").repartition(6)
    got = with_position(df, ["g"], ["k", "id"])
    hot = got.filter("g = 'hot'").orderBy("k", "id").select("pos").collect()
    assert [r[0] for r in hot] == list(range(1000))
    assert got.filter("g <> 'hot' AND pos <> 0").count() == 0 and got.count() == 1050
    unnamed = with_position(spark.createDataFrame([(None, 2, 0), (None, 1, 0), ("a", 1, 0)], df.schema), ["g"], ["k", "id"])
    assert sorted((r["g"] or "", r["k"], r["pos"]) for r in unnamed.collect()) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


def test_job_rows_and_ids(spark):
    cases = spark.createDataFrame([("r", f"c{i}", i) for i in range(5)], "eval_run_id string, case_id string, pos bigint")
    settings = spark.createDataFrame([("r", "candidate")], "eval_run_id string, eval_mode string")
    jobs = dispatch.shard_jobs(dispatch.assign_shards(cases, size=3), settings).orderBy("shard_id").collect()
    assert [j["case_ids"] for j in jobs] == [["c0", "c1", "c2"], ["c3", "c4"]]
    assert (jobs[1]["group_id"], jobs[1]["dedup_id"]) == ("r-0001", "r-shard-0001")
    assert jobs[1]["shard_key"] == "runs/r/shards/0001.json"
    wide = spark.range(1).select(dispatch.group_id(F.lit("r"), F.lit(12345)), dispatch.transport_id(F.repeat(F.lit("x"), F.lit(200))))
    assert tuple(wide.first()) == ("r-12345", "x" * 128)


def test_settings_and_dataset_resolution(spark):
    schema = "dataset_id string, git_sha string, dataset_name string, dataset_bucket string, dataset_key string, eval_mode string"
    rows = [("known", None, "g", "b", "k", "online"), ("new", "sha", "g", "b", "k", ""), ("", "sha", "g", "b", "k", None)]
    rows += [(None, None, "g", "b", "k", None), ("ghost", None, "g", "b", None, None)]
    manifests = spark.createDataFrame([("known", "s3://x/y.json")], "dataset_id string, s3_uri string")
    ready = dispatch.resolve_settings(spark.createDataFrame(rows, schema), {"eval_mode": ""}, {"eval_mode": "candidate", "judge": "j"})
    got = {r["dataset_id"]: r for r in dispatch.resolve_datasets(ready, manifests).collect()}
    assert (got["known"]["dataset_uri"], got["known"]["manifest_id"], got["known"]["insert_manifest"]) == ("s3://x/y.json", "known", False)
    assert got["new"]["dataset_uri"] == "s3://b/k" and got["new"]["insert_manifest"]
    assert got[""]["manifest_id"] == "sha" and got[None]["manifest_id"] == "g"
    assert got["ghost"]["error"] and not got["ghost"]["insert_manifest"]
    assert [got[k]["eval_mode"] for k in ("known", "new", None)] == ["online", "candidate", "candidate"]


def test_run_state_items(spark):
    base = '{"eval_run_id": "%s", "status": "running", "total_cases": 9, "completed_shards": 1}'
    rows = [("a", "odd", 5, None, base % "a"), ("b", "pass", None, 7, base % "b"), ("c", "pass", 1, 1, None)]
    items = spark.createDataFrame(rows, "eval_run_id string, status string, completed_shards bigint, completed_cases bigint, payload string")
    got = {r["eval_run_id"]: r for r in state.decode_runs(items).collect()}
    assert (got["a"]["status"], got["a"]["completed_shards"], got["a"]["total_cases"]) == ("running", 5, 9)
    assert (got["b"]["status"], got["b"]["completed_shards"], got["b"]["completed_cases"]) == ("pass", 1, 7)
    assert got["c"]["decode_error"] and got["a"]["decode_error"] is None


def test_manifest_fallback_defaults(spark):
    rows = [("d", "", "s3://b/old", "", "", None, None, 1), ("d", "", "s3://b/new", "", "", None, None, 2)]
    rows += [("p", "x", "u", "9", "n", 9, '{"s3_uri": "s3://b/p", "case_count": 3}', 1), ("", "x", "u", "9", "n", 9, None, 1)]
    schema = "dataset_id string, git_sha string, s3_uri string, version string, name string, case_count bigint, payload string, seq bigint"
    got = {r["dataset_id"]: r for r in state.latest_manifests(spark.createDataFrame(rows, schema), ["seq"]).collect()}
    assert set(got) == {"d", "p"}
    assert tuple(got["d"])[1:] == (None, "s3://b/new", "1.0", "golden", 0)
    assert tuple(got["p"])[1:] == (None, "s3://b/p", "1.0", "golden", 3)


def test_progress_ignores_redelivery(spark):
    rows = [("r", 0, 8), ("r", 0, 8), ("r", 1, 2), ("s", 0, 1)] + [("hot", 0, 5)] * 500
    got = {r["eval_run_id"]: tuple(r)[1:] for r in runs.shard_progress(spark.createDataFrame(rows, "eval_run_id string, shard_id bigint, n_cases bigint")).collect()}
    assert got == {"r": (2, 10, 3), "s": (1, 1, 1), "hot": (1, 5, 500)}


def test_latest_missing_and_dead(spark):
    rows = [("r", "a", 1, 10, None), ("r", "a", 2, 3, "x"), ("r", "a", 2, 4, "y"), ("r", "b", 1, 1, "")]
    df = spark.createDataFrame(rows, "eval_run_id string, case_id string, shard_id bigint, pos bigint, error string")
    last = {r["case_id"]: r["error"] for r in latest_by(df, ["eval_run_id", "case_id"], ["shard_id", "pos"]).collect()}
    assert last == {"a": "y", "b": ""}
    summary = {r["shard_id"]: (r["cases"], r["errors"]) for r in runs.shard_summary(df).collect()}
    assert summary == {1: (2, 0), 2: (2, 2)}
    wanted = spark.createDataFrame([("r", "a"), ("r", "z")], "eval_run_id string, case_id string")
    assert [r["case_id"] for r in runs.missing_cases(wanted, df).collect()] == ["z"]
    failures = spark.createDataFrame([("m1",)] * 3 + [("m2",)] * 2, "id string")
    assert [tuple(r) for r in runs.dead_letters(failures, ["id"], 3).collect()] == [("m1", 3)]
    assert runs.run_ids(spark.createDataFrame([("r",), ("r",), (None,)], "eval_run_id string")).count() == 1


def test_manifest_source(spark):
    results = spark.createDataFrame([("a",), ("b",), ("c",)], "eval_run_id string")
    live = spark.createDataFrame([("a", None)], "eval_run_id string, version string")
    stored = spark.createDataFrame([("a", "f"), ("b", "f")], "eval_run_id string, version string")
    got = {r["eval_run_id"]: (r["manifest_source"], r["version"]) for r in runs.join_manifests(results, live, stored, ["version"]).collect()}
    assert got == {"a": ("state", None), "b": ("file", "f"), "c": ("missing", None)}


def test_trigger_shapes_and_uris(spark):
    events = [
        ('{"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "golden/a+b%20c.json"}}}]}', "b", "golden/a b c.json"),
        ('{"detail": {"bucket": {"name": "b"}, "object": {"key": "x%2By"}}}', "b", "x+y"),
        ('{"detail": {"dataset_key": "in", "dataset_bucket": "b"}, "dataset_key": "top+1"}', "b", "top+1"),
        ('{"Records": [], "dataset_key": "k"}', None, "k"),
        ("not json", None, None),
    ]
    df = spark.createDataFrame([(i, e[0]) for i, e in enumerate(events)], "i int, event string")
    for row in triggers.normalise_triggers(df).collect():
        assert (row["dataset_bucket"], row["dataset_key"]) == events[row["i"]][1:]
    uris = [("s3://b/k/x.json", True, "b", "k/x.json"), ("s3://b_1//k", True, "b_1", "k"), ("s3://b", False, None, None), ("https://b/k", False, None, None)]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(uris)], "i int, uri string")
    for row in triggers.split_uri(df, "uri").collect():
        assert (row["is_valid"], row["bucket"], row["key"]) == uris[row["i"]][1:]


def test_violations(spark):
    rows = [("d", " a ", "rag"), ("d", "a", "rag"), ("d", "\t", "hybrid"), ("e", "a", "odd")]
    cases = spark.createDataFrame(rows, "dataset_id string, case_id string, suite string")
    got = {tuple(r) for r in validate.case_violations(cases).collect()}
    assert got == {("d", "a", "duplicate_id", 2), ("d", "", "blank_id", 1), ("e", "a", "unknown_suite", 1)}
    sets = spark.createDataFrame([("d",), ("f",)], "dataset_id string")
    assert [r["dataset_id"] for r in validate.empty_datasets(sets, cases).collect()] == ["f"]
    scores = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.01), (4, None), (5, float("nan"))], "id int, score double")
    assert {r["id"] for r in validate.range_violations(scores, ["id"], ["score"]).collect()} == {3, 4, 5}
    conf = spark.createDataFrame([(1, 8, 20, 60), (2, 0, 21, 59)], "id int, shard_size int, queue_wait_seconds int, run_timeout_seconds int")
    assert validate.setting_violations(conf, ["id"]).count() == 3
    modes = spark.createDataFrame([(1, "offline"), (2, "sideways")], "id int, eval_mode string")
    assert [r["violation"] for r in validate.enum_violations(modes, ["id"]).collect()] == ["unknown_eval_mode"]
