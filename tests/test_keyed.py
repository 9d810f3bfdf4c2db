"""Keyed tables: versions, deltas, compaction, replays, and reports from stored partials."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runsieve.operators.aggregate import OUTCOMES
from runsieve.plans.evaluate import build_reports
from runsieve.plans.incremental import deliver, partials_table, regate
from runsieve.sources import keyed
from runsieve.sources.keyed import ConflictError, KeyedTable

SCHEMA = "k string, part bigint, v bigint"


@pytest.fixture()
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ("k", "part"), ("k",), buckets=4)


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def _state(df):
    return {(r.k, r.part): r.v for r in df.collect()}


def test_empty_table(table):
    assert table.latest_version() == 0 and table.read().columns == ["k", "part", "v"] and table.read().count() == 0
    assert table.compact() == 0


def test_upserts_keep_versions_readable(spark, table):
    first = table.upsert(_rows(spark, ("a", 1, 1), ("b", 1, 2), (None, 1, 3)))
    second = table.upsert(_rows(spark, ("a", 1, 10), (None, 1, 30), ("c", None, 4)))
    now = {("a", 1): 10, ("b", 1): 2, (None, 1): 30, ("c", None): 4}
    assert _state(table.read()) == now
    assert _state(table.read(first)) == {("a", 1): 1, ("b", 1): 2, (None, 1): 3}
    third = table.compact()
    assert [first, second, third] == [1, 2, 3]
    assert _state(table.read()) == now == _state(table.read(second))
    assert all(s["base"] for s in table.manifest()["segments"] if set(s["buckets"]))
    assert table.compact() == third


def test_order_picks_the_row_of_a_repeated_key(spark, table):
    table.upsert(_rows(spark, ("a", 1, 5), ("a", 1, 9), ("a", 1, 7)), order=["v"])
    assert _state(table.read()) == {("a", 1): 9}


def test_replayed_batch_changes_nothing(spark, table):
    table.upsert(_rows(spark, ("a", 1, 1)), writer="w", batch_id=0)
    table.upsert(_rows(spark, ("a", 1, 2)), writer="w", batch_id=1)
    assert table.upsert(_rows(spark, ("a", 1, 1)), writer="w", batch_id=0) == 2
    table.compact()
    table.upsert(_rows(spark, ("a", 1, 99)), writer="w", batch_id=1)
    assert _state(table.read()) == {("a", 1): 2} and table.latest_version() == 3


def test_crash_before_publishing_leaves_the_old_version(spark, table, monkeypatch):
    table.upsert(_rows(spark, ("a", 1, 1)))

    def crash(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", crash)
        with pytest.raises(OSError):
            table.upsert(_rows(spark, ("a", 1, 2)))
        with pytest.raises(OSError):
            table.compact()
    assert _state(table.read()) == {("a", 1): 1} and table.latest_version() == 1
    table.upsert(_rows(spark, ("a", 1, 3)))
    assert _state(table.read()) == {("a", 1): 3}


def test_write_during_compaction_stays_above_the_base(spark, table, monkeypatch):
    table.upsert(_rows(spark, ("a", 1, 1), ("b", 1, 1)))
    stored = KeyedTable._store

    def slow(self, rows):
        out = stored(self, rows)
        monkeypatch.setattr(KeyedTable, "_store", stored)
        table.upsert(_rows(spark, ("a", 1, 2)))
        return out

    monkeypatch.setattr(KeyedTable, "_store", slow)
    table.compact()
    assert _state(table.read()) == {("a", 1): 2, ("b", 1): 1} and table.latest_version() == 3


def test_a_lost_race_takes_the_next_version(spark, table, monkeypatch):
    table.upsert(_rows(spark, ("a", 1, 1)))
    assert not table._publish({**table.manifest(), "version": 1})
    seen, calls = KeyedTable.manifest, []

    def stale(self, version=None):
        calls.append(version)
        out = seen(self, version)
        return {**out, "version": 0} if len(calls) == 1 else out

    monkeypatch.setattr(KeyedTable, "manifest", stale)
    assert table.upsert(_rows(spark, ("b", 1, 2))) == 2
    monkeypatch.setattr(KeyedTable, "_publish", lambda self, m: False)
    monkeypatch.setattr(keyed, "ATTEMPTS", 2)
    with pytest.raises(ConflictError):
        table.upsert(_rows(spark, ("b", 1, 3)))


def test_lookup_reads_the_buckets_of_its_keys(spark, table):
    table.upsert(_rows(spark, *[(f"k{i}", 1, i) for i in range(40)]))
    found = table.lookup(spark.createDataFrame([("k7",)], "k string"))
    assert _state(found) == {("k7", 1): 7}
    assert len({f.split("bucket=")[1][0] for f in found.inputFiles()}) == 1


def _facts(spark, shards):
    rows = [("r" + str(s % 3), str(s), *f) for s, facts in shards.items() for f in facts]
    return spark.createDataFrame(rows, "eval_run_id string, shard_id string, metric string, score double, input_tokens bigint, output_tokens bigint")


def _shard(rng):
    out = []
    for _ in range(rng.randint(1, 4)):
        out.append((rng.choice(OUTCOMES), None, rng.randint(0, 9), rng.randint(0, 9)))
        out += [(m, rng.randint(0, 20) / 20, None, None) for m in ("faithfulness", "answer_relevance") if rng.random() < 0.8]
    return out


def test_reports_equal_those_of_the_last_deliveries(spark, tmp_path):
    rng, table, last = random.Random(5), partials_table(spark, str(tmp_path / "p"), 2), {}
    for batch in range(3):
        came = {s: _shard(rng) for s in rng.sample(range(9), 9 if batch == 0 else 4)}
        last |= came
        for _ in range(2):
            deliver(table, _facts(spark, came), "w", batch)
        if batch == 1:
            table.compact()
    runs = spark.createDataFrame([("r0", 20), ("r1", 20), ("r2", 20), ("none", 4)], "eval_run_id string, total_cases bigint")
    whole = build_reports(_facts(spark, last).drop("shard_id"), runs)
    again = regate(table, runs)
    assert sorted(map(str, again.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    one = regate(table, runs.filter(F.col("eval_run_id") == "r1"))
    assert [str(r) for r in one.select(whole.columns).collect()] == [str(r) for r in whole.filter("eval_run_id = 'r1'").collect()]
