from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runsieve.plans import attempts as A

_T0 = dt.datetime(2024, 1, 1)


def _at(seconds):
    return _T0 + dt.timedelta(seconds=seconds)


def _rows(spark, *rows):
    full = [(m, r, _at(s), c is None, c, c and f"{c}: {r}") for m, r, s, c in rows]
    return spark.createDataFrame(full, A.ATTEMPT)


def _states(frame, seconds, **more):
    as_of = F.lit(_at(seconds)).cast("timestamp")
    return {r["message_id"]: r for r in A.message_states(frame, as_of, **more).collect()}


@pytest.mark.parametrize("limit", [3, 5])
def test_replays_limits_and_quarantine(spark, tmp_path, limit):
    ledger = A.attempt_ledger(spark, str(tmp_path / "ledger"), buckets=4)
    fails = [("a", f"r{i}", 100 * i, "ThrottlingException") for i in range(5)] + [("b", "r0", 0, "ValueError"), ("b", "r1", 50, None)]
    fails += [("c", "r0", 0, "ValueError"), ("d", "r0", 30, "ModelTimeoutException"), ("d", "r1", 60, "ModelTimeoutException")]
    random.Random(limit).shuffle(fails)
    for number, part in enumerate([fails[:5], fails[5:], fails[2:8]]):
        for _ in range(2):
            A.record(ledger, _rows(spark, *part), "queue", number)
    A.record(ledger, spark.createDataFrame([(None, "r", None, False, None, None), ("x", None, None, False, None, None)], A.ATTEMPT), "queue", 3)
    ledger.compact()
    got = _states(ledger.read(), 120, limit=limit)
    assert {m: (r["failures"], r["state"]) for m, r in got.items()} == {
        "a": (5, "quarantined"), "b": (1, "done"), "c": (1, "due"), "d": (2, "waiting"),
    }
    assert got["d"]["due_at"] == _at(180) and got["a"]["last_error"] == "ThrottlingException: r4" and got["a"]["due_at"] is None
    states = A.message_states(ledger.read(), F.lit(_at(180)).cast("timestamp"), limit=limit)
    again = A.due_messages(spark.createDataFrame([(m, m.upper()) for m in "abcd"], "message_id string, body string"), states)
    assert {tuple(r) for r in again.collect()} == {("c", "C", 2), ("d", "D", 3)}
    held = A.quarantine(ledger.read(), states).orderBy("attempt").collect()
    assert [(r["attempt"], r["receipt"]) for r in held] == [(i + 1, f"r{i}") for i in range(5)]


def test_final_errors_stop_and_waits_are_bounded(spark):
    frame = _rows(spark, ("a", "r", 0, "ValueError"), ("b", "r", 0, "ServiceUnavailableException"), *[("c", f"r{i}", i, "ThrottlingException") for i in range(20)])
    got = _states(frame, 30, limit=99, stop_at_final=True)
    assert {m: r["state"] for m, r in got.items()} == {"a": "quarantined", "b": "waiting", "c": "waiting"}
    assert got["c"]["due_at"] == _at(19 + A.LONGEST_WAIT)
    unknown = spark.createDataFrame([("m", "r", None, None, None, None)], A.ATTEMPT)
    assert _states(unknown, 30)["m"]["state"] == "waiting" and _states(unknown.limit(0), 30) == {}
