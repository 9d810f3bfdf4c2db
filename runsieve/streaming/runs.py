"""Run tracking with keyed state and timers: completion once, timeout by the clock, late shards apart."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from runsieve.schemas import RUN_TIMEOUT_SECONDS
from runsieve.sources.sinks import append_batch

RUN = "eval_run_id"
#: Seconds after the time limit for which a closed run is remembered.
RETENTION_SECONDS = 7 * 86400
#: Shards of a run that its own record holds.
NEAR_SHARDS = 64
EVENT = "kind string, eval_run_id string, created_at timestamp, total_shards bigint, shard_id string, n_cases bigint, finished_at timestamp, clock timestamp"
OUTCOME = "eval_run_id string, outcome string, created_at timestamp, total_shards bigint, completed_shards bigint, completed_cases bigint, shard_id string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = [part.split()[0] for part in EVENT.split(", ")]


def _events(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    types = dict(part.split() for part in EVENT.split(", "))
    values = {"kind": F.lit(kind), **columns}
    return rows.select(*[(values[f] if f in values else F.lit(None)).cast(types[f]).alias(f) for f in _FIELDS])


def start_events(runs: DataFrame, run: Column, created_at: Column, total_shards: Column) -> DataFrame:
    """Runs that begin, with the number of their shards."""
    return _events(runs, "start", eval_run_id=run, created_at=created_at, total_shards=total_shards)


def shard_events(done: DataFrame, run: Column, shard_id: Column, n_cases: Column, finished_at: Column) -> DataFrame:
    """Finished shards."""
    return _events(done, "shard", eval_run_id=run, shard_id=shard_id, n_cases=n_cases, finished_at=finished_at)


def clock_events(ticks: DataFrame, at: Column) -> DataFrame:
    """Sweeps: the time that the scheduler's clock has reached. Nothing else moves the event-time clock."""
    return _events(ticks, "clock", clock=at)


class RunTracker(StatefulProcessor):
    """State of one run: its start, its distinct shards in time, whether its outcome was told, and one timer.

    A shard that finished within the limit counts, whenever it arrives before the timer fires; repeats change
    nothing. ``complete`` is told once, when the distinct shards reach the run's own number; ``timeout`` once, if
    the timer fires first, with or without any shard. A shard that finished after the limit, or arrives when the
    outcome is told, goes out as ``late``; a repeat of a counted shard does not. A closed run is forgotten by its
    second timer.

    Each call of the state store takes far longer than the work on a row. So a run's first ``NEAR_SHARDS`` shards
    are kept in its own record, read and written once a batch; only further ones are entries of the map.
    """

    def __init__(self, timeout_seconds: int, retention_seconds: int) -> None:
        self.limit, self.retention = timeout_seconds * 1000, retention_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "created bigint, total bigint, told string, cases bigint, shards bigint, near string")
        self.shards = handle.getMapState("shards", "shard_id string", "n_cases bigint, finished bigint")

    def _load(self) -> tuple[tuple, dict[str, tuple]]:
        """The run's record, and its near shards as ``id: (n_cases, finished)``; empty for a run not seen."""
        *state, near = self.run.get() or (None, None, None, 0, 0, "{}")
        return tuple(state), json.loads(near)

    def _save(self, state: tuple, near: dict[str, tuple]) -> None:
        self.run.update((*state, json.dumps(near)))

    def _all_shards(self, near: dict[str, tuple]) -> Iterator[tuple[str, tuple]]:
        yield from near.items()
        if len(near) >= NEAR_SHARDS:
            yield from [(shard[0], value) for shard, value in self.shards.iterator()]

    def _row(self, key: str, outcome: str, state: tuple, shard_id: str | None = None) -> Row:
        created, total, _, cases, shards = state
        values = {"total_shards": total, "completed_shards": shards, "completed_cases": cases, "shard_id": shard_id}
        return Row(eval_run_id=key, outcome=outcome, created_ms=created, **values)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        before, near = self._load()
        created, total, told, cases, shards = before
        n_near, seen = len(near), set(near)
        for row in sorted(rows, key=lambda r: r.kind != "start"):
            if row.kind == "start" and created is None and row.at_ms is not None:
                created, total = row.at_ms, row.size
                # Shards that came before their run's start are judged by its limit now.
                early = []
                for shard, (n_cases, finished) in self._all_shards(near):
                    if finished <= created + self.limit:
                        cases, shards = cases + (n_cases or 0), shards + 1
                    else:
                        early.append(shard)
                for shard in early:
                    yield self._row(key[0], "late", (created, total, told, cases, shards), shard)
            elif row.kind == "shard" and row.shard_id is not None and row.at_ms is not None:
                if row.shard_id in seen:
                    continue
                seen.add(row.shard_id)
                finished = row.at_ms
                if len(near) < NEAR_SHARDS:
                    near[row.shard_id] = (row.size, finished)
                elif self.shards.containsKey((row.shard_id,)):
                    continue
                else:
                    self.shards.updateValue((row.shard_id,), (row.size, finished))
                if created is None:
                    continue
                if told or finished > created + self.limit:
                    yield self._row(key[0], "late", (created, total, told, cases, shards), row.shard_id)
                else:
                    cases, shards = cases + (row.size or 0), shards + 1
            if created is not None and not told and total is not None and shards >= total:
                told = "complete"
                yield self._row(key[0], told, (created, total, told, cases, shards))
        if before[0] is None and created is not None:
            self.handle.registerTimer(created + self.limit + 1)
        after = (created, total, told, cases, shards)
        if after != before or len(near) != n_near:
            self._save(after, near)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        (created, total, told, cases, shards), near = self._load()
        if created is None:
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at >= created + self.limit + 1 + self.retention:
            self.run.clear()
            if len(near) >= NEAR_SHARDS:
                self.shards.clear()
            return
        self.handle.registerTimer(created + self.limit + 1 + self.retention)
        if told is None:
            state = (created, total, "timeout", cases, shards)
            self._save(state, near)
            yield self._row(key[0], "timeout", state)


def track_runs(
    events: DataFrame, timeout_seconds: int = RUN_TIMEOUT_SECONDS, retention_seconds: int = RETENTION_SECONDS, by_event_time: bool = False
) -> DataFrame:
    """Outcomes of runs as a stream: ``complete`` or ``timeout`` once for each, ``late`` for shards out of time.

    Timers follow the clock of the cluster, so a run times out although nothing arrives. With
    ``by_event_time`` they follow the ``clock`` events instead, for replays: only those carry event time, so no
    row is ever too old to be taken.
    """
    # Instants pass Python as milliseconds, which no zone can change.
    # Each cell of a row is a Python object, so a start and a shard share their columns.
    start = F.col("kind") == "start"
    size, at = F.when(start, F.col("total_shards")).otherwise(F.col("n_cases")), F.when(start, F.col("created_at")).otherwise(F.col("finished_at"))
    rows = events.select("kind", RUN, "shard_id", size.alias("size"), F.unix_millis(at).alias("at_ms"), "clock")
    keyed = rows.withWatermark("clock", "0 seconds") if by_event_time else rows.drop("clock")
    told = keyed.groupBy(RUN).transformWithState(
        statefulProcessor=RunTracker(timeout_seconds, retention_seconds),
        outputStructType=OUTCOME.replace("created_at timestamp", "created_ms bigint"),
        outputMode="Append",
        timeMode="EventTime" if by_event_time else "ProcessingTime",
    )
    return told.select(RUN, "outcome", F.timestamp_millis("created_ms").alias("created_at"), "total_shards", "completed_shards", "completed_cases", "shard_id")


def start_tracking(outcomes: DataFrame, root: str, **trigger: Any) -> StreamingQuery:
    """Start or resume the stream below ``root``: its checkpoint and its log of outcomes. A replayed batch replaces
    itself in the log, so each outcome is there once."""
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        outcomes.writeStream.outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .foreachBatch(lambda batch, batch_id: append_batch(batch, batch_id, f"{root}/log"))
        .start()
    )
