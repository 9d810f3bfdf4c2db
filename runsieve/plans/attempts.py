"""Attempts of queued messages: failures counted once, delayed retries, quarantine beyond a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.operators.ranking import with_position
from runsieve.operators.verdicts import error_classes
from runsieve.schemas import JOB_MAX_RECEIVES
from runsieve.sources.keyed import KeyedTable

MESSAGE = "message_id"
#: One row per receipt of a message: when it ended, whether well, and what went wrong.
ATTEMPT = "message_id string, receipt string, ended_at timestamp, ok boolean, code string, error string"
_ORDER = ["ended_at", "ok", "code", "error"]
#: Seconds until a message that failed once is due again; each further failure doubles them up to the longest wait.
FIRST_WAIT, LONGEST_WAIT = 60, 3600


def attempt_ledger(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The stored ledger below ``path``; its key is (message, receipt), so a replayed receipt counts once."""
    return KeyedTable(spark, path, ATTEMPT, (MESSAGE, "receipt"), (MESSAGE,), buckets=buckets)


def record(ledger: KeyedTable, attempts: DataFrame, writer: str, batch_id: int) -> int:
    """Add a batch of attempts; a batch that the writer has added already is skipped. Rows without a message or
    receipt are no attempt. Of one receipt told twice in a batch the later end counts, then success."""
    known = attempts.filter(F.col(MESSAGE).isNotNull() & F.col("receipt").isNotNull())
    return ledger.upsert(known, _ORDER, writer, batch_id)


def message_states(attempts: DataFrame, as_of: Column, limit: int = JOB_MAX_RECEIVES, stop_at_final: bool = False) -> DataFrame:
    """Per message its failures, last error, ``due_at`` and state.

    ``done``: some attempt ended well. ``quarantined``: ``limit`` failures, or with ``stop_at_final`` one whose
    code is not worth a retry. ``due``: its wait is over at ``as_of``; ``waiting``: it is not, or its end is not known.
    One partial aggregate, so a message with any number of attempts is no hot task.
    """
    rows = error_classes(attempts).withColumn("_failed", ~F.coalesce("ok", F.lit(False)))
    failed = F.col("_failed")
    per = rows.groupBy(MESSAGE).agg(
        F.count_if(failed).alias("failures"),
        F.bool_or(~failed).alias("_done"),
        F.bool_or(failed & ~F.coalesce("retryable", F.lit(False))).alias("_final"),
        F.max(F.when(failed, F.col("ended_at"))).alias("_last"),
        F.max(F.when(failed, F.struct("ended_at", "receipt", "error"))).alias("_end"),
    )
    wait = F.least(F.lit(LONGEST_WAIT).cast("double"), FIRST_WAIT * F.pow(F.lit(2.0), F.col("failures") - 1))
    over = (F.col("failures") >= limit) | (F.col("_final") if stop_at_final else F.lit(False))
    due_at = F.timestamp_seconds(F.unix_timestamp("_last") + wait.cast("bigint"))
    state = F.when(F.col("_done"), "done").when(over, "quarantined").when(F.col("due_at") <= as_of, "due").otherwise("waiting")
    told = per.withColumn("due_at", F.when(~F.col("_done") & ~over, due_at)).withColumn("state", state)
    return told.select(MESSAGE, "failures", F.col("_end.error").alias("last_error"), "due_at", "state")


def due_messages(messages: DataFrame, states: DataFrame) -> DataFrame:
    """The messages that re-enter the queue, with the number of the attempt that they start."""
    due = states.filter("state = 'due'").select(MESSAGE, (F.col("failures") + 1).alias("attempt"))
    return messages.join(due, MESSAGE)


def quarantine(attempts: DataFrame, states: DataFrame) -> DataFrame:
    """All failures of quarantined messages, one row each and numbered from 1 in order of their ends."""
    held = states.filter("state = 'quarantined'").select(MESSAGE)
    failed = attempts.filter(~F.coalesce("ok", F.lit(False))).join(held, MESSAGE)
    numbered = with_position(failed, [MESSAGE], ["ended_at", "receipt"], "attempt")
    return numbered.select(MESSAGE, (F.col("attempt") + 1).alias("attempt"), "receipt", "ended_at", "code", "error")
