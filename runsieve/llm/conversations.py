"""Repair the turn structure of conversations by a cheapest edit path."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsieve.llm.common import BLANKS, ship

ship(__name__)

#: Costs of the edits; keeping a row is free.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bytes of backpointers of a conversation that stay in memory; more go to a file of the task.
SPILL_BYTES = 1 << 20

# Places in a conversation that reads "", "ua ua ..." or "s ua ua ...": nothing yet, after the system row, after a
# user row, after an assistant row.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES, _ENDS = range(4), (_EMPTY, _ASSISTANT)
#: The place after one more user or assistant row, and that row's role.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")
#: The place after a row that is kept, by place and initial of its role.
_KEEP = {(_EMPTY, "s"): _SYSTEM, (_EMPTY, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_LEGAL = ("su", "ua", "au")
_EDITS = "DIKR"

_COUNTS = ["rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_NAMES = ["_key", *_COUNTS, "audit", "repaired_sha256"]
_SCHEMA = ", ".join(["_key string", *[f"{c} bigint" for c in _COUNTS], "audit string", "repaired_sha256 string"])


class Path:
    """The cheapest way to one place: its cost and the digest of the repaired rows so far."""

    __slots__ = ("cost", "digest", "rows")

    def __init__(self, cost: int, digest, rows: int) -> None:
        self.cost, self.digest, self.rows = cost, digest, rows

    def after(self, cost: int, lines: list[str]) -> Path:
        if not lines:
            return Path(cost, self.digest, self.rows)
        digest = self.digest.copy()
        digest.update((("\n" if self.rows else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return Path(cost, digest, self.rows + len(lines))


class Repair:
    """Finds a conversation's edits while its rows pass by once, in order.

    Held are, for each of the four places, the cheapest path that ends there with the last row, and the
    order of these paths by their edits. No two of them are equal or one the beginning of another, since
    each ends with an edit of the same row; so the order of two longer paths is that of the paths they
    extend, and only ways out of one place need a look at their letters. Which way each place was reached
    goes to the backpointers, two bytes a place and row.
    """

    def __init__(self, spill_bytes: int = SPILL_BYTES) -> None:
        self.paths: dict[int, Path] = {_EMPTY: Path(0, hashlib.sha256(), 0)}
        self.order = {_EMPTY: 0}
        self.back = tempfile.SpooledTemporaryFile(max_size=spill_bytes)
        self.n = 0

    def _ways(self):
        """Each place with the rows inserted to leave it: up to two, after which it repeats."""
        for place, path in self.paths.items():
            lines, cost, here = [], path.cost, place
            for inserts in range(3):
                yield place, path, inserts, here, cost, lines
                lines, cost, here = [*lines, _ROLE[here] + ":"], cost + INSERT, _NEXT[here]

    def row(self, role: str, text: str, unusable: bool, truncated: bool) -> None:
        """``unusable`` rows, blank or repeated, can only be deleted."""
        initial, extra = role[:1], TRUNCATED if truncated else 0
        found: dict[int, tuple] = {}
        for place, path, inserts, here, cost, lines in self._ways():
            edits = [("D", here, cost + DELETE, lines)]
            if not unusable:
                kept = _KEEP.get((here, initial))
                if kept is not None:
                    edits.append(("K", kept, cost + extra, [*lines, f"{role}:{text}"]))
                edits.append(("R", _NEXT[here], cost + REROLE + extra, [*lines, f"{_ROLE[here]}:{text}"]))
            for letter, to, total, out in edits:
                key = (total, self.order[place], "I" * inserts + letter)
                if to not in found or key < found[to][0]:
                    found[to] = (key, place, inserts, letter, path, out)
        ranks = sorted(found, key=lambda to: found[to][0][1:])
        back = bytearray(8)
        for to, (_, place, inserts, letter, _, _) in found.items():
            back[2 * to], back[2 * to + 1] = place, inserts * 4 + _EDITS.index(letter)
        self.back.write(back)
        self.paths = {to: f[4].after(f[0][0], f[5]) for to, f in found.items()}
        self.order = {to: i for i, to in enumerate(ranks)}
        self.n += 1

    def finish(self) -> tuple[int, str, str]:
        """Cost, edits and digest of the cheapest repair, of equal ones that with the least letters."""
        best = None
        for place, path, inserts, here, cost, lines in self._ways():
            key = (cost, self.order[place], "I" * inserts)
            if here in _ENDS and (best is None or key < best[0]):
                best = (key, place, path.after(cost, lines), "I" * inserts)
        _, place, path, tail = best
        parts, here = [tail], place
        block = 1 << 16
        for end in range(self.n, 0, -block):
            lo = max(0, end - block)
            self.back.seek(8 * lo)
            data = self.back.read(8 * (end - lo))
            for i in range(end - lo - 1, -1, -1):
                code = data[8 * i + 2 * here + 1]
                parts.append("I" * (code >> 2) + _EDITS[code & 3])
                here = data[8 * i + 2 * here]
        self.back.close()
        return path.cost, "".join(reversed(parts)), path.digest.hexdigest()


class Conversation:
    """Faults and repair of the rows of one conversation in order."""

    def __init__(self, spill_bytes: int) -> None:
        self.repair = Repair(spill_bytes)
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = self.initial = None

    def row(self, turn, role: str, text: str, fault: int, first_turn) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.rows and self.initial + role[:1] not in _LEGAL:
            self.illegal += 1
        # Equal rows of one turn are neighbours, those of other turns come after the first turn of their kind.
        seen = first_turn != turn or self.before == (turn, role, text)
        blank, repeated = fault == 1, fault != 1 and seen
        cut = fault == 2 and not repeated
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + repeated, self.truncated + cut
        self.repair.row(role, text, blank or repeated, cut)
        self.before, self.initial, self.rows = (turn, role, text), role[:1], self.rows + 1

    def result(self) -> tuple:
        cost, audit, digest = self.repair.finish()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.rows, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


def _stream(spill_bytes: int, batch_rows: int = 2_000):
    """Turns come as numbers beside a flag that they are known, since pandas has no long with nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, done = None, None, []
        for batch in batches:
            columns = [batch[c].tolist() for c in ("_key", "turn", "_known", "role", "text", "_fault", "_first", "_first_known", "_marker")]
            for k, turn, known, role, text, fault, first, first_known, marker in zip(*columns):
                if k != key:
                    if held is not None:
                        done.append((key, *held.result()))
                    key, held = k, Conversation(spill_bytes)
                if not marker:
                    held.row(turn if known else None, role, text, fault, first if first_known else None)
            if len(done) >= batch_rows:
                yield pd.DataFrame(done, columns=_NAMES)
                done = []
        if held is not None:
            done.append((key, *held.result()))
        if done:
            yield pd.DataFrame(done, columns=_NAMES)

    return run


def _key(conversations: DataFrame) -> Column:
    """The conversation as text: a null id is ``-``."""
    return F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))


def _id(conversations: DataFrame) -> Column:
    return F.when(F.col("_key") != "-", F.substring("_key", 2, 1 << 30)).cast(conversations.schema["conv_id"].dataType).alias("conv_id")


def fault_of(text: Column) -> Column:
    """1 blank, 2 truncated (its last character that is no blank ends no sentence), 0 neither."""
    bare = F.rtrim(text, F.lit(BLANKS))
    return F.when(bare == "", 1).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)


def repair(conversations: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """Per conversation ``rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``audit`` has the initials of the cheapest edits that make the role initials read ``(s?(ua)+)?``: Keep,
    Rerole to user or assistant, Delete, Insert of an empty row; of equal costs the least in ASCII order.
    ``repaired_sha256`` is the digest of the repaired rows as ``role:text``, newline-joined;
    ``repaired_turns`` gives the rows.

    Rows are dealt by conversation, sorted by turn (nulls first; equal turns by role and text) and pass a
    task as a stream: the state of the search is carried from batch to batch, its backpointers go to a file of
    the task beyond ``spill_bytes``. So a conversation of any length needs a bounded amount of memory; its rows
    are one task's, since edits depend on all earlier ones. Repeats of a row anywhere in a conversation are
    found beforehand by a partial aggregate over digests, dealt without regard to the conversation.

    A null role or text is one space, rows with a null id are one conversation. Where the column ``dropped``
    is true a row only names its conversation; a conversation without other rows has no edits and the digest of
    the empty string. Repeated rows are rows; extra columns are ignored. An empty table gives an empty result.
    """
    marker = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in conversations.columns else F.lit(False)
    rows = conversations.select(
        _key(conversations).alias("_key"),
        F.when(~marker, F.col("turn").cast("bigint")).alias("_turn"),
        F.when(~marker, F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(~marker, F.coalesce("text", F.lit(" "))).alias("text"),
        marker.alias("_marker"),
    )
    same = F.unhex(F.md5(F.concat_ws(":", "_key", F.length("role").cast("string"), "role", "text")))
    rows = rows.withColumns({"_same": F.when(~F.col("_marker"), same), "_fault": fault_of(F.col("text"))})
    # Only rows of a kind that occurs more than once need the first turn of the kind.
    turn = F.struct(F.col("_turn").isNotNull().alias("known"), F.col("_turn").alias("turn"))
    kinds = rows.filter("NOT _marker").groupBy("_same").agg(F.min(turn).alias("t"), F.count("*").alias("m"))
    kinds = kinds.filter("m > 1").select("_same", F.col("t.turn").alias("_again"), F.lit(True).alias("_often"))
    rows = rows.join(kinds, "_same", "left").withColumn("_again", F.when(F.col("_often"), F.col("_again")).otherwise(F.col("_turn")))
    zero = F.lit(0).cast("bigint")
    dealt = rows.repartition("_key").sortWithinPartitions("_key", F.asc_nulls_first("_turn"), "role", "text").select(
        "_key", F.coalesce("_turn", zero).alias("turn"), F.col("_turn").isNotNull().alias("_known"), "role", "text", F.coalesce("_fault", F.lit(0)).alias("_fault"),
        F.coalesce("_again", zero).alias("_first"), F.col("_again").isNotNull().alias("_first_known"), "_marker",
    )
    found = dealt.mapInPandas(_stream(spill_bytes), _SCHEMA)
    return found.select(_id(conversations), *_NAMES[1:])


def _applied():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, at, place, state = "", 0, 0, _EMPTY
        for batch in batches:
            out: list[tuple] = []
            for key, plan, role, text in zip(*(batch[c].tolist() for c in ("_key", "_audit", "role", "text"))):
                if isinstance(plan, str):
                    # The plan comes before the rows of its conversation.
                    audit, at, place, state = plan, 0, 0, _EMPTY
                else:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        role = _ROLE[state] if edit == "R" else role
                        state = _NEXT[state] if edit == "R" else _KEEP[(state, role[:1])]
                        out.append((key, place, edit, role, text))
                        place += 1
                while at < len(audit) and audit[at] == "I":
                    out.append((key, place, "I", _ROLE[state], ""))
                    at, place, state = at + 1, place + 1, _NEXT[state]
            yield pd.DataFrame(out, columns=["_key", "turn", "edit", "role", "text"])

    return run


def repaired_turns(conversations: DataFrame, repairs: DataFrame) -> DataFrame:
    """``conv_id, turn, edit, role, text``: the rows that ``repairs`` (of ``repair``) leave, turns from 0.

    Plans and rows meet in the secondary sort; a task holds one plan and one batch at a time. Null columns and
    ``dropped`` count as in ``repair``; an empty table gives an empty result.
    """
    live = conversations.filter(~F.coalesce(F.col("dropped"), F.lit(False))) if "dropped" in conversations.columns else conversations
    rows = live.select(
        _key(live).alias("_key"), F.lit(None).cast("string").alias("_audit"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    none = F.lit(None)
    plans = repairs.select(
        _key(repairs).alias("_key"), F.col("audit").alias("_audit"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text")
    )
    both = rows.unionAll(plans).repartition("_key").sortWithinPartitions("_key", F.col("_audit").isNull(), F.asc_nulls_first("turn"), "role", "text")
    applied = both.select("_key", "_audit", "role", "text").mapInPandas(_applied(), "_key string, turn bigint, edit string, role string, text string")
    return applied.select(_id(conversations), "turn", "edit", "role", "text")
