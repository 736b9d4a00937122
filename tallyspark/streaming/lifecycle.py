"""The lifecycle of sessions as state: what hooks observe and what workers report, one state row for each session.

Events may come twice, late and in any order. A session's state is the fold of
its different events (by key) in order of (at_ms, key), so whatever order they
come in, the state is that of `lifecycle` over the same events as a batch. The
stream keeps a session's events: one that comes in order is one step, one that
comes late folds the session anew. Events older than `keep_ms` before a
session's newest are folded into its base and dropped; what comes even later
counts as if it had come right after the base.

A generation counts what was observed. A worker's claim remembers it: if more is
observed while it works, its success leaves the session to a next revision. A
resumed session is the same session with a further revision.

Claims hold a lease, failures a time of retry or a park. When one of them falls
due nothing happens to a session, but it may be taken: a timer then gives its
row anew, with `eligible` set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass, fields
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyspark.operators.outcomes import PARKED, RETRY_MINUTES

from .tables import KeyedTable

EVENTS = "source string, session_id string, kind string, at_ms bigint, key string, path string, reason string, attempt string, lease_ms bigint, category string, retryable boolean, forced boolean"
#: Kinds of events that hooks give, and those that workers and operators report.
OBSERVED = ("agent-stop", "session-end")
REPORTED = ("claim", "success", "placeholder", "failure", "deferral", "accepted-loss", "retry")
#: States that may be claimed, completions that need a look, errors of a transcript that is gone.
CLAIMABLE = ("summary-pending", "revision-pending", "interrupted", "failed")
UNFINISHED = ("interrupted", "unknown")
GONE = ("source-missing", "source-failed")
#: How an end's reason is read; any other is unknown.
COMPLETION = {"complete": "complete", "user_exit": "interrupted"}
#: A park counts as many failures in a row.
PARK_STREAK = len(RETRY_MINUTES)


@dataclass
class Session:
    """A session's state; its methods are the transitions, each by one event."""

    lifecycle_state: str = "observed"
    generation: int = 0
    active: bool = False
    revision: int = 0
    last_agent_stop_ms: int | None = None
    last_session_end_ms: int | None = None
    transcript_path: str | None = None
    retry_state: str | None = None
    next_retry_at_ms: int | None = None
    last_error_category: str | None = None
    streak: int = 0
    streak_category: str | None = None
    streak_generation: int | None = None
    attempt: str | None = None
    attempt_generation: int | None = None
    lease_expires_at_ms: int | None = None
    not_archive_worthy_at_ms: int | None = None
    transcript_lost_at_ms: int | None = None
    updated_at_ms: int | None = None
    events: int = 0
    ignored: int = 0

    def take(self, event) -> None:
        """One event; a report that doesn't fit the state changes nothing and is counted as ignored."""
        self.events += 1
        step = getattr(self, "on_" + event.kind.replace("-", "_"), None) if event.kind in OBSERVED + REPORTED else None
        if step is None or step(event) is False:
            self.ignored += 1
        else:
            self.updated_at_ms = event.at_ms

    def _observe(self, state: str, active: bool) -> None:
        self.generation += 1
        self.active = active
        if self.lifecycle_state != "processing":
            self.lifecycle_state = "revision-pending" if self.revision > 0 else state

    def on_agent_stop(self, e) -> None:
        if self.last_agent_stop_ms is None or self.last_agent_stop_ms <= e.at_ms:
            self.transcript_path, self.last_agent_stop_ms = e.path, e.at_ms
        self._observe("observed", True)

    def on_session_end(self, e) -> None:
        self.last_session_end_ms = max(self.last_session_end_ms or e.at_ms, e.at_ms)
        self.transcript_path = self.transcript_path or e.path
        completion = COMPLETION.get(e.reason, "unknown")
        self._observe("interrupted" if completion in UNFINISHED else "summary-pending", False)
        self.retry_state = self.next_retry_at_ms = None
        self.last_error_category = None if self.transcript_path else "transcript-unresolved"

    def on_claim(self, e) -> bool | None:
        if self.lifecycle_state == "processing" and self.lease_expires_at_ms <= e.at_ms:
            self._drop("lease-expired")
        due = self.next_retry_at_ms is None or 0 <= self.next_retry_at_ms <= e.at_ms
        if self.active or self.lifecycle_state not in CLAIMABLE or (self.lifecycle_state == "failed" and not due and not e.forced):
            return False
        pending = "revision-pending" if self.revision > 0 else "summary-pending"
        self.retry_state = (self.retry_state or pending) if self.lifecycle_state == "failed" else self.lifecycle_state
        self.lifecycle_state = "processing"
        self.attempt, self.attempt_generation, self.lease_expires_at_ms = e.attempt, self.generation, e.at_ms + (e.lease_ms or 0)

    def _held(self, e) -> bool:
        """Whether the report is of the claim that holds the session; one that names no attempt is."""
        return self.lifecycle_state == "processing" and e.attempt in (None, self.attempt)

    def _release(self) -> None:
        self.attempt = self.attempt_generation = self.lease_expires_at_ms = None

    def _restart(self) -> None:
        self.streak, self.streak_category, self.streak_generation = 0, None, None

    def _drop(self, category: str | None) -> None:
        self.lifecycle_state, self.retry_state, self.next_retry_at_ms, self.last_error_category = self.retry_state, None, None, category
        self._release()

    def _count(self, category: str | None) -> int:
        same = (self.streak_category, self.streak_generation) == (category, self.attempt_generation)
        self.streak, self.streak_category, self.streak_generation = self.streak + 1 if same else 1, category, self.attempt_generation
        return self.streak

    def on_success(self, e) -> bool | None:
        if not self._held(e):
            return False
        self.revision += 1
        self.lifecycle_state = "archived" if self.generation == self.attempt_generation else "revision-pending"
        self.retry_state = self.next_retry_at_ms = self.last_error_category = None
        self._restart()
        self._release()

    def on_placeholder(self, e) -> bool | None:
        """The revision is kept, but the session still owes a real summary."""
        if not self._held(e):
            return False
        self.revision += 1
        self.streak = max(self._count(e.category), PARK_STREAK)
        self.lifecycle_state, self.retry_state, self.next_retry_at_ms, self.last_error_category = "failed", "revision-pending", PARKED, e.category
        self._release()

    def on_failure(self, e) -> bool | None:
        if not self._held(e):
            return False
        if e.category == "source-missing" and self.revision == 0:
            self.lifecycle_state, self.not_archive_worthy_at_ms = "observed", e.at_ms
            self.retry_state = self.next_retry_at_ms = self.last_error_category = None
            self._restart()
        else:
            streak = self._count(e.category)
            wait = PARKED if not e.retryable or streak >= PARK_STREAK else e.at_ms + RETRY_MINUTES[streak - 1] * 60_000
            self.lifecycle_state, self.next_retry_at_ms, self.last_error_category = "failed", wait, e.category
        self._release()

    def on_deferral(self, e) -> bool | None:
        if not self._held(e):
            return False
        self._drop(e.category)

    def on_accepted_loss(self, e) -> bool | None:
        if not (self.lifecycle_state == "failed" and self.parked and self.last_error_category in GONE and self.revision > 0):
            return False
        self.lifecycle_state, self.transcript_lost_at_ms = "observed", e.at_ms
        self.retry_state = self.next_retry_at_ms = self.last_error_category = None
        self._restart()

    def on_retry(self, e) -> bool | None:
        """A forced one makes any failed session due; another lifts the park of a streak only."""
        if self.lifecycle_state != "failed" or not (e.forced or (self.parked and self.streak >= PARK_STREAK)):
            return False
        self.next_retry_at_ms = None
        self._restart()

    @property
    def parked(self) -> bool:
        return self.next_retry_at_ms is not None and self.next_retry_at_ms < 0

    def due_at(self) -> int | None:
        """When a worker may take the session, if nothing more happens: 0 for at once, None for never."""
        if self.active or self.transcript_path is None:
            return None
        if self.lifecycle_state == "processing":
            return self.lease_expires_at_ms
        if self.lifecycle_state == "failed":
            return None if self.parked else self.next_retry_at_ms or 0
        return 0 if self.lifecycle_state in CLAIMABLE else None


_TYPES = {"int": "bigint", "int | None": "bigint", "bool": "boolean", "str": "string", "str | None": "string"}
STATE = ", ".join(f"{f.name} {_TYPES[f.type]}" for f in fields(Session))
_ROW_FIELDS = ["source", "session_id", *(f.name for f in fields(Session)), "due_at_ms"]
ROWS = f"source string, session_id string, {STATE}, due_at_ms bigint"


def _ordered(events) -> list:
    return sorted(events, key=lambda e: (e.at_ms, e.key))


# ---- batch


def folds(keys: tuple[str, ...], start: Callable[[], Any], row: Callable[[Any], tuple], columns: list[str]):
    """Rows by key, each key's in order of (at_ms, key) -> one row a key: its columns and `row` of the state that has taken its events; only one key's state is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, seen = None, None, None
        for frame in frames:
            out = []
            for e in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                own = tuple(getattr(e, k) for k in keys)
                if own != now:
                    if now is not None:
                        out.append((*now, *row(state)))
                    now, state, seen = own, start(), None
                if (e.at_ms, e.key) != seen:
                    state.take(e)
                seen = (e.at_ms, e.key)
            yield pd.DataFrame(out, columns=columns).astype(object)
        if now is not None:
            yield pd.DataFrame([(*now, *row(state))], columns=columns).astype(object)

    return run


def lifecycle(events: DataFrame) -> DataFrame:
    """ROWS of EVENTS. A key stands for one event: it has the same time whenever it is given.

    Transitions depend on the state before, so a session's events are one task's
    work; they stream through it in order, nothing of them is gathered. Events
    without session, kind or time are left out; no events give no rows.
    """
    rows = _usable(events).repartition("source", "session_id").sortWithinPartitions("source", "session_id", "at_ms", "key")
    return rows.mapInPandas(folds(("source", "session_id"), Session, lambda s: (*astuple(s), s.due_at()), _ROW_FIELDS), ROWS)


def _usable(events: DataFrame) -> DataFrame:
    have = {f.name for f in events.schema}
    columns = [F.col(n).cast(t) if n in have else F.lit(None).cast(t) for n, t in (x.split(" ") for x in EVENTS.split(", "))]
    named = events.select(*(c.alias(x.split(" ")[0]) for c, x in zip(columns, EVENTS.split(", "), strict=True)))
    named = named.withColumn("source", F.coalesce("source", F.lit("")))
    return named.where("session_id is not null and kind is not null and at_ms is not null and key is not null")


def eligible(states: DataFrame, now_ms: int) -> DataFrame:
    """Sessions a worker may take now, those due longest first."""
    return states.where(F.col("due_at_ms") <= now_ms).orderBy("due_at_ms", "source", "session_id")


def parked_sessions(states: DataFrame) -> DataFrame:
    """Parked sessions by their error, with the longest streak and what they had archived."""
    parked = states.where((F.col("lifecycle_state") == "failed") & (F.col("next_retry_at_ms") < 0))
    by = parked.groupBy(F.coalesce("last_error_category", F.lit("(none)")).alias("category"))
    return by.agg(F.count("*").alias("parked"), F.max("streak").alias("longest_streak"), F.sum("revision").alias("revisions"))


# ---- stream

_EVENT_FIELDS = [x.split(" ")[0] for x in EVENTS.split(", ")][2:]


class _Event:
    __slots__ = _EVENT_FIELDS

    def __init__(self, values):
        for name, value in zip(_EVENT_FIELDS, values, strict=True):
            setattr(self, name, value)

    def values(self) -> tuple:
        return tuple(getattr(self, n) for n in _EVENT_FIELDS)


class Sessions(StatefulProcessor):
    """Each session's events, base and folded state; a timer where a lease or a wait runs."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getMapState("events", "key string", ", ".join(EVENTS.split(", ")[2:]))
        self.base = handle.getValueState("base", STATE + ", order_ms bigint, order_key string")
        self.now = handle.getValueState("now", STATE + ", order_ms bigint, order_key string")

    def close(self) -> None:
        pass

    @staticmethod
    def _read(value) -> tuple[Session, tuple[int, str]]:
        if not value.exists():
            return Session(), (-(1 << 62), "")
        row = value.get()
        return Session(*row[:-2]), (row[-2], row[-1])

    def _fold(self, new: list[_Event]) -> Session:
        state, last = self._read(self.now)
        if any((e.at_ms, e.key) < last for e in new):
            state, last = self._read(self.base)
            new = _ordered(_Event(v) for v in self.past.values())
        for e in _ordered(new):
            state.take(e)
            last = max(last, (e.at_ms, e.key))
        self.now.update((*astuple(state), *last))
        return state

    def _forget(self) -> None:
        """Old events go to the base."""
        limit = self._read(self.now)[1][0] - self.keep_ms
        old = [e for e in _ordered(_Event(v) for v in self.past.values()) if e.at_ms < limit]
        if old:
            state, last = self._read(self.base)
            for e in old:
                state.take(e)
                self.past.removeKey((e.key,))
                last = max(last, (e.at_ms, e.key))
            self.base.update((*astuple(state), *last))

    def _watch(self, due: int | None) -> None:
        """The one timer that the state needs."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if due:
            self.handle.registerTimer(due)

    @staticmethod
    def _frame(key, state: Session) -> pd.DataFrame:
        return pd.DataFrame([(*key, *astuple(state), state.due_at())], columns=_ROW_FIELDS).astype(object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = {}
        for frame in rows:
            for row in frame.astype(object).where(frame.notna(), None)[_EVENT_FIELDS].itertuples(index=False):
                e = _Event(tuple(row))
                if e.key not in new and not self.past.containsKey((e.key,)):
                    new[e.key] = e
        if new:
            for e in new.values():
                self.past.updateValue((e.key,), e.values())
            state = self._fold(list(new.values()))
            if self.keep_ms is not None:
                self._forget()
            self._watch(state.due_at())
            yield self._frame(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The lease or the wait is over: the row is given again, for whoever takes what is due."""
        yield self._frame(key, self._read(self.now)[0])


def states(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A stream of ROWS in update mode: a session's row whenever its state changed or it fell due.

    Needs the RocksDB state store. Session and time must be there, as in `lifecycle`.
    """
    rows = _usable(events).groupBy("source", "session_id")
    return rows.transformWithStateInPandas(Sessions(keep_ms), ROWS, "Update", "ProcessingTime")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the folder's JSON files, one event of EVENTS a line."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 100).json(folder)


def keep_states(events: DataFrame, table: KeyedTable, checkpoint: str, keep_ms: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Runs `states` into a table of one row a session.

    trigger as DataStreamWriter's, to go on for ever; batches without data then
    serve the timers. Without one the query ends when it has read what is there:
    it runs no batches without data, of which there would be no end.
    """
    writer = states(events, keep_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(table.merge)
    if trigger is not None:
        return writer.trigger(**trigger).start()
    conf, name = events.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, was)
