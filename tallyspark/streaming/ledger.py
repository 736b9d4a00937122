"""The ledger of a sink, and commits in two phases.

A delivery's state is the fold of what happened to it, in order. A commit takes
effect only if what was persisted is what was planned, once for each revision;
a batch that runs again changes nothing.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import folds
from .tables import KeyedTable

#: Failures after which a delivery is given up, a first wait and the longest one.
MOST_ATTEMPTS, FIRST_WAIT_MS, LONGEST_WAIT_MS = 5, 60_000, 3_600_000
KINDS = ("queue", "success", "failure", "blocked", "retry")
KEYS = ("session_id", "endpoint")
EVENTS = "session_id string, endpoint string, kind string, at_ms bigint, key string, revision bigint, hash string, category string, forced boolean"


def wait_ms(attempts: int) -> int:
    return min(FIRST_WAIT_MS << min(max(attempts - 1, 0), 16), LONGEST_WAIT_MS)


@dataclass
class Delivery:
    delivery_state: str = "pending"
    attempts: int = 0
    next_attempt_at_ms: int | None = None
    last_error_category: str | None = None
    delivered_revision: int | None = None
    delivered_hash: str | None = None
    updated_at_ms: int | None = None

    def take(self, e) -> None:
        """One event; an unknown kind, and a retry that isn't forced of one given up, change nothing."""
        if e.kind == "queue":
            self.delivery_state, self.next_attempt_at_ms = "pending", None
        elif e.kind == "success":
            self.delivery_state, self.attempts, self.next_attempt_at_ms, self.last_error_category = "delivered", 0, None, None
            self.delivered_revision, self.delivered_hash = e.revision, e.hash
        elif e.kind == "failure":
            self.attempts += 1
            over = self.attempts >= MOST_ATTEMPTS
            self.delivery_state, self.next_attempt_at_ms = ("dead-letter", None) if over else ("failed", e.at_ms + wait_ms(self.attempts))
            self.last_error_category = e.category
        elif e.kind == "blocked":
            # a gate, not a failure: attempts stay as they are
            self.delivery_state, self.next_attempt_at_ms, self.last_error_category = "blocked", None, e.category
        elif e.kind == "retry" and (e.forced or self.delivery_state != "dead-letter"):
            self.delivery_state, self.next_attempt_at_ms, self.attempts = "pending", None, 0 if e.forced else self.attempts
        else:
            return
        self.updated_at_ms = e.at_ms


_TYPES = {"int": "bigint", "int | None": "bigint", "str": "string", "str | None": "string"}
_STATE = [f.name for f in fields(Delivery)]
LEDGER = f"session_id string, endpoint string, {', '.join(f'{f.name} {_TYPES[f.type]}' for f in fields(Delivery))}"


def ledger(events: DataFrame) -> DataFrame:
    """LEDGER of EVENTS: one row for each session and endpoint.

    What an event does depends on the state before, so one delivery's events are
    one task's work, streamed in order of (at_ms, key); a key counts once. Events
    without kind, time or key are left out; a null endpoint is one like another.
    """
    names = [x.split(" ")[0] for x in EVENTS.split(", ")]
    rows = events.select(*names).where("kind is not null and at_ms is not null and key is not null").repartition(*KEYS).sortWithinPartitions(*KEYS, "at_ms", "key")
    return rows.mapInPandas(folds(KEYS, Delivery, astuple, [*KEYS, *_STATE]), LEDGER)


def open_deliveries(rows: DataFrame, now_ms: int) -> DataFrame:
    """Deliveries that may be tried now, those due longest first."""
    due = F.col("delivery_state").isin("pending", "failed") & (F.coalesce("next_attempt_at_ms", F.lit(0)) <= now_ms)
    return rows.where(due).orderBy(F.coalesce("next_attempt_at_ms", F.lit(0)), *KEYS)


# ---- commits

#: The fields of a plan that what was persisted must repeat.
PLANNED = (
    "record_count bigint", "byte_offset bigint", "prefix_hash string", "source_hash string", "source_bytes bigint", "relative_path string", "markdown_hash string", "history boolean", "completion_reason string", "fallback_reason string",
)
COMMIT_KEYS = ("session_id", "revision")
#: A plan or what was persisted: of a session's revision, by an attempt.
PLAN = f"session_id string, revision bigint, attempt string, {', '.join(PLANNED)}"


def verdict(same: Column, planned: Column) -> Column:
    return F.when(~planned, "no-plan").when(same, "committed").otherwise("invalid")


def verified(persisted: DataFrame, plans: DataFrame) -> DataFrame:
    """PLAN's columns of what was persisted with a verdict: committed, invalid (a field differs from the plan; null equals null) or no-plan for that session, revision and attempt."""
    names = [x.split(" ")[0] for x in PLANNED]
    keys = (*COMMIT_KEYS, "attempt")
    # a plan that was made again counts as the larger one; replays give equal ones
    made = plans.groupBy(*keys).agg(F.max(F.struct(*names)).alias("plan"))
    rows = persisted.join(made, list(keys), "left")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"plan.{n}"))
    return rows.select(*keys, *names, verdict(same, F.col("plan").isNotNull()).alias("verdict"))


class Commits:
    """Plans, commits and what was turned away, as tables keyed by session and revision; its methods are for foreachBatch."""

    def __init__(self, plans: KeyedTable, commits: KeyedTable, rejected: KeyedTable):
        """The tables' rows are PLAN, PLAN and PLAN with a verdict."""
        self.plans, self.commits, self.rejected = plans, commits, rejected

    def plan(self, rows: DataFrame, batch: int) -> None:
        """The first phase: what an attempt is going to persist."""
        self.plans.merge(rows, batch)

    def commit(self, rows: DataFrame, batch: int) -> None:
        """The second: what it persisted. A revision that an earlier batch committed stays as it is and the later one is turned away as repeated; the same batch again writes the same rows."""
        before = self.commits.batches().where(F.col("batch") < batch).select(*COMMIT_KEYS).distinct().withColumn("there", F.lit(True))
        found = verified(rows, self.plans.read()).join(before, list(COMMIT_KEYS), "left")
        found = found.withColumn("verdict", F.when((F.col("verdict") == "committed") & F.col("there"), "repeated").otherwise(F.col("verdict"))).drop("there")
        found = found.persist()
        try:
            self.commits.merge(found.where("verdict = 'committed'").drop("verdict"), batch)
            self.rejected.merge(found.where("verdict <> 'committed'"), batch)
        finally:
            found.unpersist()
