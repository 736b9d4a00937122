"""Queries of the lifecycle, each with its DuckDB oracle: the transitions as a recursive query, an event of each session at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyspark.operators import outcomes
from tallyspark.streaming import lifecycle

from .catalog import NOW_MS, query
from .views import with_views

_CLAIMABLE = ", ".join(f"'{x}'" for x in lifecycle.CLAIMABLE)
_GONE = ", ".join(f"'{x}'" for x in lifecycle.GONE)
_MINUTES = ", ".join(str(x) for x in outcomes.RETRY_MINUTES)

#: column: (its first value, what follows it; an event is e, a state without prefix)
_COLUMNS = {
    "lifecycle_state": (
        "'observed'",
        f"""CASE WHEN NOT ok THEN st WHEN kind = 'agent-stop' THEN CASE WHEN st = 'processing' THEN st WHEN revision > 0 THEN 'revision-pending' ELSE 'observed' END
        WHEN kind = 'session-end' THEN CASE WHEN st = 'processing' THEN st WHEN revision > 0 THEN 'revision-pending' WHEN reason = 'complete' THEN 'summary-pending' ELSE 'interrupted' END
        WHEN kind = 'claim' THEN 'processing' WHEN kind = 'success' THEN CASE WHEN generation = attempt_generation THEN 'archived' ELSE 'revision-pending' END
        WHEN kind = 'deferral' THEN retry_state WHEN unworthy OR kind = 'accepted-loss' THEN 'observed' WHEN kind IN ('failure', 'placeholder') THEN 'failed' ELSE st END""",
    ),
    "generation": ("0", "generation + CASE WHEN kind IN ('agent-stop', 'session-end') THEN 1 ELSE 0 END"),
    "active": ("false", "CASE kind WHEN 'agent-stop' THEN true WHEN 'session-end' THEN false ELSE active END"),
    "revision": ("0", "revision + CASE WHEN ok AND kind IN ('success', 'placeholder') THEN 1 ELSE 0 END"),
    "last_agent_stop_ms": ("NULL::BIGINT", "CASE WHEN kind = 'agent-stop' THEN greatest(coalesce(last_agent_stop_ms, at_ms), at_ms) ELSE last_agent_stop_ms END"),
    "last_session_end_ms": ("NULL::BIGINT", "CASE WHEN kind = 'session-end' THEN greatest(coalesce(last_session_end_ms, at_ms), at_ms) ELSE last_session_end_ms END"),
    "transcript_path": ("NULL::VARCHAR", "new_path"),
    "retry_state": (
        "NULL::VARCHAR",
        f"""CASE WHEN NOT ok THEN rs WHEN kind IN ('session-end', 'success', 'deferral', 'accepted-loss') OR unworthy THEN NULL WHEN kind = 'placeholder' THEN 'revision-pending'
        WHEN kind = 'claim' THEN CASE WHEN st = 'failed' THEN coalesce(rs, CASE WHEN revision > 0 THEN 'revision-pending' ELSE 'summary-pending' END) ELSE st END ELSE rs END""",
    ),
    "next_retry_at_ms": (
        "NULL::BIGINT",
        f"""CASE WHEN NOT ok THEN nr WHEN kind IN ('session-end', 'success', 'deferral', 'accepted-loss', 'retry') OR unworthy THEN NULL WHEN kind = 'placeholder' THEN -1
        WHEN kind = 'failure' THEN CASE WHEN NOT coalesce(retryable, false) OR counted >= {lifecycle.PARK_STREAK} THEN -1 ELSE at_ms + 60000 * ([{_MINUTES}])[counted] END ELSE nr END""",
    ),
    "last_error_category": (
        "NULL::VARCHAR",
        "CASE WHEN NOT ok THEN er WHEN kind = 'session-end' THEN CASE WHEN new_path IS NULL THEN 'transcript-unresolved' END WHEN kind IN ('success', 'accepted-loss') OR unworthy THEN NULL WHEN kind IN ('placeholder', 'failure', 'deferral') THEN category ELSE er END",
    ),
    "streak": ("0", f"CASE WHEN NOT ok THEN streak WHEN kind IN ('success', 'accepted-loss', 'retry') OR unworthy THEN 0 WHEN kind = 'failure' THEN counted WHEN kind = 'placeholder' THEN greatest(counted, {lifecycle.PARK_STREAK}) ELSE streak END"),
    "streak_category": ("NULL::VARCHAR", "CASE WHEN NOT ok THEN streak_category WHEN kind IN ('success', 'accepted-loss', 'retry') OR unworthy THEN NULL WHEN kind IN ('failure', 'placeholder') THEN category ELSE streak_category END"),
    "streak_generation": ("NULL::BIGINT", "CASE WHEN NOT ok THEN streak_generation WHEN kind IN ('success', 'accepted-loss', 'retry') OR unworthy THEN NULL WHEN kind IN ('failure', 'placeholder') THEN attempt_generation ELSE streak_generation END"),
    "attempt": ("NULL::VARCHAR", "CASE WHEN ok AND kind = 'claim' THEN said_attempt WHEN released THEN NULL ELSE attempt END"),
    "attempt_generation": ("NULL::BIGINT", "CASE WHEN ok AND kind = 'claim' THEN generation WHEN released THEN NULL ELSE attempt_generation END"),
    "lease_expires_at_ms": ("NULL::BIGINT", "CASE WHEN ok AND kind = 'claim' THEN at_ms + coalesce(lease_ms, 0) WHEN released THEN NULL ELSE lease_expires_at_ms END"),
    "not_archive_worthy_at_ms": ("NULL::BIGINT", "CASE WHEN unworthy THEN at_ms ELSE not_archive_worthy_at_ms END"),
    "transcript_lost_at_ms": ("NULL::BIGINT", "CASE WHEN ok AND kind = 'accepted-loss' THEN at_ms ELSE transcript_lost_at_ms END"),
    "updated_at_ms": ("NULL::BIGINT", "CASE WHEN ok THEN at_ms ELSE updated_at_ms END"),
    "events": ("0", "events + 1"),
    "ignored": ("0", "ignored + CASE WHEN ok THEN 0 ELSE 1 END"),
}


def _typed(first: str) -> str:
    return f"{first}::BIGINT" if first == "0" else first


_STATES = f"""WITH RECURSIVE views AS (SELECT 1), {with_views('', 'session_events').strip().removeprefix('WITH ')},
happened AS (SELECT *, row_number() OVER (PARTITION BY source, session_id ORDER BY at_ms, key) AS i FROM v_session_events),
fold AS (
  SELECT source, session_id, 0::BIGINT AS i, {', '.join(f'{_typed(first)} AS {name}' for name, (first, _) in _COLUMNS.items())} FROM (SELECT DISTINCT source, session_id FROM happened)
  UNION ALL
  SELECT source, session_id, i, {', '.join(f'{then} AS {name}' for name, (_, then) in _COLUMNS.items())}
  FROM (SELECT *, coalesce(ok AND kind = 'failure' AND category = 'source-missing' AND revision = 0, false) AS unworthy, expired OR (ok AND kind IN ('success', 'placeholder', 'failure', 'deferral')) AS released,
      CASE WHEN streak_category IS NOT DISTINCT FROM category AND streak_generation IS NOT DISTINCT FROM attempt_generation THEN streak + 1 ELSE 1 END AS counted
    FROM (SELECT *, coalesce(CASE WHEN kind IN ('agent-stop', 'session-end') THEN true
        WHEN kind = 'claim' THEN NOT active AND st IN ({_CLAIMABLE}) AND (st <> 'failed' OR nr IS NULL OR nr BETWEEN 0 AND at_ms OR forced)
        WHEN kind IN ('success', 'placeholder', 'failure', 'deferral') THEN st = 'processing' AND (said_attempt IS NULL OR said_attempt = attempt)
        WHEN kind = 'accepted-loss' THEN st = 'failed' AND nr < 0 AND er IN ({_GONE}) AND revision > 0
        WHEN kind = 'retry' THEN st = 'failed' AND (forced OR (nr < 0 AND streak >= {lifecycle.PARK_STREAK})) END, false) AS ok
      FROM (SELECT *, CASE WHEN expired THEN retry_state ELSE lifecycle_state END AS st, CASE WHEN NOT expired THEN retry_state END AS rs, CASE WHEN NOT expired THEN next_retry_at_ms END AS nr, CASE WHEN expired THEN 'lease-expired' ELSE last_error_category END AS er
        FROM (SELECT f.* EXCLUDE (i), e.i, e.kind, e.at_ms, e.reason, e.attempt AS said_attempt, e.lease_ms, e.category, e.retryable, e.forced,
            CASE WHEN e.kind = 'agent-stop' AND coalesce(f.last_agent_stop_ms <= e.at_ms, true) THEN e.path WHEN e.kind = 'session-end' THEN coalesce(nullif(f.transcript_path, ''), e.path) ELSE f.transcript_path END AS new_path,
            coalesce(e.kind = 'claim' AND f.lifecycle_state = 'processing' AND f.lease_expires_at_ms <= e.at_ms, false) AS expired
          FROM fold f JOIN happened e ON e.source = f.source AND e.session_id = f.session_id AND e.i = f.i + 1)))))
, states AS (SELECT *, CASE WHEN active OR transcript_path IS NULL THEN NULL WHEN lifecycle_state = 'processing' THEN lease_expires_at_ms WHEN lifecycle_state = 'failed' THEN CASE WHEN next_retry_at_ms < 0 THEN NULL ELSE coalesce(next_retry_at_ms, 0) END WHEN lifecycle_state IN ({_CLAIMABLE}) THEN 0 END AS due_at_ms
  FROM fold QUALIFY row_number() OVER (PARTITION BY source, session_id ORDER BY i DESC) = 1)"""


def _over_states(name: str, sql: str):
    def add(f):
        from . import catalog

        query(name, None, "session_events")(f)
        catalog.ORACLE[name] = f"{_STATES} {sql}"
        return f

    return add


@_over_states("r04_lifecycle", f"SELECT source, session_id, {', '.join(_COLUMNS)}, due_at_ms FROM states")
def _(e: DataFrame) -> DataFrame:
    return lifecycle.lifecycle(e)


@_over_states("r06_due_sessions", f"SELECT session_id, lifecycle_state, due_at_ms FROM states WHERE due_at_ms <= {NOW_MS}")
def _(e: DataFrame) -> DataFrame:
    return lifecycle.eligible(lifecycle.lifecycle(e), NOW_MS).select("session_id", "lifecycle_state", "due_at_ms")


@_over_states(
    "r14_parked_sessions",
    "SELECT coalesce(last_error_category, '(none)') AS category, count(*)::BIGINT AS parked, max(streak)::BIGINT AS longest_streak, sum(revision)::BIGINT AS revisions FROM states WHERE lifecycle_state = 'failed' AND next_retry_at_ms < 0 GROUP BY 1",
)
def _(e: DataFrame) -> DataFrame:
    return lifecycle.parked_sessions(lifecycle.lifecycle(e))
