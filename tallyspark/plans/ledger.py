"""Queries of the sink ledger and of commits, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.streaming import ledger

from . import catalog
from .catalog import NOW_MS, query
from .views import with_views

_COLUMNS = {
    "delivery_state": ("'pending'", f"CASE kind WHEN 'queue' THEN 'pending' WHEN 'success' THEN 'delivered' WHEN 'blocked' THEN 'blocked' WHEN 'failure' THEN CASE WHEN attempts + 1 >= {ledger.MOST_ATTEMPTS} THEN 'dead-letter' ELSE 'failed' END WHEN 'retry' THEN CASE WHEN lifted THEN 'pending' ELSE delivery_state END ELSE delivery_state END"),
    "attempts": ("0::BIGINT", "CASE kind WHEN 'success' THEN 0 WHEN 'failure' THEN attempts + 1 WHEN 'retry' THEN CASE WHEN forced THEN 0 ELSE attempts END ELSE attempts END"),
    "next_attempt_at_ms": ("NULL::BIGINT", f"CASE WHEN kind = 'failure' THEN CASE WHEN attempts + 1 < {ledger.MOST_ATTEMPTS} THEN at_ms + least({ledger.FIRST_WAIT_MS} * (1 << attempts::INTEGER), {ledger.LONGEST_WAIT_MS}) END WHEN kind IN ('queue', 'success', 'blocked') OR (kind = 'retry' AND lifted) THEN NULL ELSE next_attempt_at_ms END"),
    "last_error_category": ("NULL::VARCHAR", "CASE WHEN kind IN ('failure', 'blocked') THEN category WHEN kind = 'success' THEN NULL ELSE last_error_category END"),
    "delivered_revision": ("NULL::BIGINT", "CASE WHEN kind = 'success' THEN revision ELSE delivered_revision END"),
    "delivered_hash": ("NULL::VARCHAR", "CASE WHEN kind = 'success' THEN hash ELSE delivered_hash END"),
    "updated_at_ms": ("NULL::BIGINT", "CASE WHEN kind IN ('queue', 'success', 'failure', 'blocked') OR (kind = 'retry' AND lifted) THEN at_ms ELSE updated_at_ms END"),
}
_LEDGER = f"""WITH RECURSIVE views AS (SELECT 1), {with_views('', 'deliveries_made').strip().removeprefix('WITH ')},
happened AS (SELECT *, row_number() OVER (PARTITION BY session_id, endpoint ORDER BY at_ms, key) AS i FROM v_deliveries_made),
fold AS (
  SELECT session_id, endpoint, 0::BIGINT AS i, {', '.join(f'{first} AS {name}' for name, (first, _) in _COLUMNS.items())} FROM (SELECT DISTINCT session_id, endpoint FROM happened)
  UNION ALL
  SELECT session_id, endpoint, i, {', '.join(f'{then} AS {name}' for name, (_, then) in _COLUMNS.items())}
  FROM (SELECT f.* EXCLUDE (i), e.i, e.kind, e.at_ms, e.revision, e.hash, e.category, e.forced, e.forced OR f.delivery_state <> 'dead-letter' AS lifted FROM fold f JOIN happened e ON e.session_id = f.session_id AND e.endpoint = f.endpoint AND e.i = f.i + 1))
, ledger AS (SELECT * EXCLUDE (i) FROM fold QUALIFY row_number() OVER (PARTITION BY session_id, endpoint ORDER BY i DESC) = 1)"""

query("r15_ledger", None, "deliveries_made")(ledger.ledger)
catalog.ORACLE["r15_ledger"] = f"{_LEDGER} SELECT * FROM ledger"


@query("r15_open_deliveries", None, "deliveries_made")
def _(e: DataFrame) -> DataFrame:
    return ledger.open_deliveries(ledger.ledger(e), NOW_MS).select("session_id", "endpoint", "delivery_state", "attempts")


catalog.ORACLE["r15_open_deliveries"] = f"{_LEDGER} SELECT session_id, endpoint, delivery_state, attempts FROM ledger WHERE delivery_state IN ('pending', 'failed') AND coalesce(next_attempt_at_ms, 0) <= {NOW_MS}"

_NAMES = [x.split(" ")[0] for x in ledger.PLANNED]


@query("r16_verified_commits", f"SELECT p.session_id, p.revision, CASE WHEN q.session_id IS NULL THEN 'no-plan' WHEN {' AND '.join(f'p.{n} IS NOT DISTINCT FROM q.{n}' for n in _NAMES)} THEN 'committed' ELSE 'invalid' END AS verdict FROM v_persisted p LEFT JOIN v_planned q ON q.session_id = p.session_id AND q.revision = p.revision AND q.attempt = p.attempt", "persisted", "planned")
def _(persisted: DataFrame, planned: DataFrame) -> DataFrame:
    return ledger.verified(persisted, planned).select("session_id", "revision", "verdict")


@query("r16_verdicts", f"SELECT verdict, count(*)::BIGINT AS n FROM (SELECT CASE WHEN q.session_id IS NULL THEN 'no-plan' WHEN {' AND '.join(f'p.{n} IS NOT DISTINCT FROM q.{n}' for n in _NAMES)} THEN 'committed' ELSE 'invalid' END AS verdict FROM v_persisted p LEFT JOIN v_planned q ON q.session_id = p.session_id AND q.revision = p.revision AND q.attempt = p.attempt) GROUP BY 1", "persisted", "planned")
def _(persisted: DataFrame, planned: DataFrame) -> DataFrame:
    return ledger.verified(persisted, planned).groupBy("verdict").agg(F.count("*").alias("n"))
