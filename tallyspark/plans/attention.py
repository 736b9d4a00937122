"""Queries of what wants attention, of prunes, inserts and lookups, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import artifacts, reports, sessions

from .catalog import NOW_MS, query

_RETENTION = 24 * 60 * 60 * 1000
_PARKED = "lifecycle_state = 'failed' AND next_retry_at_ms < 0"
_REASONS = {
    "unresolved": "transcript_path IS NULL AND lifecycle_state IN ('summary-pending', 'revision-pending', 'interrupted', 'failed')",
    "stuck-observed": "NOT active AND lifecycle_state = 'observed' AND last_session_end_ms IS NULL AND transcript_lost_at_ms IS NULL",
    "parked-unarchived": f"{_PARKED} AND current_revision = 0 AND transcript_path IS NOT NULL",
    "oversized-parked": f"{_PARKED} AND last_error_category = 'source-oversized' AND transcript_path IS NOT NULL",
    "settled-lost": "transcript_lost_at_ms IS NOT NULL AND transcript_path IS NOT NULL",
}

query("f05_attention", " UNION ALL ".join(f"(SELECT id, '{name}' AS reason FROM v_sessions WHERE {where})" for name, where in _REASONS.items()), "sessions")(sessions.attention)
query(
    "a20_parked_checks",
    f"SELECT code, count(*)::BIGINT AS n FROM (SELECT CASE WHEN last_error_category IN ('source-oversized', 'summary-input-limit') THEN 'size-cap-parked' WHEN last_error_category = 'source-id-mismatch' THEN 'id-mismatch-parked' WHEN last_error_category = 'source-missing' THEN CASE WHEN current_revision = 0 AND cursor_bytes IS NULL THEN 'phantom-invocations-parked' ELSE 'source-missing-parked' END END AS code FROM v_sessions WHERE {_PARKED}) WHERE code IS NOT NULL GROUP BY 1",
    "sessions",
)(sessions.parked_checks)


@query(
    "f11_prune_totals",
    f"SELECT count(*) FILTER (WHERE k <= 200)::BIGINT AS pruned, (SELECT count(DISTINCT directory) FROM v_files)::BIGINT - count(*) FILTER (WHERE k <= 200) AS remaining, coalesce(sum(bytes) FILTER (WHERE k <= 200), 0)::BIGINT AS reclaimed_bytes FROM (SELECT *, row_number() OVER (ORDER BY directory) AS k FROM (SELECT directory, max(mtime_ms) AS newest_ms, sum(bytes) AS bytes FROM v_files GROUP BY 1) WHERE newest_ms < {NOW_MS - _RETENTION} AND newest_ms <= {NOW_MS - reports.QUIET_MS})",
    "files",
)
def _(f: DataFrame) -> DataFrame:
    return reports.prune_totals(f, NOW_MS, _RETENTION)


@query(
    "k04_inserted",
    "SELECT session_id, endpoint, id FROM v_ledger WHERE state = 'uploaded' UNION ALL SELECT session_id, endpoint, min(id) FROM v_ledger n WHERE state <> 'uploaded' AND NOT EXISTS (SELECT 1 FROM v_ledger o WHERE o.state = 'uploaded' AND o.session_id = n.session_id AND o.endpoint = n.endpoint) GROUP BY 1, 2",
    "ledger",
)
def _(x: DataFrame) -> DataFrame:
    rows = lambda where: x.where(where).select("session_id", "endpoint", "id")
    return sessions.inserted(rows("state = 'uploaded'"), rows("state <> 'uploaded'"), ["session_id", "endpoint"], "id")


@query("j04_delivered_sessions", "SELECT d.source, d.name, d.endpoint, d.vault, attempts, s.id, current_revision FROM v_named_deliveries d JOIN v_sessions s ON s.source_kind = d.source AND s.source_session_id = d.name WHERE endpoint = 'main' AND vault = 'notes'", "named_deliveries", "sessions")
def _(d: DataFrame, s: DataFrame) -> DataFrame:
    return sessions.delivered_sessions(d, s, "main", "notes")


@query("j14_known_records", "SELECT a.id, a.number, (SELECT max('r/' || r.id) FROM v_records_kept r WHERE r.hash = a.hash AND r.id % 2 = 0) AS local_path FROM v_parts_kept a", "parts_kept", "records_kept")
def _(a: DataFrame, r: DataFrame) -> DataFrame:
    records = r.where("id % 2 = 0").select(F.concat(F.lit("sha256:"), "hash").alias("markdown_hash"), F.concat(F.lit("r/"), F.col("id").cast("string")).alias("relative_path"))
    return artifacts.known_records(a.select("id", "number", F.col("hash").alias("original_sha256")), records).select("id", "number", "local_path")
