"""Queries of the listings and reports, registered beside those of the catalog, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import reports

from .catalog import NOW_MS, query


@query(
    "t03_recent_diagnostics",
    "SELECT d.id, operation, category, recorded_at_ms, source_kind, source_session_id FROM v_diagnostics d LEFT JOIN v_sessions s ON s.id = d.session_id ORDER BY recorded_at_ms DESC, d.id DESC LIMIT 50",
    "diagnostics",
    "sessions",
)
def _(d: DataFrame, s: DataFrame) -> DataFrame:
    return reports.recent_diagnostics(d, s, 50)


@query("t04_newest_attempts", "SELECT id, finished_at_ms FROM v_attempts ORDER BY finished_at_ms DESC NULLS LAST, id LIMIT 30", "attempts")
def _(a: DataFrame) -> DataFrame:
    return reports.newest_first(a, "finished_at_ms", "id", 30).select("id", "finished_at_ms")


for _name, _states in (("t12_recently_archived", ("archived",)), ("t12_recent_failures", reports.UNHAPPY)):
    query(
        _name,
        f"SELECT id, lifecycle_state, updated_at_ms FROM v_sessions WHERE lifecycle_state IN ({', '.join(repr(x) for x in _states)}) ORDER BY coalesce(updated_at_ms, 0) DESC, id LIMIT 12",
        "sessions",
    )(lambda s, states=_states: reports.recent_sessions(s, states))


@query("t11_failing_checks", "SELECT seq, code, status, CASE status WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank FROM v_checks WHERE status IS DISTINCT FROM 'ok' ORDER BY rank, seq", "checks")
def _(c: DataFrame) -> DataFrame:
    return reports.failing_checks(c.select("seq", "code", "status"))


_LATEST = "SELECT source, session_id, revision, scan_order FROM (SELECT *, row_number() OVER (PARTITION BY source, session_id ORDER BY revision DESC, scan_order {}) AS k FROM v_archives) WHERE k = 1"


@query("t09_latest_archives", _LATEST.format("ASC"), "archives")
def _(r: DataFrame) -> DataFrame:
    return reports.latest_archives(r)


@query("t10_hydrated_archives", _LATEST.format("DESC"), "archives")
def _(r: DataFrame) -> DataFrame:
    return reports.latest_archives(r, last_wins=True)


@query(
    "a30_worst_exit_codes",
    "SELECT report, CASE max(CASE exit_code WHEN 6 THEN 4 WHEN 5 THEN 3 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END) WHEN 4 THEN 6 WHEN 3 THEN 5 WHEN 2 THEN 1 WHEN 1 THEN 4 ELSE 0 END AS exit_code, CASE min(CASE status WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'ok' END AS status FROM v_checks GROUP BY 1",
    "checks",
)
def _(c: DataFrame) -> DataFrame:
    return c.groupBy("report").agg(reports.worst_exit_code(F.col("exit_code")).cast("int").alias("exit_code"), reports.combined_status(F.col("status")).alias("status"))


@query("a32_unexpected_versions", "SELECT list(DISTINCT version ORDER BY version) AS versions FROM v_outputs WHERE version <> 1", "outputs")
def _(o: DataFrame) -> DataFrame:
    return reports.unexpected_versions(o, "version", 1)


_READY = "current_revision > 0 AND markdown_relative_path IS NOT NULL AND project IS NOT NULL AND project NOT IN ('machinery')"
_THERE = "(SELECT * FROM v_deliveries WHERE endpoint = 'main' AND vault = 'notes')"


@query(
    "f09_backfill_candidates",
    f"SELECT s.id FROM v_sessions s LEFT JOIN {_THERE} d ON d.session_id = s.id WHERE {_READY} AND NOT (d.session_id IS NOT NULL AND d.state = 'delivered' AND delivered_revision IS NOT DISTINCT FROM current_revision AND delivered_summary_hash IS NOT NULL AND delivered_summary_hash = markdown_hash)",
    "sessions",
    "deliveries",
)
def _(s: DataFrame, d: DataFrame) -> DataFrame:
    return reports.deliverable(s, d, "main", "notes", ("machinery",))


for _name, _force in (("f09_failed_candidates", False), ("f09_forced_candidates", True)):
    query(
        _name, f"SELECT s.id FROM v_sessions s JOIN {_THERE} d ON d.session_id = s.id WHERE {_READY} AND d.state IN ('failed', 'blocked'{', ' + repr('dead-letter') if _force else ''})", "sessions", "deliveries"
    )(lambda s, d, force=_force: reports.deliverable(s, d, "main", "notes", ("machinery",), "failed", force))


@query(
    "a18_delivery_counts",
    "SELECT " + ", ".join(f"count(*) FILTER (WHERE state = '{x}') AS {x.replace('-', '_')}" for x in ("delivered", "pending", "failed", "dead-letter", "blocked")) + ", count(*) FILTER (WHERE state IN ('failed', 'dead-letter')) AS sink_failed FROM v_deliveries",
    "deliveries",
)
def _(d: DataFrame) -> DataFrame:
    return reports.delivery_counts(d)


_SYNC_NOW = 1_706_000_050_000


@query(
    "f10_sync_eligibility",
    f"""SELECT session_id, CASE WHEN synced THEN CASE WHEN delivered_summary_hash = 'BUILDING' THEN 'unchanged' ELSE 'sync' END WHEN state = 'failed' THEN CASE WHEN next_attempt_at_ms IS NULL OR next_attempt_at_ms <= {_SYNC_NOW} THEN 'sync' ELSE 'deferred' END WHEN state = 'dead-letter' THEN 'unchanged' ELSE 'sync' END AS eligibility FROM (SELECT *, state = 'delivered' AS synced FROM v_deliveries)""",
    "deliveries",
)
def _(d: DataFrame) -> DataFrame:
    state = F.when(F.col("state") == "delivered", "synced").otherwise(F.col("state"))
    return d.select("session_id", reports.sync_eligibility(state, F.col("delivered_summary_hash"), F.col("next_attempt_at_ms"), F.lit("BUILDING"), _SYNC_NOW).alias("eligibility"))


@query("a27_directory_measures", "SELECT directory, max(mtime_ms) AS newest_ms, CAST(sum(bytes) AS BIGINT) AS bytes FROM v_files GROUP BY 1", "files")
def _(f: DataFrame) -> DataFrame:
    return reports.directory_measures(f)


_RETENTION = NOW_MS - 1_704_067_200_000 - 60_000_000


@query("f11_prunable", f"SELECT directory, max(mtime_ms) AS newest_ms, CAST(sum(bytes) AS BIGINT) AS bytes FROM v_files GROUP BY 1 HAVING max(mtime_ms) < {NOW_MS - _RETENTION} AND max(mtime_ms) <= {NOW_MS - 600_000} ORDER BY directory LIMIT 200", "files")
def _(f: DataFrame) -> DataFrame:
    return reports.prunable(f, NOW_MS, _RETENTION)


@query("j10_undiscovered", "SELECT DISTINCT session_id FROM v_ledger WHERE session_id NOT IN (SELECT id FROM v_sessions WHERE active)", "ledger", "sessions")
def _(x: DataFrame, s: DataFrame) -> DataFrame:
    return reports.undiscovered(x.select("session_id").distinct(), s.where("active").select(F.col("id").alias("session_id")), ["session_id"])


@query("k05_cascade_delete", "SELECT id, session_id FROM v_ledger WHERE session_id IN (SELECT id FROM v_sessions WHERE active)", "ledger", "sessions")
def _(x: DataFrame, s: DataFrame) -> DataFrame:
    return reports.purged(x.select("id", "session_id"), s.where("active"), "session_id")


@query("k05_set_null", "SELECT id, CASE WHEN session_id IN (SELECT id FROM v_sessions WHERE active) THEN session_id END AS session_id FROM v_diagnostics", "diagnostics", "sessions")
def _(d: DataFrame, s: DataFrame) -> DataFrame:
    return reports.purged(d.select("id", "session_id"), s.where("active"), "session_id", set_null=True)


@query("p28_archive_path", "SELECT id, CASE source_kind WHEN 'copilot' THEN coalesce(project, 'none') || '/' || source_session_id || '.md' ELSE coalesce(project, 'none') || '/' || source_kind || '/' || source_session_id || '.md' END AS path FROM v_sessions", "sessions")
def _(s: DataFrame) -> DataFrame:
    prefix = F.when(F.col("source_kind") != "copilot", F.col("source_kind"))
    return s.select("id", reports.archive_path(prefix, F.coalesce("project", F.lit("none")), F.col("source_session_id")).alias("path"))


_CLEAN = r"replace(regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', ''), chr(13), chr(10))"


@query(
    "p29_summary_violations",
    f"SELECT id, unnest(list_filter([CASE WHEN title IS NULL OR length(t) NOT BETWEEN 1 AND 200 OR contains(t, chr(10)) OR regexp_matches(t, '[\\x00-\\x08\\x0b-\\x1f\\x7f]') THEN 'title' END, CASE WHEN goal IS NULL OR length(g) NOT BETWEEN 1 AND 4000 OR contains(g, chr(10) || '## ') OR regexp_matches(g, '[\\x00-\\x08\\x0b-\\x1f\\x7f]') THEN 'goal' END, CASE WHEN n_items = 0 THEN 'work_completed' END], lambda x: x IS NOT NULL)) AS field FROM (SELECT *, {_CLEAN.format('title')} AS t, {_CLEAN.format('goal')} AS g FROM v_summaries)",
    "summaries",
)
def _(s: DataFrame) -> DataFrame:
    items = F.array_repeat(F.coalesce("first_item", F.lit("x")), F.col("n_items").cast("int"))
    return reports.summary_violations(s.select("id", "title", "goal", items.alias("work_completed")), "id", ("work_completed",)).select("id", "field")
