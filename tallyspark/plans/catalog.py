"""The engine's queries over projections of the test tables, each with its DuckDB oracle where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.operators import artifacts, outcomes, records, sessions
from tallyspark.sources import transcripts

from .views import view, with_views

#: The clock of the queries: the end of the last day of `events`.
NOW_MS = 1_706_659_200_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers f(view, ...) as a query over the named views, with its SQL over v_<view>."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return f

    return add


_BIN = outcomes.BIN_MS
_CHARTED = ", ".join(f"CAST(count(*) FILTER (WHERE outcome = '{x}') AS BIGINT) AS {x}" for x in outcomes.CHARTED)


def _bins_sql(time: str, start: int, end: int) -> str:
    zero = ", ".join(f"coalesce({x}, 0) AS {x}" for x in outcomes.CHARTED)
    return (
        f"SELECT bin_start_ms, {zero} FROM (SELECT unnest(range({start}, {end}, {_BIN})) AS bin_start_ms) LEFT JOIN"
        f" (SELECT t_ms // {_BIN} * {_BIN} AS bin_start_ms, {_CHARTED} FROM (SELECT {time} AS t_ms, outcome FROM v_attempts) WHERE t_ms >= {start} AND t_ms < {end} GROUP BY 1) USING (bin_start_ms)"
    )


@query("a08_outcome_bins", _bins_sql("finished_at_ms", NOW_MS - outcomes.WINDOW_MS, NOW_MS + _BIN), "attempts")
def _(a: DataFrame) -> DataFrame:
    return outcomes.outcome_bins(a, NOW_MS)


@query("a09_desktop_outcome_bins", _bins_sql("coalesce(finished_at_ms, started_at_ms)", NOW_MS - outcomes.WINDOW_MS, NOW_MS), "attempts")
def _(a: DataFrame) -> DataFrame:
    return outcomes.desktop_outcome_bins(a, NOW_MS)


_SINCE = NOW_MS - 10 * 24 * outcomes.HOUR_MS


@query(
    "j01_attempt_report",
    f"SELECT a.id, source_kind, source_session_id, outcome, started_at_ms, finished_at_ms FROM v_attempts a JOIN v_sessions s ON a.session_id = s.id WHERE coalesce(finished_at_ms, started_at_ms) >= {_SINCE} ORDER BY finished_at_ms IS NULL, finished_at_ms DESC, a.id DESC LIMIT 50",
    "attempts",
    "sessions",
)
def _(a: DataFrame, s: DataFrame) -> DataFrame:
    return outcomes.attempt_report(a, s, _SINCE)


@query("a10_outcome_counts", "SELECT outcome, count(*) AS n, count(finished_at_ms) AS n_finished FROM v_attempts GROUP BY 1", "attempts")
def _(a: DataFrame) -> DataFrame:
    return outcomes.outcome_counts(a)


@query(
    "a11_budget_counts",
    f"SELECT *, CASE WHEN last_hour >= 1 THEN 'hourly-limit' WHEN last_day >= 3 THEN 'daily-limit' ELSE 'allowed' END AS verdict FROM (SELECT session_id, count(*) FILTER (WHERE started_at_ms >= {NOW_MS - outcomes.HOUR_MS}) AS last_hour, count(*) AS last_day FROM v_attempts WHERE started_at_ms BETWEEN {NOW_MS - 24 * outcomes.HOUR_MS} AND {NOW_MS} GROUP BY 1)",
    "attempts",
)
def _(a: DataFrame) -> DataFrame:
    return outcomes.budget_counts(a, NOW_MS, hourly=1, daily=3)


_LEASE = NOW_MS - 12 * outcomes.HOUR_MS


@query("a12_active_leases", f"SELECT count(*) FILTER (WHERE finished_at_ms IS NULL AND lease_expires_at_ms > {_LEASE}) AS active_leases FROM v_attempts", "attempts")
def _(a: DataFrame) -> DataFrame:
    return outcomes.active_leases(a, _LEASE)


@query(
    "a21_capture_failures",
    f"SELECT failures, failures >= 5 AS warn FROM (SELECT count(*) FILTER (WHERE outcome = 'failed' AND error_category LIKE 'source-%' AND finished_at_ms >= {NOW_MS - 24 * outcomes.HOUR_MS}) AS failures FROM (SELECT * FROM v_attempts ORDER BY finished_at_ms IS NULL, finished_at_ms DESC, id DESC LIMIT 500))",
    "attempts",
)
def _(a: DataFrame) -> DataFrame:
    return outcomes.capture_failures(a, NOW_MS)


_STREAKS = (
    "SELECT id, session_id, error_category, row_number() OVER (PARTITION BY session_id, island ORDER BY id) AS streak FROM (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY id) AS island FROM"
    " (SELECT *, CASE WHEN error_category IS NOT DISTINCT FROM lag(error_category) OVER w AND state_generation IS NOT DISTINCT FROM lag(state_generation) OVER w THEN 0 ELSE 1 END AS new FROM v_attempts WHERE outcome = 'failed' WINDOW w AS (PARTITION BY session_id ORDER BY id)))"
)


@query("w01_failure_streaks", _STREAKS, "attempts")
def _(a: DataFrame) -> DataFrame:
    return outcomes.failure_streaks(a)


@query("backoff_retry_schedule", f"SELECT id, streak, CASE WHEN streak < 5 AND error_category <> 'source-missing' THEN [10, 30, 90, 240, 1440][streak] * 60000 + {NOW_MS} ELSE -1 END AS retry_at_ms FROM ({_STREAKS})", "attempts")
def _(a: DataFrame) -> DataFrame:
    rows = outcomes.failure_streaks(a)
    return rows.select("id", "streak", outcomes.retry_at(F.col("streak"), F.lit(NOW_MS), F.col("error_category") != "source-missing").alias("retry_at_ms"))


@query("backoff_sink", "SELECT id, least(60000 * (1::BIGINT << least(greatest(attempts - 1, 0), 16)::INT), 3600000) AS wait_ms FROM v_ledger", "ledger")
def _(x: DataFrame) -> DataFrame:
    return x.select("id", outcomes.sink_backoff_ms(F.col("attempts")).alias("wait_ms"))


_DUE = 1_706_000_500_000


@query(
    "f06_eligible_sessions",
    f"SELECT s.id, lifecycle_state, coalesce(next_retry_at_ms, 0) AS retry_at, coalesce(last_start, 0) AS last_start FROM v_sessions s LEFT JOIN (SELECT session_id, max(started_at_ms) AS last_start FROM v_attempts GROUP BY 1) l ON l.session_id = s.id WHERE lifecycle_state IN ('summary-pending', 'revision-pending', 'interrupted') OR (lifecycle_state = 'failed' AND next_retry_at_ms BETWEEN 0 AND {_DUE}) OR (lifecycle_state = 'processing' AND EXISTS (SELECT 1 FROM v_attempts a WHERE a.session_id = s.id AND finished_at_ms IS NULL AND lease_expires_at_ms <= {_DUE})) ORDER BY 3, 4, 1 LIMIT 32",
    "sessions",
    "attempts",
)
def _(s: DataFrame, a: DataFrame) -> DataFrame:
    return outcomes.eligible_sessions(s, a, _DUE)


_STATE = (
    "CASE WHEN coalesce(last_error_category, '') IN ('project-disabled', 'project-override-disabled', 'project-override-invalid') AND lifecycle_state <> 'archived' THEN 'disabled-project'"
    " WHEN lifecycle_state = 'failed' AND starts_with(coalesce(last_error_category, ''), 'delivery-') THEN 'delivery-related' WHEN lifecycle_state = 'observed' AND transcript_lost_at_ms IS NOT NULL THEN 'transcript-lost'"
    " WHEN lifecycle_state = 'observed' AND current_revision = 0 AND (last_session_end_ms IS NOT NULL OR not_archive_worthy_at_ms IS NOT NULL) THEN 'not-archive-worthy' ELSE lifecycle_state END"
)
_WITH_STATE = f"(SELECT *, {_STATE} AS state FROM v_sessions)"
_PROJECT = "coalesce(nullif(project, ''), '(unknown)')"


@query("p24_reported_states", f"SELECT id, state FROM {_WITH_STATE}", "sessions")
def _(s: DataFrame) -> DataFrame:
    return s.select("id", sessions.reported_state().alias("state"))


_HISTOGRAM = ", ".join(f"count(*) FILTER (WHERE state = '{x}') AS {x.replace('-', '_')}" for x in sessions.REPORTED)


@query("a03_state_histogram", f"SELECT count(*) AS total, {_HISTOGRAM}, count(*) FILTER (WHERE placeholder) AS placeholders, count(*) FILTER (WHERE lifecycle_state = 'failed' AND next_retry_at_ms < 0) AS parked FROM {_WITH_STATE}", "sessions")
def _(s: DataFrame) -> DataFrame:
    return sessions.state_histogram(s)


@query("a04_by_state_source", f"SELECT state, source_kind AS source, count(*) AS n FROM {_WITH_STATE} GROUP BY 1, 2", "sessions")
def _(s: DataFrame) -> DataFrame:
    return sessions.by_state_source(s)


@query("a05_remaining_by_project", f"SELECT {_PROJECT} AS project, count(*) AS n FROM {_WITH_STATE} WHERE state IN ('interrupted', 'observed') GROUP BY 1", "sessions")
def _(s: DataFrame) -> DataFrame:
    return sessions.remaining_by_project(s)


@query("a06_desktop_remaining", f"SELECT coalesce(nullif(trim(project), ''), 'unattributed') AS project, count(*) AS n FROM {_WITH_STATE} WHERE state IN ('summary-pending', 'revision-pending', 'interrupted', 'observed') GROUP BY 1 ORDER BY n DESC, project LIMIT 10", "sessions")
def _(s: DataFrame) -> DataFrame:
    return sessions.desktop_remaining(s)


@query("a07_archived_by_source", "SELECT source_kind AS source, count(*) AS n FROM v_sessions WHERE lifecycle_state = 'archived' GROUP BY 1", "sessions")
def _(s: DataFrame) -> DataFrame:
    return sessions.archived_by_source(s)


_LIST = f"SELECT id, source_kind, source_session_id, {_PROJECT} AS project, state, current_revision, updated_at_ms FROM {_WITH_STATE}"
_NEWEST = "ORDER BY updated_at_ms DESC, id DESC LIMIT 50"


@query("t01_session_list", f"{_LIST} {_NEWEST}", "sessions")
def _(s: DataFrame) -> DataFrame:
    return sessions.session_list(s)


@query("f08_sessions_of_state", f"{_LIST} WHERE state = 'archived' {_NEWEST}", "sessions")
def _(s: DataFrame) -> DataFrame:
    return sessions.session_list(s, "archived")


@query("j07_sessions_with_uploads", f"SELECT p.*, upload_id FROM ({_LIST} {_NEWEST}) p LEFT JOIN (SELECT session_id, max(id) AS upload_id FROM v_ledger GROUP BY 1) u ON u.session_id = p.id", "sessions", "ledger")
def _(s: DataFrame, x: DataFrame) -> DataFrame:
    return sessions.session_list_with_uploads(s, x)


_CUTOFF = 1_704_067_200_000 + 50_000_000


@query("f04_stale_sessions", f"SELECT id, last_agent_stop_ms FROM v_sessions WHERE active AND last_agent_stop_ms IS NOT NULL AND updated_at_ms <= {_CUTOFF} AND (last_session_end_ms IS NULL OR last_session_end_ms < last_agent_stop_ms)", "sessions")
def _(s: DataFrame) -> DataFrame:
    return sessions.stale_sessions(s, _CUTOFF)


@query("a20_parked_causes", "SELECT coalesce(last_error_category, 'none') AS category, count(*) AS n FROM v_sessions WHERE lifecycle_state = 'failed' AND next_retry_at_ms < 0 GROUP BY 1", "sessions")
def _(s: DataFrame) -> DataFrame:
    return sessions.parked_causes(s)


@query("a17_ledger_status", "SELECT state, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, max(attempts) AS most_attempts FROM v_ledger GROUP BY 1", "ledger")
def _(x: DataFrame) -> DataFrame:
    return sessions.ledger_status(x)


@query(
    "j03_due_uploads",
    "SELECT u.id, session_id, state, attempts, coalesce(u.next_attempt_at_ms, 0) AS due_at_ms, source_kind, source_session_id FROM v_ledger u JOIN v_sessions s ON u.session_id = s.id WHERE endpoint = '1-URGENT' AND state IN ('pending', 'failed') AND coalesce(u.next_attempt_at_ms, 0) <= 1706000300000 ORDER BY due_at_ms, u.id LIMIT 32",
    "ledger",
    "sessions",
)
def _(x: DataFrame, s: DataFrame) -> DataFrame:
    return sessions.due_uploads(x, s, "1-URGENT", 1_706_000_300_000)


@query(
    "j15_backfill",
    "SELECT s.id, count(u.state) AS uploads FROM v_sessions s LEFT JOIN (SELECT * FROM v_ledger WHERE endpoint = '1-URGENT') u ON u.session_id = s.id WHERE lifecycle_state = 'archived' AND (u.state IS NULL OR (u.state = 'uploaded' AND (snapshot_id IS NULL OR uploaded_markdown_hash IS DISTINCT FROM markdown_hash)) OR (u.state = 'pending' AND uploaded_revision IS NOT NULL AND snapshot_id IS NULL)) GROUP BY 1",
    "sessions",
    "ledger",
)
def _(s: DataFrame, x: DataFrame) -> DataFrame:
    return sessions.backfill(s, x, "1-URGENT")


_LISTED = "SELECT c_custkey AS snapshot_id, c_name AS session_id FROM customer WHERE c_custkey % 3 <> 0"


def _reconciled(spark: SparkSession, sf_dir: str, repair: bool) -> DataFrame:
    local = view(spark, sf_dir, "ledger").withColumn("remote_session_id", F.when(F.col("uploaded_revision") == 1, "known"))
    remote = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("snapshot_id"), F.col("c_name").alias("session_id"))
    return sessions.reconcile(local, remote, "1-URGENT", repair)


for _name, _repair in (("j08_reconcile", False), ("j08_reconcile_repair", True)):
    QUERIES[_name] = lambda spark, sf_dir, repair=_repair: _reconciled(spark, sf_dir, repair)
    # rows of the endpoint one after another, as they are told apart there
    ORACLE[_name] = with_views(
        f"SELECT CASE WHEN snapshot_id IS NULL THEN 'no-snapshot' {'WHEN snapshot_id NOT IN (SELECT snapshot_id FROM r) THEN ' + chr(39) + 'repaired' + chr(39) if _repair else ''}"
        f" WHEN uploaded_revision = 1 THEN 'already' WHEN snapshot_id IN (SELECT snapshot_id FROM r) THEN 'reconciled' ELSE 'unmatched' END AS outcome, count(*) AS n FROM v_ledger, (SELECT 1) WHERE endpoint = '1-URGENT' GROUP BY 1",
        "ledger",
    ).replace("WITH ", f"WITH r AS ({_LISTED}), ", 1)


@query("t08_newest_snapshots", "SELECT session_id, max(id) AS id, count(*) - 1 AS superseded FROM v_ledger GROUP BY 1", "ledger")
def _(x: DataFrame) -> DataFrame:
    return sessions.newest_snapshots(x, "session_id", "id")


@query("k04_upsert", "SELECT session_id, endpoint, max_by(id, (CASE WHEN state = 'uploaded' THEN 1 ELSE 0 END) * 1000000000000 + id) AS id FROM v_ledger GROUP BY 1, 2", "ledger")
def _(x: DataFrame) -> DataFrame:
    rows = x.select("session_id", "endpoint", "id", "state")
    return sessions.upsert(rows.where("state <> 'uploaded'"), rows.where("state = 'uploaded'"), ["session_id", "endpoint"], "id").drop("state")


def _as_transcripts(r: DataFrame) -> DataFrame:
    """Conversations as claude-code records: system turns as bookkeeping."""
    message = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", "content").alias("message")))
    return transcripts.facts(r.select(F.lit("claude-code").alias("source"), F.col("session_id").cast("string").alias("session_id"), "record", message.alias("raw")))


_BLANK = "trim(coalesce(content, ''), ' \t\n\r') = ''"


@query(
    "a01_session_summary",
    f"SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(count(*) FILTER (WHERE role = 'user' AND NOT {_BLANK}) AS BIGINT) AS user_requests, CAST(count(*) FILTER (WHERE role = 'assistant' AND NOT {_BLANK}) AS BIGINT) AS assistant_messages, CAST(0 AS BIGINT) AS tool_activities, count(*) FILTER (WHERE role = 'system') AS ignored_events, CAST(0 AS BIGINT) AS malformed_records FROM v_records GROUP BY 1",
    "records",
)
def _(r: DataFrame) -> DataFrame:
    return records.session_summary(records.classified(_as_transcripts(r))).drop("source", "started_at", "updated_at")


@query(
    "f01_worth_keeping",
    f"SELECT CAST(session_id AS VARCHAR) AS session_id FROM v_records GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'user' AND NOT {_BLANK}) > 0 AND count(*) FILTER (WHERE role = 'assistant' AND NOT {_BLANK}) > 0",
    "records",
)
def _(r: DataFrame) -> DataFrame:
    return records.session_summary(records.classified(_as_transcripts(r))).where(records.worth_keeping()).select("session_id")


@query("w05_first_user_event", "SELECT session_id, min(record) AS first_record FROM v_records WHERE role = 'user' GROUP BY 1", "records")
def _(r: DataFrame) -> DataFrame:
    return r.where("role = 'user'").groupBy("session_id").agg(F.min("record").alias("first_record"))


@query(
    "a13_parse_accounting",
    "SELECT 'claude-code' AS source, CAST(session_id AS VARCHAR) AS session_id, count(*) AS records_seen, count(*) FILTER (WHERE role = 'user') AS user_events, count(*) FILTER (WHERE role = 'assistant') AS assistant_events FROM v_records GROUP BY 2",
    "records",
)
def _(r: DataFrame) -> DataFrame:
    out = records.parse_accounting(records.classified(_as_transcripts(r)), ["source", "session_id"])
    return out.select("source", "session_id", "records_seen", "user_events", "assistant_events")


_SPOKEN = f"count(*) FILTER (WHERE role = '{{}}' AND NOT {_BLANK})"


@query(
    "a13_parse_accounting_flat",
    f"SELECT CAST(session_id AS VARCHAR) AS session_id, count(*) AS records_seen, {_SPOKEN.format('user')} AS user_events, {_SPOKEN.format('assistant')} AS assistant_events, CAST(0 AS BIGINT) AS tool_events,"
    f" count(*) FILTER (WHERE role IN ('user', 'assistant') AND {_BLANK}) AS empty_records, count(*) FILTER (WHERE role = 'system') AS ignored_records, CAST(0 AS BIGINT) AS unknown_records, CAST(0 AS BIGINT) AS error_records,"
    " CAST(1 AS DOUBLE) AS typed_share, CASE WHEN count(*) FILTER (WHERE role = 'system') > 0 THEN 'system=' || count(*) FILTER (WHERE role = 'system') ELSE '' END AS ignored_kinds, '' AS unknown_kinds FROM v_records GROUP BY 1",
    "records",
)
def _(r: DataFrame) -> DataFrame:
    out = records.parse_accounting(records.classified(_as_transcripts(r)), ["source", "session_id"]).drop("source")
    said = lambda c: F.coalesce(F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), " "), F.lit(""))
    return out.withColumns({c: said(c) for c in ("ignored_kinds", "unknown_kinds")})


@query("a13_parse_accounting_all", None, "records")
def _(r: DataFrame) -> DataFrame:
    return records.parse_accounting(records.classified(_as_transcripts(r)), ["source", "session_id"])


@query(
    "w02_event_chunks",
    "SELECT session_id, record, chunk FROM (WITH RECURSIVE n AS (SELECT session_id, record, content_bytes + 1 AS size, row_number() OVER (PARTITION BY session_id ORDER BY record, content_bytes) AS k FROM v_records),"
    " g AS (SELECT session_id, record, k, size AS used, CAST(0 AS BIGINT) AS chunk FROM n WHERE k = 1 UNION ALL SELECT n.session_id, n.record, n.k, CASE WHEN g.used + n.size > 4096 THEN n.size ELSE g.used + n.size END, CASE WHEN g.used + n.size > 4096 THEN g.chunk + 1 ELSE g.chunk END FROM g JOIN n ON n.session_id = g.session_id AND n.k = g.k + 1) SELECT * FROM g)",
    "records",
)
def _(r: DataFrame) -> DataFrame:
    return records.event_chunks(r.select("session_id", "record", (F.col("content_bytes") + 1).alias("size")), "session_id", "record", "size", 4096)


@query("a15_corpus_rollup", "SELECT agent, version, grouping(agent) = 1 AS is_total, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM v_outputs GROUP BY GROUPING SETS ((agent, version), ())", "outputs")
def _(o: DataFrame) -> DataFrame:
    return records.corpus_rollup(o, "agent", "version", [F.count("*").alias("n"), F.sum("bytes").alias("bytes")])


@query("s02_version_gate", "SELECT version, version BETWEEN 1 AND 2 AS readable, count(*) AS n FROM v_outputs GROUP BY 1, 2", "outputs")
def _(o: DataFrame) -> DataFrame:
    return o.groupBy("version", transcripts.readable(F.col("version")).alias("readable")).agg(F.count("*").alias("n"))


_OVER = 8192


@query("elide_outputs", f"SELECT seq, bytes, bytes > {_OVER} AS elided, CASE WHEN bytes > {_OVER} THEN '[claim-ticket sha256:' || sha256 || ' bytes:' || bytes || ' label:' || label || ']' END AS ticket FROM v_outputs", "outputs")
def _(o: DataFrame) -> DataFrame:
    return artifacts.elided(o.withColumn("bytes", F.coalesce("bytes", F.lit(0))), _OVER)


@query("a25_distinct_outputs", f"SELECT sha256, arg_min(label, seq) AS label, min(bytes) AS bytes, min(seq) AS first_seq, count(*) AS copies FROM v_outputs WHERE bytes > {_OVER} GROUP BY 1", "outputs")
def _(o: DataFrame) -> DataFrame:
    return artifacts.distinct_outputs(o, _OVER)


@query("j13_redeemed", f"SELECT sha256, seq, label, bytes FROM v_outputs WHERE sha256 IN (SELECT sha256 FROM v_outputs WHERE bytes > {_OVER})", "outputs")
def _(o: DataFrame) -> DataFrame:
    return artifacts.redeemed(o.where(F.col("bytes") > _OVER).select(F.concat(F.lit("sha256:"), "sha256").alias("sha256")), o)


@query(
    "w04_line_search",
    r"""SELECT seq, min(a) AS first_line, max(b) AS last_line, count(*) AS matches FROM (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY i) AS island FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM (SELECT seq, i, greatest(i - 2, 0) AS a, least(i + 2, n - 1) AS b FROM (SELECT seq, unnest(lines) AS line, unnest(range(len(lines))) AS i, len(lines) AS n FROM (SELECT seq, string_split(CASE WHEN right(t, 1) = chr(10) THEN left(t, length(t) - 1) ELSE t END, chr(10)) AS lines FROM (SELECT seq, replace(content, chr(13) || chr(10), chr(10)) AS t FROM v_outputs))) WHERE contains(lower(line), 'license')))) GROUP BY seq, island""",
    "outputs",
)
def _(o: DataFrame) -> DataFrame:
    return artifacts.line_search(o, "License")


def a26_manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as folders, their lines as files."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("path"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"), F.col("l_quantity").cast("long").alias("size"))
    return artifacts.manifest_hash(lines, "l_orderkey", "path", "digest", "size")


QUERIES["a26_manifest_hash"] = a26_manifest_hash
ORACLE["a26_manifest_hash"] = "SELECT l_orderkey, sha256(string_agg(line, '' ORDER BY path, line)) AS manifest_hash, count(*) AS files FROM (SELECT l_orderkey, 'f' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path, sha256(CAST(l_partkey AS VARCHAR)) || '  ' || CAST(l_quantity AS BIGINT) || '  ' || path || chr(10) AS line FROM lineitem) GROUP BY 1"


def a28_key_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.key_frequencies(spark.read.parquet(f"{sf_dir}/events.parquet"), "props")


QUERIES["a28_key_frequencies"] = a28_key_frequencies
ORACLE["a28_key_frequencies"] = "SELECT unnest(json_keys(props)) AS key, count(*) AS n FROM events GROUP BY 1"


@query("scalar_functions", "SELECT id, 'x-' || current_revision AS short, coalesce(nullif(left(trim(regexp_replace(lower(CASE WHEN id % 4 = 0 THEN '--' ELSE ' ' || source_session_id || ' (a, b)' END), '[^a-z0-9]', '-', 'g'), '-'), 48), ''), 'project') AS slug, coalesce(nullif(project, ''), 'home') AS label FROM v_sessions", "sessions")
def _(s: DataFrame) -> DataFrame:
    label = scalars.project_label(F.col("project"), F.lit(""), F.lit("/usr/home"))
    return s.select("id", scalars.shortened(F.concat(F.lit("x-"), F.col("current_revision").cast("string"))).alias("short"), scalars.slug(F.when(F.col("id") % 4 == 0, "--").otherwise(F.concat(F.lit(" "), "source_session_id", F.lit(" (a, b)")))).alias("slug"), label.alias("label"))
