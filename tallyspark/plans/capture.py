"""Queries of captures, profiles, manifests and dashboard lists, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import capture, reports

from .catalog import query

_KEEP = ("en", "kept")
_SAFE = "CASE WHEN {0} IN ('en', 'kept') THEN to_json({0}) ELSE '\"redacted\"' END"


@query(
    "k08_sanitized",
    f"SELECT id, CASE WHEN id % 7 > 0 THEN concat('{{\"lang\":', {_SAFE.format('lang')}, ',\"deep\":[{{\"source\":\"redacted\",\"n\":', id, '}},\"kept\",null,true,[\"redacted\"]]}}') END AS raw, id % 7 > 0 AS valid FROM v_captured",
    "captured",
)
def _(c: DataFrame) -> DataFrame:
    # id % 7 = 0 leaves the closing brace out
    quoted = lambda c: F.expr(f"substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    text = F.concat(F.lit('{"lang": '), quoted("lang"), F.lit(', "deep": [{"source": '), quoted("source"), F.lit(', "n": '), F.col("id").cast("string"), F.lit('}, "kept", null, true, ["x"]]'), F.when(F.col("id") % 7 > 0, "}").otherwise(""))
    return capture.sanitized(c.select("id", text.alias("raw")), keep=_KEEP)


@query("a28_discriminators", "SELECT key, label, count(*)::BIGINT AS n FROM (SELECT 'k' AS key, (props->'k')::VARCHAR AS label FROM (SELECT props::JSON AS props FROM events)) WHERE label IS NOT NULL GROUP BY 1, 2", "event_props")
def _(e: DataFrame) -> DataFrame:
    return capture.discriminators(e, ("k", "missing"))


@query("s18_profile", "SELECT sum(strlen(props))::BIGINT AS bytes, count(*)::BIGINT AS lines, count(*)::BIGINT AS valid_lines, count(*)::BIGINT AS objects FROM events", "event_props")
def _(e: DataFrame) -> DataFrame:
    return capture.profile(e, "raw")


_ENTRY = "{'logical_path': 'part/' || number, 'media_type': flag, 'original_size_bytes': bytes, 'original_sha256': 'sha256:' || hash, 'stored_size_bytes': NULL::BIGINT, 'stored_sha256': 'sha256:' || hash, 'compression': CASE WHEN number % 2 = 0 THEN 'zstd' END}"


@query(
    "k03_manifests",
    f"""SELECT s.id AS id, to_json({{'schema_version': 1, 'session': {{'source_agent': s.priority, 'source_session_id': s.id::VARCHAR}}, 'capture': {{'captured_at': s.day, 'source_cursor': s.id * 3, 'source_state_hash': 'sha256:' || s.hash, 'source_metadata': NULL::VARCHAR, 'project': CASE WHEN s.id % 3 = 0 THEN s.status END, 'repository': NULL::VARCHAR, 'branch': NULL::VARCHAR, 'source_agent_version': NULL::VARCHAR, 'artifact_set_version': 2, 'writer_version': '1.0'}}, 'artifacts': coalesce(a.entries, [])}})::VARCHAR AS manifest
    FROM v_records_kept s LEFT JOIN (SELECT id, list({_ENTRY} ORDER BY number, flag, bytes) AS entries FROM v_parts_kept GROUP BY id) a USING (id)""",
    "records_kept",
    "parts_kept",
)
def _(r: DataFrame, p: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    snapshots = r.select(
        "id", F.col("priority").alias("source_agent"), F.col("id").cast("string").alias("source_session_id"), F.col("day").alias("captured_at"), (F.col("id") * 3).alias("source_cursor"), F.concat(F.lit("sha256:"), "hash").alias("source_state_hash"),
        none.alias("source_metadata"), F.when(F.col("id") % 3 == 0, F.col("status")).alias("project"), none.alias("repository"), none.alias("branch"), none.alias("source_agent_version"), F.lit(2).alias("artifact_set_version"), F.lit("1.0").alias("writer_version"),
    )
    artifacts = p.select(
        "id", F.col("number").alias("position"), F.concat(F.lit("part/"), F.col("number").cast("string")).alias("logical_path"), F.col("flag").alias("media_type"), F.col("bytes").alias("original_size_bytes"), F.col("hash").alias("original_sha256"),
        F.lit(None).cast("long").alias("stored_size_bytes"), F.concat(F.lit("sha256:"), "hash").alias("stored_sha256"), F.when(F.col("number") % 2 == 0, "zstd").alias("compression"),
    )
    return capture.manifests(snapshots, artifacts, "id", "writer")


_INSTRUCTIONS = ("Summarize the whole session", "Reduce these")
_KNOWN = " OR ".join(f"starts_with(substr(content, instr(content, '\"instruction\":\"') + 15), '{x}')" for x in _INSTRUCTIONS)


@query("f02_exhaust_sessions", f"SELECT session_id FROM (SELECT * FROM v_user_texts WHERE kind = 'user' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) = 1) WHERE instr(content, '\"instruction\":\"') > 0 AND ({_KNOWN})", "user_texts")
def _(e: DataFrame) -> DataFrame:
    return capture.exhaust_sessions(e, _INSTRUCTIONS)


def _top(name: str, detail: str, time: str, limit: int, rows: str, session: bool = True) -> str:
    columns = "session_id, source, coalesce(nullif(project, ''), '(unknown)') AS project" if session else "NULL::VARCHAR AS session_id, NULL::VARCHAR AS source, NULL::VARCHAR AS project"
    return f"(SELECT '{name}' AS list, (row_number() OVER (ORDER BY {time} DESC NULLS LAST, id))::INTEGER AS rank, {columns}, {detail} AS detail, {time} AS at_ms FROM {rows} ORDER BY rank LIMIT {limit})"


_RUNNING = ", ".join(f"'{x}'" for x in reports.RUNNING)
_NAMED = "(SELECT *, source_session_id AS session_id, source_kind AS source, lifecycle_state AS state, markdown_hash AS title FROM v_sessions)"
_TRIED = "(SELECT a.*, s.source_session_id AS name, s.source_kind AS source, s.project FROM v_attempts a JOIN v_sessions s ON s.id = a.session_id)"


@query(
    "t05_dashboard_lists",
    " UNION ALL ".join(
        [
            _top("processing", "state", "updated_at_ms", 20, f"{_NAMED} WHERE state IN ({_RUNNING})"),
            _top("archived", "title", "updated_at_ms", 10, f"{_NAMED} WHERE state = 'archived'"),
            _top("failures", "error_category", "finished_at_ms", 10, f"(SELECT * EXCLUDE (session_id), name AS session_id FROM {_TRIED}) WHERE outcome = 'failed'"),
            _top("diagnostics", "concat_ws('/', operation, category)", "recorded_at_ms", 5, "v_diagnostics", session=False),
        ]
    ),
    "sessions",
    "attempts",
    "diagnostics",
)
def _(s: DataFrame, a: DataFrame, d: DataFrame) -> DataFrame:
    named = s.select("id", F.col("source_session_id").alias("session_id"), F.col("source_kind").alias("source"), "project", F.col("lifecycle_state").alias("state"), F.col("markdown_hash").alias("title"), "updated_at_ms")
    tried = a.withColumnRenamed("session_id", "of").join(named.select(F.col("id").alias("of"), "session_id", "source", "project"), "of")
    return reports.dashboard_lists(named, tried, d.drop("session_id"))
