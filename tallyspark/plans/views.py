"""Projections of the test tables onto the engine's own tables.

The test tables hold no sessions, so each query runs over a view of one of
them. A view is a table and a SQL expression for each column; the expressions
are plain enough to read the same in Spark and in DuckDB, but for the few
functions of DIALECT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What is spelled differently in (Spark, DuckDB).
DIALECT = {
    "MS(ts)": ("unix_millis(from_utc_timestamp(CAST(ts AS TIMESTAMP), current_timezone()))", "(epoch_us(ts) // 1000)"),
    "BYTES(text)": ("octet_length(text)", "strlen(text)"),
    "SHA(text)": ("sha2(text, 256)", "sha256(text)"),
    "SHA(o_orderkey)": ("sha2(CAST(o_orderkey AS STRING), 256)", "sha256(CAST(o_orderkey AS STRING))"),
    "SHA(l_partkey)": ("sha2(CAST(l_partkey AS STRING), 256)", "sha256(CAST(l_partkey AS STRING))"),
    " // ": (" div ", " // "),
}

#: view: (table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "attempts": (
        "events",
        {
            "id": "event_id",
            "session_id": "user_id",
            "state_generation": "event_id % 3",
            "started_at_ms": "MS(ts) - 60000 * (event_id % 5)",
            "finished_at_ms": "CASE WHEN event_type <> 'view' THEN MS(ts) END",
            "lease_expires_at_ms": "MS(ts) + 360000",
            "outcome": "CASE event_type WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'recovered' WHEN 'signup' THEN 'superseded' ELSE 'processing' END",
            "error_category": "CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'source-missing' WHEN 1 THEN 'source-failed' ELSE 'summarizer-failed' END END",
        },
    ),
    "sessions": (
        "customer",
        {
            "id": "c_custkey",
            "source_kind": "CASE c_custkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' ELSE 'copilot' END",
            "source_session_id": "c_name",
            "project": "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE lower(c_mktsegment) END",
            "lifecycle_state": "CASE c_custkey % 7 WHEN 0 THEN 'observed' WHEN 1 THEN 'summary-pending' WHEN 2 THEN 'interrupted' WHEN 3 THEN 'revision-pending' WHEN 4 THEN 'processing' WHEN 5 THEN 'archived' ELSE 'failed' END",
            "current_revision": "c_custkey % 3",
            "next_retry_at_ms": "CASE WHEN c_custkey % 7 = 6 THEN CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1706000000000 + c_custkey * 1000 END END",
            "last_error_category": "CASE c_custkey % 9 WHEN 0 THEN 'project-disabled' WHEN 1 THEN 'delivery-timeout' WHEN 2 THEN 'source-missing' WHEN 3 THEN 'source-oversized' WHEN 4 THEN 'summary-input-limit' WHEN 5 THEN 'source-id-mismatch' END",
            "last_agent_stop_ms": "CASE WHEN c_custkey % 5 <> 0 THEN 1704067200000 + (c_custkey * 7919 % 100000) * 1000 - 500 END",
            "last_session_end_ms": "CASE WHEN c_custkey % 4 = 0 THEN 1704067200000 + (c_custkey * 7919 % 100000) * 1000 END",
            "transcript_lost_at_ms": "CASE WHEN c_custkey % 17 = 0 THEN 1706000000000 END",
            "not_archive_worthy_at_ms": "CASE WHEN c_custkey % 19 = 0 THEN 1706000000000 END",
            "updated_at_ms": "1704067200000 + (c_custkey * 7919 % 100000) * 1000",
            "transcript_path": "CASE WHEN c_custkey % 8 <> 3 THEN c_name END",
            "cursor_bytes": "CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 10 END",
            "active": "c_custkey % 2 = 1",
            "placeholder": "c_custkey % 23 = 0",
            "markdown_hash": "c_mktsegment",
            "markdown_relative_path": "CASE WHEN c_custkey % 6 <> 0 THEN c_name || '.md' END",
        },
    ),
    "ledger": (
        "orders",
        {
            "id": "o_orderkey",
            "session_id": "o_custkey",
            "endpoint": "o_orderpriority",
            "state": "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'uploaded' ELSE 'failed' END",
            "attempts": "o_orderkey % 7",
            "snapshot_id": "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5000 END",
            "uploaded_revision": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 END",
            "uploaded_markdown_hash": "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'FURNITURE' ELSE 'BUILDING' END",
            "next_attempt_at_ms": "CASE WHEN o_orderkey % 2 = 0 THEN 1706000000000 + (o_orderkey % 1000) * 1000 END",
            "bytes": "o_orderkey % 4096",
        },
    ),
    "diagnostics": (
        "events",
        {"id": "event_id", "session_id": "CASE WHEN event_id % 6 <> 0 THEN user_id END", "operation": "event_type", "category": "CASE WHEN event_id % 3 = 0 THEN 'source' ELSE 'delivery' END", "recorded_at_ms": "MS(ts) // 3600000 * 3600000"},
    ),
    "deliveries": (
        "supplier",
        {
            "session_id": "s_suppkey",
            "endpoint": "CASE WHEN s_suppkey % 5 = 0 THEN 'other' ELSE 'main' END",
            "vault": "'notes'",
            "state": "CASE s_suppkey % 6 WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' WHEN 3 THEN 'dead-letter' WHEN 4 THEN 'blocked' ELSE 'delivered' END",
            "delivered_revision": "CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 3 END",
            "delivered_summary_hash": "CASE s_suppkey % 4 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'FURNITURE' WHEN 2 THEN 'MACHINERY' END",
            "next_attempt_at_ms": "CASE WHEN s_suppkey % 8 <> 0 THEN 1706000000000 + s_suppkey * 1000 END",
        },
    ),
    "records_kept": ("orders", {"id": "o_orderkey", "status": "o_orderstatus", "priority": "o_orderpriority", "day": "substr(CAST(o_orderdate AS STRING), 1, 10)", "hash": "SHA(o_orderkey)"}),
    "named_deliveries": (
        "customer",
        {"source": "CASE c_custkey % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' ELSE 'codex' END", "name": "c_name", "endpoint": "CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE 'main' END", "vault": "CASE WHEN c_custkey % 5 = 0 THEN 'drafts' ELSE 'notes' END", "attempts": "c_custkey % 6"},
    ),
    "archives": ("orders", {"source": "o_orderpriority", "session_id": "o_custkey", "revision": "o_orderkey % 3", "scan_order": "o_orderkey"}),
    "checks": ("part", {"seq": "p_partkey", "code": "p_name", "status": "CASE p_partkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'ok' WHEN 3 THEN 'unknown' END", "exit_code": "p_partkey % 7", "report": "p_partkey % 10"}),
    "files": ("lineitem", {"directory": "l_orderkey", "bytes": "l_partkey", "mtime_ms": "1704067200000 + (l_partkey * 7919 % 100000) * 1000"}),
    "summaries": ("documents", {"id": "doc_id", "title": "substr(text, 1, 150 + doc_id % 100)", "goal": "text", "first_item": "lang", "n_items": "doc_id % 3"}),
    "cursors": (
        "documents",
        {
            "id": "doc_id",
            "content": "coalesce(text, '')",
            "prefix": "CASE WHEN doc_id % 11 = 0 THEN coalesce(text, '') || 'more' WHEN doc_id % 7 = 0 THEN coalesce(text, '') WHEN doc_id % 3 = 0 THEN substr(coalesce(text, ''), 1, instr(coalesce(text, ''), chr(10))) ELSE substr(coalesce(text, ''), 1, doc_id % 400) END",
            "tampered": "doc_id % 17 = 0",
            "version": "CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 2 END",
            "has_cursor": "doc_id % 23 <> 0",
        },
    ),
    "restored_snapshots": ("supplier", {"status": "CASE s_suppkey % 4 WHEN 0 THEN 'restored' WHEN 1 THEN 'refused' WHEN 2 THEN 'skipped' ELSE 'failed' END", "superseded": "s_suppkey % 3"}),
    "restored_artifacts": (
        "part",
        {
            "kind": "p_partkey % 8",
            "result": "CASE p_partkey % 8 WHEN 0 THEN 'written' WHEN 1 THEN 'replaced' WHEN 2 THEN 'would-write' WHEN 3 THEN 'would-replace' WHEN 4 THEN 'present' WHEN 5 THEN 'refused-differs' WHEN 6 THEN 'skipped' ELSE 'failed' END",
            "bytes": "p_partkey",
            "finding": "CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
        },
    ),
    "captured": ("documents", {"id": "doc_id", "lang": "lang", "source": "substr(text, 1, 40)"}),
    "event_props": ("events", {"raw": "props"}),
    "parts_kept": ("lineitem", {"id": "l_orderkey", "number": "l_linenumber", "flag": "l_returnflag", "bytes": "l_partkey", "hash": "SHA(l_partkey)"}),
    "user_texts": (
        "conversations",
        {
            "session_id": "conv_id",
            "seq": "turn",
            "kind": "role",
            "content": "CASE WHEN conv_id % 5 = 0 THEN concat('say {\"instruction\":\"', CASE conv_id % 3 WHEN 0 THEN 'Summarize the whole session' WHEN 1 THEN 'Reduce these' ELSE 'Do as ' END, '\"} ', text) WHEN conv_id % 7 = 0 THEN concat('{\"instruction\":\"no\", \"instruction\":\"Reduce these', text) ELSE text END",
        },
    ),
    "planned": ("orders", {
            "session_id": "CAST(o_orderkey AS STRING)",
            "revision": "o_orderkey % 4 + 1",
            "attempt": "'a'",
            "record_count": "o_custkey",
            "byte_offset": "o_custkey * 10",
            "prefix_hash": "SHA(o_orderkey)",
            "source_hash": "SHA(o_orderkey)",
            "source_bytes": "o_custkey * 10",
            "relative_path": "concat(o_orderpriority, '.md')",
            "markdown_hash": "SHA(o_orderkey)",
            "history": "o_orderkey % 2 = 0",
            "completion_reason": "o_orderstatus",
            "fallback_reason": "CASE WHEN o_orderkey % 3 = 0 THEN 'cursor-mismatch' END",
        }),
    "persisted": ("orders", {
            "session_id": "CAST(o_orderkey AS STRING)",
            "revision": "o_orderkey % 4 + 1",
            "attempt": "CASE WHEN o_orderkey % 19 = 0 THEN 'b' ELSE 'a' END",
            "record_count": "o_custkey",
            "byte_offset": "o_custkey * 10 + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END",
            "prefix_hash": "SHA(o_orderkey)",
            "source_hash": "SHA(o_orderkey)",
            "source_bytes": "o_custkey * 10",
            "relative_path": "concat(o_orderpriority, '.md')",
            "markdown_hash": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE SHA(o_orderkey) END",
            "history": "o_orderkey % 2 = 0",
            "completion_reason": "o_orderstatus",
            "fallback_reason": "CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 29 > 0 THEN 'cursor-mismatch' END",
        }),
    "deliveries_made": (
        "events",
        {
            "session_id": "CAST(user_id AS STRING)",
            "endpoint": "CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'main' END",
            "kind": "CASE WHEN event_id % 12 < 7 THEN 'failure' WHEN event_id % 12 = 7 THEN 'success' WHEN event_id % 12 = 8 THEN 'blocked' WHEN event_id % 12 = 9 THEN 'queue' ELSE 'retry' END",
            "at_ms": "MS(ts)",
            "key": "lpad(CAST(event_id AS STRING), 12, '0')",
            "revision": "event_id % 6",
            "hash": "event_type",
            "category": "CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'refused' END",
            "forced": "event_id % 5 = 0",
        },
    ),
    "tool_texts": (
        "documents",
        {
            "session_id": "doc_id % 211",
            "tool": "CASE doc_id % 6 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Bash' WHEN 2 THEN 'NotebookEdit' WHEN 3 THEN 'Read' WHEN 4 THEN 'Write' END",
            "path": "CASE WHEN doc_id % 6 = 0 OR doc_id % 6 = 3 THEN concat('/a/', source, '/', lang, '.py') WHEN doc_id % 6 = 4 THEN substr(text, 1, 30) END",
            "notebook": "CASE WHEN doc_id % 6 = 2 THEN concat('nb/', lang, CAST(doc_id % 7 AS STRING)) END",
            "command": "CASE WHEN doc_id % 6 = 1 THEN substr(text, 3, 40) END",
            "result": "CASE WHEN doc_id % 2 = 1 THEN concat(CASE WHEN doc_id % 3 = 0 THEN 'error[E1]: ' ELSE 'ok' END, substr(text, 1, 90), chr(10), ' ', chr(10), CASE doc_id % 5 WHEN 0 THEN 'FAILED ' WHEN 1 THEN '  TypeError : ' WHEN 2 THEN 'a::HttpError: ' WHEN 3 THEN 'panicked at ' ELSE 'thiserror: ' END, substr(text, 20, 100), chr(10), 'no such file or directory', chr(10), 'FAIL') END",
            "summary": "CASE WHEN doc_id % 4 > 0 THEN substr(text, 1, 400) END",
        },
    ),
    "tool_events": ("events", {"session_id": "user_id", "seq": "event_id", "call_id": "CASE WHEN event_id % 17 > 0 THEN 'c' || CAST(event_id * 7 % 23 % 5 AS STRING) END", "phase": "CASE WHEN event_type IN ('error', 'purchase') OR (event_type = 'view' AND event_id % 2 = 0) THEN 'result' ELSE 'call' END"}),
    "session_events": (
        "events",
        {
            "source": "'hook'",
            "session_id": "CAST(user_id AS STRING)",
            "kind": "CASE WHEN event_id % 16 < 1 THEN 'agent-stop' WHEN event_id % 16 < 3 THEN 'session-end' WHEN event_id % 16 < 8 THEN 'claim' WHEN event_id % 16 < 12 THEN 'failure' WHEN event_id % 16 < 14 THEN 'success' WHEN event_id % 48 < 15 THEN 'placeholder' WHEN event_id % 48 < 16 THEN 'deferral' WHEN event_id % 48 < 31 THEN 'accepted-loss' WHEN event_id % 48 < 32 THEN 'retry' WHEN event_id % 96 < 48 THEN 'other' ELSE 'retry' END",
            "at_ms": "MS(ts)",
            "key": "lpad(CAST(event_id AS STRING), 12, '0')",
            "path": "CASE WHEN event_id % 5 > 0 THEN 'p' || CAST(event_id AS STRING) END",
            "reason": "CASE event_id % 5 WHEN 0 THEN 'user_exit' WHEN 1 THEN 'crash' ELSE 'complete' END",
            "attempt": "CASE WHEN event_id % 16 BETWEEN 3 AND 7 THEN CAST(event_id AS STRING) WHEN event_id % 37 = 0 THEN 'another' END",
            "lease_ms": "360000 * (event_id % 700)",
            "category": "CASE event_id % 11 WHEN 0 THEN 'source-missing' WHEN 1 THEN 'source-failed' ELSE 'summarizer-failed' END",
            "retryable": "event_id % 13 <> 0",
            "forced": "event_id % 9 = 0",
        },
    ),
    "records": (
        "conversations",
        {"session_id": "conv_id", "record": "turn", "role": "role", "content": "text", "content_bytes": "BYTES(text)"},
    ),
    "outputs": (
        "documents",
        {"seq": "doc_id", "label": "lang", "content": "text", "bytes": "BYTES(text)", "sha256": "SHA(text)", "agent": "source", "version": "doc_id % 3 + 1"},
    ),
}


def _said(text: str, engine: int) -> str:
    for name, forms in DIALECT.items():
        text = text.replace(name, forms[engine])
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{_said(e, 0)} AS {c}" for c, e in columns.items()))


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL over the named views."""
    parts = []
    for n in names:
        table, columns = VIEWS[n]
        parts.append(f"v_{n} AS (SELECT {', '.join(f'{_said(e, 1)} AS {c}' for c, e in columns.items())} FROM {table})")
    return f"WITH {', '.join(parts)} {sql}"
