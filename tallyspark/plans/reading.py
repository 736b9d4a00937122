"""Queries of reading again, budgets and totals, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import reading

from .catalog import query

_REST = "substr(content, length(prefix) + 1)"


@query(
    "w07_reading_modes",
    f"""SELECT id, CASE WHEN reason IS NOT NULL OR NOT has_cursor THEN 'full' WHEN NOT regexp_matches({_REST}, '[^\\n]') THEN 'unchanged' ELSE 'delta' END AS mode, reason FROM (SELECT *, CASE WHEN NOT has_cursor THEN NULL WHEN version <> 2 THEN 'normalizer-changed' WHEN strlen(content) < strlen(prefix) THEN 'source-truncated' WHEN tampered OR NOT starts_with(content, prefix) OR ({_REST} <> '' AND prefix <> '' AND right(prefix, 1) <> chr(10) AND left({_REST}, 1) <> chr(10)) THEN 'cursor-mismatch' END AS reason FROM v_cursors)""",
    "cursors",
)
def _(c: DataFrame) -> DataFrame:
    prefix = F.encode("prefix", "UTF-8")
    offset = F.when(F.col("has_cursor"), F.octet_length(prefix))
    known = F.when(F.col("tampered"), F.lit("other")).otherwise(F.sha2(prefix, 256))
    found = reading.reading_mode(F.encode("content", "UTF-8"), offset, known, reading.record_count(F.col("prefix")), F.col("version"), 2)
    return c.select("id", found.alias("x")).select("id", "x.mode", "x.reason")


_TURNS = "SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY {1}) AS k FROM {2}"


@query(
    "w06_sidecar_budget",
    f"SELECT session_id, id, taken FROM (WITH RECURSIVE r AS ({_TURNS.format('session_id', 'id', 'v_ledger')}), f AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, 0 AS n, CAST(0 AS BIGINT) AS used, false AS taken FROM v_ledger UNION ALL SELECT session_id, k, id, n + fits::INT, used + CASE WHEN fits THEN bytes ELSE 0 END, fits FROM (SELECT r.session_id, r.k, r.id, f.n, f.used, r.bytes, f.n < 4 AND r.bytes <= 3500 AND f.used + r.bytes <= 9000 AS fits FROM f JOIN r ON r.session_id = f.session_id AND r.k = f.k + 1)) SELECT * FROM f) WHERE k > 0",
    "ledger",
)
def _(x: DataFrame) -> DataFrame:
    return reading.within_budget(x, "session_id", "id", "bytes", 4, 3500, 9000)


@query(
    "w03_summary_chunks",
    f"SELECT session_id, id, chunk FROM (WITH RECURSIVE r AS ({_TURNS.format('session_id', 'id', 'v_ledger')}), f AS (SELECT session_id, k, id, CAST(0 AS BIGINT) AS chunk, bytes + 1 AS used FROM r WHERE k = 1 UNION ALL SELECT r.session_id, r.k, r.id, f.chunk + CASE WHEN f.used + r.bytes + 1 > 5000 THEN 1 ELSE 0 END, CASE WHEN f.used + r.bytes + 1 > 5000 THEN 0 ELSE f.used END + r.bytes + 1 FROM f JOIN r ON r.session_id = f.session_id AND r.k = f.k + 1) SELECT * FROM f)",
    "ledger",
)
def _(x: DataFrame) -> DataFrame:
    return reading.summary_chunks(x, "session_id", "id", "bytes", 6000, 1000)


@query(
    "a16_restore_totals",
    "SELECT * FROM (SELECT count(*) AS snapshots, CAST(sum(superseded) AS BIGINT) AS superseded, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in ("restored", "refused", "skipped", "failed"))
    + " FROM v_restored_snapshots), (SELECT count(*) FILTER (WHERE kind < 4) AS artifacts_written, CAST(sum(bytes) FILTER (WHERE kind < 4) AS BIGINT) AS bytes_written, count(*) FILTER (WHERE kind = 4) AS artifacts_present, count(*) FILTER (WHERE kind = 5) AS artifacts_refused, count(*) FILTER (WHERE kind = 6 AND finding) AS artifacts_skipped, count(*) FILTER (WHERE kind = 6 AND finding IS NOT TRUE) AS artifacts_skipped_by_request, count(*) FILTER (WHERE kind = 7) AS artifacts_failed FROM v_restored_artifacts)",
    "restored_snapshots",
    "restored_artifacts",
)
def _(s: DataFrame, a: DataFrame) -> DataFrame:
    return reading.restore_totals(s, a)


@query("a19_sync_counts", "SELECT " + ", ".join(f"count(*) FILTER (WHERE state = '{x}') AS {x.replace('-', '_')}" for x in reading.SYNC_STATES) + " FROM v_deliveries", "deliveries")
def _(d: DataFrame) -> DataFrame:
    return reading.sync_counts(d)


@query("t07_newest_matches", "SELECT seq, label FROM v_outputs ORDER BY label DESC, seq DESC LIMIT 40", "outputs")
def _(o: DataFrame) -> DataFrame:
    return reading.newest_matches(o.select("seq", "label"), "label", "seq", 40)
