"""Queries of archived records over a projection of `orders`, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import archive

from .catalog import query

#: column of RECORD: its expression over v_records_kept, the same in both engines
_FIELDS = {
    "schema_version": "CAST(CASE WHEN id % 4 = 0 THEN 1 ELSE 2 END AS INT)",
    "source": "CASE id % 3 WHEN 0 THEN 'copilot' WHEN 1 THEN 'claude-code' ELSE 'codex' END",
    "session_id": "concat('s-', CAST(id AS STRING))",
    "project": "concat(status, ' \"quoted\" ', priority)",
    "project_identity": "concat('/home/', priority)",
    "project_component": "CASE WHEN id % 4 = 0 THEN '' ELSE concat('p', status) END",
    "project_origin": "CASE WHEN id % 5 = 0 THEN 'recorded' ELSE 'live' END",
    "repository": "CASE WHEN id % 6 = 0 THEN concat('host/', status) END",
    "branch": "CASE WHEN id % 7 = 0 THEN 'main' END",
    "started_at": "CASE WHEN id % 8 <> 0 THEN day END",
    "updated_at": "CAST(NULL AS STRING)",
    "completion_reason": "CASE id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'interrupted' ELSE 'unknown' END",
    "cursor_fallback_reason": "CASE id % 9 WHEN 0 THEN 'source-truncated' WHEN 1 THEN 'cursor-mismatch' END",
    "summary_revision": "id % 5 + 1",
    "source_cursor": "id % 900",
    "normalizer_version": "CASE WHEN id % 4 <> 0 THEN 3 END",
    "source_cursor_bytes": "CASE WHEN id % 4 <> 0 THEN id * 10 END",
    "source_prefix_hash": "CASE WHEN id % 4 <> 0 THEN concat('sha256:', hash) END",
    "source_bytes": "CASE WHEN id % 4 <> 0 THEN id * 10 END",
    "source_hash": "concat('sha256:', hash)",
    "artifact_set_version": "CASE WHEN id % 4 <> 0 THEN 2 END",
    "transcript_sha256": "CASE WHEN id % 4 <> 0 THEN concat('sha256:', hash) END",
    "summary_placeholder": "id % 11 = 0",
    "title": "concat('Order ', CAST(id AS STRING), ' of ', priority)",
    "goal": "CASE WHEN id % 13 = 0 THEN concat('goal\\n\\n', status) ELSE concat('a \\\\ goal: ', status) END",
}
#: What a list holds: items of which the first n are there.
_ITEMS = {"tags": ("id % 3", ("concat('t', status)", "'x y'")), "work_completed": ("id % 2 + 1", ("concat('did ', priority)", "'- more'")), "decisions": ("id % 3", ("'one'", "'two: \"2\"'")), "files_changed": ("0", ()), "commands_and_validation": ("id % 2", ("'run'",)), "open_items": ("id % 2", ("status",))}
#: How a text is spoilt by id % 20: (what stands there, what is put there, the code), from 1 on.
_SPOILT = (("---\\nschema", "--\\nschema", "no-front-matter"), ("schema_version: ", "schema_version: 1", "bad-version"), ("sha256:", "sha256:Z", "bad-hash"), ("\\n\\n## Goal", "\\n\\n# Goal", "bad-body"), ("## Open items\\n\\n", "## Open items\\n\\n* ", "bad-list"), ("id: \"", "id: \"x", "id-mismatch"), ("summary_revision: ", "revision: ", "missing-summary_revision"), ("agent: \"c", "agent: \"d", "unknown-agent"))


def _records(rows: DataFrame) -> DataFrame:
    plain = {n: F.expr(e) for n, e in _FIELDS.items()}
    lists = {n: F.slice(F.array(*(F.expr(x) for x in items)), F.lit(1), F.expr(f"CAST({n_of} AS INT)")) if items else F.array().cast("array<string>") for n, (n_of, items) in _ITEMS.items()}
    outputs = F.when(F.expr("id % 4 <> 0"), F.slice(F.array(F.struct(F.col("hash").alias("sha256"), (F.col("id") + 1).alias("bytes"), F.lit("tool").alias("label"))), F.lit(1), F.expr("CAST(id % 2 AS INT)")))
    return rows.select("id", *(c.alias(n) for n, c in (plain | lists).items()), outputs.alias("extracted_outputs"))


def _spoilt(text: Column) -> Column:
    out = text
    for i, (old, new, _) in enumerate(_SPOILT, 1):
        old, new = (x.replace("\\n", "\n") for x in (old, new))
        at = F.instr(text, old)
        out = F.when((F.col("id") % 20 == i) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))).otherwise(out)
    return out


def _sql(kind: str) -> str:
    """The record's text in DuckDB's SQL over the fields above."""
    e = lambda x: x.replace("\\\\", "\\").replace("\\n", "' || chr(10) || '")
    fields = ", ".join(f"{e(x)} AS {n}" for n, x in _FIELDS.items())
    lists = ", ".join(f"({'[' + ', '.join(items) + ']' if items else '[]::VARCHAR[]'})[1:{n_of}] AS {n}" for n, (n_of, items) in _ITEMS.items())
    agent = "CASE source WHEN 'copilot' THEN 'copilot-cli' WHEN 'codex' THEN 'codex-cli' ELSE source END"
    values = {"id": "source || ':' || session_id", "agent": agent, "project_origin": "CASE WHEN project_origin = 'recorded' THEN project_origin END", "source_cursor_records": "source_cursor", "summary_placeholder": "CASE WHEN summary_placeholder THEN 'true' END"}
    newer = (*archive.SECOND, "project_component", "artifact_set_version", "transcript_sha256")
    lines = []
    for key, what in archive.SCALARS:
        if key == "summary_placeholder":
            lines.append("CASE WHEN schema_version = 2 THEN CASE WHEN key % 2 = 1 THEN 'extracted_outputs:' || chr(10) || '  - \"sha256:' || hash || ' bytes:' || (key + 1) || ' label:tool\"' ELSE 'extracted_outputs: []' END END")
        value = values.get(key, key)
        line = f"'{key}: ' || " + (f"to_json({value})" if what == "text" else f"({value})")
        lines.append(f"CASE WHEN schema_version = 2 THEN {line} END" if key in newer else line)
    lines.append("CASE WHEN len(tags) = 0 THEN 'tags: []' ELSE 'tags:' || chr(10) || array_to_string([('  - ' || to_json(t)) FOR t IN tags], chr(10)) END")
    body = ["'# ' || title || chr(10) || chr(10) || '## Goal' || chr(10) || chr(10) || goal"]
    body += [f"chr(10) || '## {heading}' || chr(10) || chr(10) || CASE WHEN len({n}) = 0 THEN '{archive.NOTHING}' ELSE array_to_string([('- ' || x) FOR x IN {n}], chr(10)) END" for n, heading in archive.LISTS.items()]
    text = f"'---' || chr(10) || concat_ws(chr(10), {', '.join(lines)}) || chr(10) || '---' || chr(10) || chr(10) || concat_ws(chr(10), {', '.join(body)}) || chr(10)"
    return f", fields AS (SELECT id AS key, hash, {fields}, {lists} FROM v_records_kept), texts AS (SELECT *, {text} AS markdown FROM fields) {kind}"


_CODES = " ".join(f"WHEN {i} THEN '{code}'" for i, (_, _, code) in enumerate(_SPOILT, 1))


@query("k02_rendered_records", _sql("SELECT key AS id, strlen(markdown)::BIGINT AS bytes, sha256(markdown) AS hash FROM texts"), "records_kept")
def _(r: DataFrame) -> DataFrame:
    rows = _records(r).select("id", archive.rendered().alias("markdown"))
    return rows.select("id", F.octet_length("markdown").cast("long").alias("bytes"), F.sha2("markdown", 256).alias("hash"))


@query(
    "s12_parsed_records",
    _sql(
        f"SELECT key AS id, error, CASE WHEN error IS NULL THEN to_json([source, session_id, project, project_component, summary_revision::VARCHAR, goal, array_to_string(tags, '|'), array_to_string(open_items, '|')]) END AS fields"
        f" FROM (SELECT *, CASE key % 20 {_CODES} END AS error FROM texts)"
    ),
    "records_kept",
)
def _(r: DataFrame) -> DataFrame:
    texts = _records(r).select("id", archive.rendered().alias("markdown")).select(F.col("id").alias("key"), _spoilt(F.col("markdown")).alias("markdown"))
    found = archive.parsed(texts)
    fields = F.to_json(F.array("source", "session_id", "project", "project_component", F.col("summary_revision").cast("string"), "goal", F.array_join("tags", "|"), F.array_join("open_items", "|")))
    return found.select(F.col("key").alias("id"), "error", F.when(F.col("error").isNull(), fields).alias("fields"))


@query("s12_errors", _sql(f"SELECT error, count(*)::BIGINT AS n FROM (SELECT CASE key % 20 {_CODES} END AS error FROM texts) WHERE error IS NOT NULL GROUP BY 1"), "records_kept")
def _(r: DataFrame) -> DataFrame:
    texts = _records(r).select("id", archive.rendered().alias("markdown")).select("id", _spoilt(F.col("markdown")).alias("markdown"))
    return archive.parsed(texts).where("error is not null").groupBy("error").agg(F.count("*").alias("n"))
