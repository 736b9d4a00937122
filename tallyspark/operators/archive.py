"""Archived records as Markdown with front matter: rendered by Spark expressions, parsed strictly, scanned from a folder.

A record is one row (RECORD). `parse(render(x))` gives x back. A text that isn't
such a record is a row with an error's code, never an abort; of several errors
the first in the order of reading is given.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyspark.sources.files import opened

from .reports import ITEM_LIMIT, LIST_LIMIT, SUMMARY_LIMITS, TAG_LIMIT, any_invalid, invalid_text

#: Harness, its name in a record, the start of a record's id.
AGENTS = {"copilot": "copilot-cli", "claude-code": "claude-code", "codex": "codex-cli"}
#: What some fields may hold.
COMPLETIONS = ("complete", "interrupted", "unknown")
FALLBACKS = ("cursor-mismatch", "normalizer-changed", "source-truncated")
ORIGINS = ("live", "recorded")
#: A body's lists with their headings, in order.
LISTS = {"work_completed": "Work completed", "decisions": "Decisions", "files_changed": "Files changed", "commands_and_validation": "Commands and validation", "open_items": "Open items"}
NOTHING = "- None."
#: The front matter's scalars in their order: (key, kind). From schema 2 on those of SECOND are there.
SCALARS = (
    ("schema_version", "int"), ("id", "text"), ("agent", "text"), ("session_id", "text"), ("project", "text"), ("project_identity", "text"), ("project_component", "text"), ("project_origin", "text"),
    ("repository", "text"), ("branch", "text"), ("started_at", "text"), ("updated_at", "text"), ("completion_reason", "text"), ("cursor_fallback_reason", "text"), ("summary_revision", "int"), ("source_cursor", "int"),
    ("normalizer_version", "int"), ("source_cursor_records", "int"), ("source_cursor_bytes", "int"), ("source_prefix_hash", "text"), ("source_bytes", "int"), ("source_hash", "text"), ("artifact_set_version", "int"), ("transcript_sha256", "text"), ("summary_placeholder", "flag"),
)
SECOND = ("normalizer_version", "source_cursor_records", "source_cursor_bytes", "source_prefix_hash", "source_bytes")
ALWAYS = ("schema_version", "id", "agent", "session_id", "project", "project_identity", "summary_revision", "source_cursor", "source_hash")
#: Depth of folders that are scanned.
DEPTH = 3

OUTPUT = "struct<sha256: string, bytes: bigint, label: string>"
RECORD = (
    "schema_version int, source string, session_id string, project string, project_identity string, project_component string, project_origin string, repository string, branch string, started_at string, updated_at string, "
    "completion_reason string, cursor_fallback_reason string, summary_revision bigint, source_cursor bigint, normalizer_version bigint, source_cursor_bytes bigint, source_prefix_hash string, source_bytes bigint, source_hash string, "
    f"artifact_set_version bigint, transcript_sha256 string, summary_placeholder boolean, extracted_outputs array<{OUTPUT}>, tags array<string>, title string, goal string, " + ", ".join(f"{x} array<string>" for x in LISTS)
)
_HASH = re.compile(r"sha256:[0-9a-f]{64}")


def _by_agent(source: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in AGENTS.items() for x in pair)), source)


def quoted(text: Column) -> Column:
    """Text as a JSON string; null stays null."""
    inside = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(inside, F.lit(2), F.length(inside) - 2))


# ---- rendering


def rendered(record: Callable[[str], Column] = F.col) -> Column:
    """The Markdown of a record; record gives a column by its name in RECORD.

    Null fields have no line; schema 1 has neither component, cursor nor index
    of outputs; a live origin and a summary that is no placeholder aren't said.
    """
    second = record("schema_version") >= 2
    values: dict[str, Column] = {
        "id": F.concat(record("source"), F.lit(":"), record("session_id")),
        "agent": _by_agent(record("source")),
        "project_origin": F.when(record("project_origin") == "recorded", record("project_origin")),
        "source_cursor_records": record("source_cursor"),
        "summary_placeholder": F.when(record("summary_placeholder"), F.lit("true")),
    }
    newer = (*SECOND, "project_component", "artifact_set_version", "transcript_sha256")
    lines = [F.lit("---")]
    for key, kind in SCALARS:
        if key == "summary_placeholder":
            lines.append(F.when(second, _block("extracted_outputs", record("extracted_outputs"), lambda o: F.concat(F.lit("sha256:"), o["sha256"], F.lit(" bytes:"), o["bytes"].cast("string"), F.lit(" label:"), o["label"]))))
        value = values.get(key, record(key) if key not in values else None)
        line = F.concat(F.lit(f"{key}: "), quoted(value) if kind == "text" else value.cast("string"))
        lines.append(F.when(second, line) if key in newer else line)
    lines += [_block("tags", record("tags"), lambda t: t), F.lit("---\n")]
    body = [F.concat(F.lit("# "), record("title")), F.lit("\n## Goal\n"), record("goal")]
    for name, heading in LISTS.items():
        items = F.array_join(F.transform(record(name), lambda x: F.concat(F.lit("- "), x)), "\n")
        body += [F.lit(f"\n## {heading}\n"), F.when(F.size(record(name)) > 0, items).otherwise(F.lit(NOTHING))]
    return F.concat(F.concat_ws("\n", *lines, *body), F.lit("\n"))


def _block(key: str, items: Column, text: Callable[[Column], Column]) -> Column:
    """A list of the front matter; outputs that are null have none."""
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), quoted(text(x)))), "\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{key}:\n"), lines)).when(F.size(items) == 0, F.lit(f"{key}: []"))


# ---- parsing


class _Bad(Exception):
    """Carries the code of what is wrong."""


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _text(value: str) -> str:
    try:
        found = json.loads(value, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        found = None
    if not isinstance(found, str):
        raise _Bad("bad-string")
    return found


def _number(value: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", value) or int(value) >= 1 << 63:
        raise _Bad("bad-number")
    return int(value)


def _flag(value: str) -> bool:
    if value not in ("true", "false"):
        raise _Bad("bad-flag")
    return value == "true"


_READ: dict[str, Callable[[str], Any]] = {"text": _text, "int": _number, "flag": _flag}


def _output(value: str) -> dict:
    found = re.fullmatch(r"(?:(?:sha256:(?P<sha256>[0-9a-f]{64})|bytes:(?P<bytes>[0-9]+)|label:(?P<label>[^ ]+))(?: |$)){3}", _text(value))
    if found is None or None in found.groupdict().values() or value.endswith(' "'):
        raise _Bad("bad-output")
    return found.groupdict() | {"bytes": _number(found["bytes"])}


def _front(text: str) -> tuple[dict[str, str], dict[str, list]]:
    scalars: dict[str, str] = {}
    lists: dict[str, list] = {"tags": [], "extracted_outputs": []}
    open_list = None
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if open_list and line.startswith("  - "):
            lists[open_list].append((_text if open_list == "tags" else _output)(line[4:]))
            continue
        open_list = line[:-1] if line[-1:] == ":" and line[:-1] in lists else None
        if open_list:
            continue
        key, colon, value = line.partition(": ")
        if not colon or (key in lists and value != "[]"):
            raise _Bad("bad-line")
        if key not in lists:
            scalars[key] = value
    return scalars, lists


def _body(text: str) -> dict[str, Any]:
    headings = ["Goal", *LISTS.values()]
    if not text.startswith("# "):
        raise _Bad("bad-body")
    parts, rest = [], text[2:]
    for heading in headings:
        before, mark, rest = rest.partition(f"\n\n## {heading}\n\n")
        if not mark:
            raise _Bad("bad-body")
        parts.append(before)
    found: dict[str, Any] = dict(zip(("title", "goal", *LISTS), (*parts, rest), strict=True))
    for name in LISTS:
        items = found[name].rstrip("\n")
        lines = [] if items in (NOTHING, "") else items.split("\n")
        if not all(x.startswith("- ") for x in lines):
            raise _Bad("bad-list")
        found[name] = [x[2:].removesuffix("\r") for x in lines]
    return found


def parse_record(text: str | None) -> dict:
    """RECORD's fields of a text, or {"error": code}."""
    try:
        return _parsed(text or "")
    except _Bad as bad:
        return {"error": str(bad)}


def _parsed(text: str) -> dict:
    if not text.startswith("---\n"):
        raise _Bad("no-front-matter")
    front, mark, body = text[4:].partition("\n---\n\n")
    if not mark:
        raise _Bad("no-front-matter")
    scalars, lists = _front(front)
    found = {key: _READ[kind](scalars[key]) if key in scalars else None for key, kind in SCALARS}

    def need(fine: bool, code: str) -> None:
        if not fine:
            raise _Bad(code)

    version = found["schema_version"]
    for key in ALWAYS:
        need(found[key] is not None, f"missing-{key}")
    need(version in (1, 2), "bad-version")
    source = next((x for x, agent in AGENTS.items() if agent == found["agent"]), None)
    need(source is not None, "unknown-agent")
    need(found["id"] == f"{source}:{found['session_id']}", "id-mismatch")
    need(found["project_origin"] in (None, *ORIGINS), "bad-origin")
    need(found["summary_revision"] > 0, "bad-revision")
    need(bool(found["project"] and found["project_identity"]), "empty-project")
    need(bool(_HASH.fullmatch(found["source_hash"])), "bad-hash")
    need(found["completion_reason"] in (None, *COMPLETIONS), "bad-completion")
    component = found["project_component"] or ""
    need(component not in (".", "..") and not set(component) & {"/", "\\"}, "bad-component")
    need(found["cursor_fallback_reason"] in (None, *FALLBACKS), "bad-fallback")
    if version == 2:
        for key in SECOND:
            need(found[key] is not None, f"missing-{key}")
        need(found["normalizer_version"] > 0 and found["source_cursor_bytes"] == found["source_bytes"], "bad-cursor")
        need(found["source_prefix_hash"] == found["source_hash"], "bad-hash")
        need(found["source_cursor_records"] == found["source_cursor"], "bad-cursor")
    else:
        found |= dict.fromkeys(SECOND)
    need(found["transcript_sha256"] is None or bool(_HASH.fullmatch(found["transcript_sha256"])), "bad-hash")
    found |= lists | _body(body) | {"source": source, "project_component": component, "project_origin": found["project_origin"] or "live", "completion_reason": found["completion_reason"] or "complete", "summary_placeholder": bool(found["summary_placeholder"])}
    return found


def invalid_summary() -> Column:
    """Whether a record's summary breaks a limit; null fields are those of a text that isn't a record."""
    bad = [invalid_text(F.col(f), *limits) for f, limits in SUMMARY_LIMITS.items()]
    for name in (*LISTS, "tags"):
        most = TAG_LIMIT if name == "tags" else ITEM_LIMIT
        bad.append((F.size(name) > LIST_LIMIT) | any_invalid(name, most))
    bad.append(F.size("work_completed") == 0)
    out = bad[0]
    for b in bad[1:]:
        out = out | b
    return out


def parsed(texts: DataFrame, text: str = "markdown", placeholder_tag: str | None = None) -> DataFrame:
    """The rows' other columns with RECORD's fields and `error`, null where the text is a valid record.

    One Arrow pass; what a summary may hold is decided by Spark expressions. A
    summary with the placeholder's tag is one even where no flag says so.
    """
    others = [f for f in texts.schema if f.name != text]
    schema = StructType([*others, *StructType.fromDDL(RECORD + ", error string")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_record(x) for x in batch.column(text).to_pylist()]
            columns = [batch.column(f.name).cast(arrow.field(f.name).type) for f in others]
            columns += [pa.array([x.get(f.name) for x in found], f.type) for f in list(arrow)[len(others) :]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    rows = texts.mapInArrow(run, schema).withColumn("error", F.coalesce("error", F.when(invalid_summary(), "invalid-summary")))
    if placeholder_tag is not None:
        rows = rows.withColumn("summary_placeholder", F.col("summary_placeholder") | F.array_contains("tags", placeholder_tag))
    return rows


# ---- folders


def relative_path(source: Column, component: Column, session_id: Column) -> Column:
    """Where a record lies: component, for other harnesses than copilot the harness, then the session's file."""
    file = F.concat(session_id, F.lit(".md"))
    return F.when(source == "copilot", F.concat_ws("/", component, file)).otherwise(F.concat_ws("/", component, source, file))


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of the Markdown files below a folder, DEPTH folders deep at most.

    Records have relative_path and markdown_hash besides RECORD. A record of
    schema 1 gets its component from its folder. Rejected are (relative_path,
    error): invalid-utf8, a code of `parsed`, or misplaced where a record doesn't
    lie where its own fields say. An empty folder gives no rows.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(root)
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    # both paths without scheme: a listing may write it in other ways
    local = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    relative = F.substring(local, F.lit(len(base.toUri().getPath()) + 2), F.length(local))
    texts = files.select(relative.alias("relative_path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("markdown_hash"), "content").where(F.size(F.split("relative_path", "/")) <= DEPTH + 1)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    broken = texts.where(~valid).select("relative_path", F.lit("invalid-utf8").alias("error"))
    rows = parsed(texts.where(valid).select("relative_path", "markdown_hash", F.col("content").cast("string").alias("markdown")))
    up = F.when(F.col("source") == "copilot", 2).otherwise(3)
    folder = F.try_element_at(F.split("relative_path", "/"), -up)
    component = F.coalesce(F.nullif("project_component", F.lit("")), folder, F.lit("project"))
    rows = rows.withColumn("project_component", component)
    there = F.col("relative_path") == relative_path(F.col("source"), F.col("project_component"), F.col("session_id"))
    rows = rows.withColumn("error", F.coalesce("error", F.when(~there, "misplaced")))
    return rows.where("error is null").drop("error"), broken.unionByName(rows.where("error is not null").select("relative_path", "error"))


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Each row's `markdown` at its `relative_path`, by way of a file beside it that is renamed: (relative_path, markdown_hash).

    An action on the result writes; a file that is written again is replaced as a
    whole. Executors must see the folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            for path, text in zip(batch.column("relative_path").to_pylist(), batch.column("markdown").to_pylist(), strict=True):
                target = f"{base}/{path}"
                folder = target.rsplit("/", 1)[0]
                system.create_dir(folder, recursive=True)
                beside = f"{folder}/.{target.rsplit('/', 1)[1]}.part"
                with system.open_output_stream(beside) as out:
                    out.write(text.encode())
                system.move(beside, target)
            yield batch.select(["relative_path", "markdown_hash"])

    known = rows.select("relative_path", "markdown", F.concat(F.lit("sha256:"), F.sha2("markdown", 256)).alias("markdown_hash"))
    return known.mapInArrow(run, "relative_path string, markdown_hash string")
