"""Line-delimited JSON transcripts, read losslessly into one record model.

`read_lines` gives a row for each line that isn't empty; `facts` parses every
line once, strictly, into flat typed columns. What the columns mean is decided
in Spark expressions (operators.records). A line that can't be parsed is a row
of status `error`, never an abort. Counters over 2**63-1 read as null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAX_BYTES = 64 << 20
#: Where each harness keeps a record's content.
BODY = {"copilot": "data", "claude-code": "message", "codex": "payload"}
#: Versions of the record set that can be read.
VERSIONS = (1, 2)


def readable(version: Column) -> Column:
    return version.between(*VERSIONS)


def session_id_of(path: Column, source: str) -> Column:
    """The folder's name for copilot's events.jsonl, else the file's name without its ending."""
    stem = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    return F.when((stem == "events") & F.lit(source == "copilot"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).otherwise(stem)


def valid_session_id(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]{1,128}$") & ~name.isin(".", "..")


def read_lines(spark: SparkSession, path: str, source: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(source, session_id, path, line, record, raw): lines split at \\n only; empty ones count as lines, not as records.

    A file is one row until its lines are exploded in the same task, so files
    over max_bytes are left out by their listed length, before they are read;
    `oversized` has them. `files.read_stable` looks at more than the length.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= max_bytes)
    lines = F.transform(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("raw")))
    rows = files.select("path", F.posexplode(F.filter(lines, lambda x: x["raw"] != "")).alias("record", "x"))
    return rows.select(F.lit(source).alias("source"), session_id_of(F.col("path"), source).alias("session_id"), "path", "x.line", (F.col("record") + 1).cast("long").alias("record"), "x.raw")


def oversized(spark: SparkSession, path: str, source: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(source, session_id, path, code, length) of the files that read_lines leaves out."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > max_bytes)
    return files.select(F.lit(source).alias("source"), session_id_of(F.col("path"), source).alias("session_id"), "path", F.lit("source-limit").alias("code"), "length")


class Field(NamedTuple):
    """A field of a tool event: where its value is and how it is read."""

    name: str
    path: tuple[str, ...]
    read: Callable[[Any], str | None]
    required: bool = False


class Shape(NamedTuple):
    """A kind of tool event: its fields, and those derived for search only. `least`: fields it needs besides its name."""

    event: str
    fields: tuple[Field, ...]
    derived: tuple[tuple[Field, str], ...] = ()
    least: int = 0


_NOT_SPACE = "\x1c\x1d\x1e\x1f"


def text(value: Any) -> str | None:
    """A string without white space at its ends; None if nothing is left. U+001C to U+001F are no white space."""
    if not isinstance(value, str):
        return None
    a, b = 0, len(value)
    while a < b and value[a].isspace() and value[a] not in _NOT_SPACE:
        a += 1
    while b > a and value[b - 1].isspace() and value[b - 1] not in _NOT_SPACE:
        b -= 1
    return value[a:b] or None


def string(value: Any) -> str | None:
    return value if isinstance(value, str) else None


def flag(value: Any) -> str | None:
    return str(value).lower() if isinstance(value, bool) else None


def true(value: Any) -> str | None:
    return "true" if value is True else None


def compact(value: Any) -> str | None:
    """A string as text(), anything else as JSON without spaces, keys in their order."""
    if isinstance(value, str):
        return text(value)
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def count(value: Any) -> int | None:
    return value if type(value) is int and 0 <= value < 2**63 else None


def at(value: Any, *path: str) -> Any:
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def flattened(*sources: tuple[str | None, tuple[str, ...]]) -> Callable[[Any], str | None]:
    """A reader of nested results: strings and lists of them; of objects, the first source that applies to their type (None: any)."""

    def read(value: Any) -> str | None:
        if isinstance(value, list):
            return "\n".join(x for x in map(read, value) if x) or None
        if isinstance(value, dict):
            kind = value.get("type")
            found = (read(at(value, *path)) if path == ("content",) else text(at(value, *path)) for k, path in sources if k in (None, kind))
            return next((x for x in found if x), None)
        return text(value)

    return read


#: The typed blocks of results that hold text, and where.
_COPILOT_RESULT = flattened(("text", ("text",)), ("terminal", ("text",)), ("shell_exit", ("outputPreview",)), ("resource", ("resource", "text")))
_CLAUDE_RESULT = flattened(("text", ("text",)))
_CODEX_RESULT = flattened((None, ("content",)), (None, ("text",)))


def _copilot_output(value: Any) -> str | None:
    parts = [text(at(value, "content")), *(_COPILOT_RESULT(x) for x in at(value, "contents") or [])]
    return "\n".join(x for x in parts if x) or None


def _shell_arguments(value: Any) -> str | None:
    try:
        return compact(at(strict(value), "command"))
    except (TypeError, ValueError):
        return None


_CALL = (Field("tool_call_id", ("toolCallId",), string, True), Field("name", ("toolName",), string, True), Field("arguments", ("arguments",), compact))
_COMMAND = (Field("command", ("arguments", "command"), compact), "bash local_shell")
_CODEX_CALL = (Field("call_id", ("call_id",), text, True), Field("name", ("name",), text), Field("arguments", ("arguments",), text))
_CODEX_OUT = Shape("function_call_output", (Field("call_id", ("call_id",), text, True), Field("output", ("output",), _CODEX_RESULT)))
#: The kinds of tool events of each harness; the words after a derived field are the tools it is read for ("": all).
SHAPES: dict[tuple[str, str], Shape] = {
    ("copilot", "tool.execution_start"): Shape("tool.execution_start", _CALL, (_COMMAND,)),
    ("copilot", "tool.user_requested"): Shape("tool.user_requested", _CALL, (_COMMAND,)),
    ("copilot", "tool.execution_complete"): Shape(
        "tool.execution_complete",
        (Field("tool_call_id", ("toolCallId",), string, True), Field("success", ("success",), flag, True), Field("error", ("error", "message"), text), Field("output", ("result",), _copilot_output)),
    ),
    ("copilot", "skill.invoked"): Shape(
        "skill.invoked",
        (Field("name", ("name",), text, True), *(Field(x, (x,), text) for x in ("path", "description", "source", "trigger", "model", "content"))),
        ((Field("skill", ("name",), text), ""),),
    ),
    ("copilot", "external_tool.requested"): Shape("external_tool.requested", (*_CALL, Field("request_id", ("requestId",), text))),
    ("copilot", "external_tool.completed"): Shape("external_tool.completed", (Field("request_id", ("requestId",), text, True),)),
    ("claude-code", "tool_use"): Shape(
        "tool_use",
        (Field("tool_use_id", ("id",), text), Field("name", ("name",), text, True), Field("input", ("input",), compact)),
        ((Field("command", ("input", "command"), compact), "Bash"), (Field("skill", ("input", "skill"), text), "Skill"), (Field("skill_args", ("input", "args"), text), "Skill")),
    ),
    ("claude-code", "tool_result"): Shape("tool_result", (Field("tool_use_id", ("tool_use_id",), text), Field("is_error", ("is_error",), true), Field("output", ("content",), _CLAUDE_RESULT)), least=1),
    ("codex", "function_call"): Shape("function_call", (*_CODEX_CALL, Field("input", ("input",), text)), ((Field("command", ("arguments",), _shell_arguments), "shell"),)),
    ("codex", "custom_tool_call"): Shape("custom_tool_call", (*_CODEX_CALL, Field("input", ("input",), text))),
    ("codex", "function_call_output"): _CODEX_OUT,
    ("codex", "custom_tool_call_output"): _CODEX_OUT,
    ("codex", "local_shell_call"): Shape("local_shell_call", (Field("call_id", ("call_id",), text), Field("command", ("action", "command"), compact)), least=1),
}
#: Token counters of a message's usage, and where they are.
USAGE = {
    "input_tokens": ("input_tokens",),
    "output_tokens": ("output_tokens",),
    "cache_creation_input_tokens": ("cache_creation_input_tokens",),
    "cache_5m_input_tokens": ("cache_creation", "ephemeral_5m_input_tokens"),
    "cache_1h_input_tokens": ("cache_creation", "ephemeral_1h_input_tokens"),
    "cache_read_input_tokens": ("cache_read_input_tokens",),
    "thinking_tokens": ("output_tokens_details", "thinking_tokens"),
}
LABELS = ("service_tier", "speed", "inference_geo")
#: Counters of a context compaction, by harness and record type.
COMPACTIONS: dict[tuple[str, str], tuple[str, tuple[str, ...], dict[str, str]]] = {
    ("copilot", "session.compaction_start"): ("start", ("data",), {"pre_tokens": "currentTokens", "system_tokens": "systemTokens", "conversation_tokens": "conversationTokens", "tool_definition_tokens": "toolDefinitionsTokens", "token_limit": "tokenLimit"}),
    ("copilot", "session.compaction_complete"): ("complete", ("data",), {"pre_tokens": "preCompactionTokens", "post_tokens": "postCompactionTokens", "token_limit": "tokenLimit"}),
    ("claude-code", "system"): ("complete", ("compactMetadata",), {"pre_tokens": "preTokens", "post_tokens": "postTokens"}),
}
_COUNTERS = ("pre_tokens", "post_tokens", "system_tokens", "conversation_tokens", "tool_definition_tokens", "token_limit")

FACTS = (
    "status string, type string, raw_timestamp string, item string, shaped boolean,"
    " events array<struct<kind: string, text: string, fields: map<string, string>, derived: array<string>>>,"
    f" assistant_meta struct<model: string, message_id: string, usage: struct<{', '.join(f'{x}: bigint' for x in USAGE)}, {', '.join(f'{x}: string' for x in LABELS)}>>,"
    f" compaction struct<phase: string, trigger: string, succeeded: boolean, {', '.join(f'{x}: bigint' for x in _COUNTERS)}>,"
    " slash_command struct<name: string, args: string>"
)


def strict(line: str) -> Any:
    """JSON by the standard: no NaN, no infinities; the last of equal keys counts."""

    def refuse(name: str) -> Any:
        raise ValueError(name)

    return json.loads(line, parse_constant=refuse)


def _present(values: dict[str, Any]) -> dict[str, Any] | None:
    return values if any(x is not None for x in values.values()) else None


def _message(kind: str, value: str) -> dict[str, Any]:
    return {"kind": kind, "text": value, "fields": None, "derived": None}


def _tool(source: str, kind: str, body: Any) -> dict[str, Any] | None:
    """The tool event of a body, or None where a required field is missing or too little is there."""
    shape = SHAPES[source, kind]
    found = {}
    for f in shape.fields:
        value = f.read(at(body, *f.path))
        if value is not None and not (f.name == "input" and "arguments" in found):
            found[f.name] = value
        elif f.required:
            return None
    if len(found) < shape.least:
        return None
    extra = {f.name: v for f, tools in shape.derived if (not tools or found.get("name") in tools.split()) and (v := f.read(at(body, *f.path))) is not None}
    if "skill_args" in extra and "skill" not in extra:
        extra = {}
    return {"kind": "tool", "text": None, "fields": [*({"event": shape.event} | found | extra).items()], "derived": sorted(extra)}


def _completed(body: dict[str, Any]) -> bool:
    """Whether the result and error of a finished copilot tool, where present, are well formed."""
    if "error" in body and string(at(body, "error", "message")) is None:
        return False
    if "result" not in body:
        return True
    result = body["result"]
    if not isinstance(result, dict) or not isinstance(result.get("content", ""), str) or not isinstance(result.get("contents", []), list):
        return False
    return "content" in result or any(map(_COPILOT_RESULT, result.get("contents", [])))


def _copilot(record: dict[str, Any], kind: str) -> tuple[bool, list[dict[str, Any]]]:
    body = record.get("data")
    if not isinstance(body, dict):
        return False, []
    if kind in ("user.message", "assistant.message"):
        content = body.get("content")
        shaped = isinstance(content, str) and (kind == "user.message" or isinstance(body.get("messageId"), str))
        said = text(content) if shaped else None
        return shaped, [_message(kind.split(".")[0], said)] if said else []
    if ("copilot", kind) not in SHAPES or (kind == "tool.execution_complete" and not _completed(body)):
        return False, []
    event = _tool("copilot", kind, body)
    return event is not None, [event] if event else []


def _claude(record: dict[str, Any], kind: str) -> tuple[bool, list[dict[str, Any]]]:
    content = at(record, "message", "content")
    if isinstance(content, str):
        return True, [_message(kind, said)] if (said := text(content)) else []
    blocks = [b for b in content if isinstance(b, dict) and isinstance(b.get("type"), str)] if isinstance(content, list) else []
    tool = "tool_use" if kind == "assistant" else "tool_result"
    events = []
    for b in blocks:
        if b["type"] == "text" and (said := text(b.get("text"))):
            events.append(_message(kind, said))
        elif b["type"] == tool and (event := _tool("claude-code", tool, b)):
            events.append(event)
    return bool(blocks), events


def _codex(record: dict[str, Any], item: str | None) -> tuple[bool, list[dict[str, Any]]]:
    body = record.get("payload")
    if item == "message":
        role, content = string(at(body, "role")), at(body, "content")
        parts = [text(b.get("text")) for b in content if isinstance(b, dict) and b.get("type") in ("input_text", "output_text", "text")] if isinstance(content, list) else []
        said = "\n".join(x for x in parts if x)
        speaks = role in ("user", "assistant")
        return role is not None and (speaks or not said), [_message(role, said)] if speaks and said else []
    event = _tool("codex", item, body) if ("codex", item) in SHAPES else None
    return event is not None, [event] if event else []


#: A command's tags, each at most once, and nothing else.
_TAGS = re.compile(r"\s*<command-(name|message|args)>(.*?)</command-\1>", re.S)


def slash_command(content: Any) -> dict[str, Any] | None:
    if not isinstance(content, str):
        return None
    tags: dict[str, str] = {}
    end = 0
    while m := _TAGS.match(content, end):
        if m[1] in tags:
            return None
        tags[m[1]], end = m[2], m.end()
    name = text(tags.get("name"))
    return {"name": name, "args": text(tags.get("args"))} if name and not content[end:].strip() else None


def _meta(source: str, record: dict[str, Any], kind: str) -> dict[str, Any] | None:
    if source == "copilot" and kind == "assistant.message":
        body = record.get("data")
        usage = _present(dict.fromkeys((*USAGE, *LABELS)) | {"output_tokens": count(at(body, "outputTokens"))})
        return _present({"model": text(at(body, "model")), "message_id": text(at(body, "messageId")), "usage": usage})
    if source == "claude-code" and kind == "assistant":
        body = record.get("message")
        usage = _present({k: count(at(body, "usage", *p)) for k, p in USAGE.items()} | {k: text(at(body, "usage", k)) for k in LABELS})
        return _present({"model": text(at(body, "model")), "message_id": text(at(body, "id")), "usage": usage})
    return None


def _compaction(source: str, record: dict[str, Any], kind: str) -> dict[str, Any] | None:
    if (source, kind) not in COMPACTIONS or (kind == "system" and record.get("subtype") != "compact_boundary"):
        return None
    phase, path, names = COMPACTIONS[source, kind]
    body = at(record, *path)
    succeeded = at(body, "success") if kind == "session.compaction_complete" else None
    return {"phase": phase, "trigger": text(at(body, "trigger")), "succeeded": succeeded if isinstance(succeeded, bool) else None} | {x: count(at(body, names[x])) if x in names else None for x in _COUNTERS}


def line_facts(source: str, line: str | None) -> dict[str, Any]:
    """What one line holds, as a row of FACTS."""
    out: dict[str, Any] = dict.fromkeys(("type", "raw_timestamp", "item", "shaped", "events", "assistant_meta", "compaction", "slash_command"))
    try:
        record = strict(line or "")
    except (ValueError, RecursionError):
        return out | {"status": "error"}
    if not isinstance(record, dict):
        return out | {"status": "other"}
    kind, item = string(record.get("type")), None
    out |= {"status": "object", "type": kind, "raw_timestamp": string(record.get("timestamp"))}
    if kind is None:
        return out
    if source == "codex":
        item = string(at(record, "payload", "type"))
        shaped, events = _codex(record, item)
    else:
        shaped, events = (_copilot if source == "copilot" else _claude)(record, kind)
    command = at(record, "message", "content") if kind == "user" else record.get("content") if kind == "system" and record.get("subtype") == "local_command" else None
    return out | {"item": item, "shaped": shaped, "events": events, "assistant_meta": _meta(source, record, kind), "compaction": _compaction(source, record, kind), "slash_command": slash_command(command) if source == "claude-code" else None}


def facts(lines: DataFrame, source_col: str = "source", raw_col: str = "raw") -> DataFrame:
    """The lines with the columns of FACTS, parsed in Arrow batches."""
    schema = StructType([*lines.schema.fields, *StructType.fromDDL(FACTS).fields])
    types = to_arrow_schema(StructType.fromDDL(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [line_facts(s, x) for s, x in zip(batch.column(source_col).to_pylist(), batch.column(raw_col).to_pylist(), strict=True)]
            found = pa.Table.from_pylist(rows, schema=types).combine_chunks()
            new = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *types.names])

    return lines.mapInArrow(run, schema)
