"""Sanitised captures, profiles of JSON lines, and manifests of snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .artifacts import packed_hash, prefixed, unpacked_hash

#: What a manifest says of a capture and of an artifact, in order.
CAPTURE = ("captured_at", "source_cursor", "source_state_hash", "source_metadata", "project", "repository", "branch", "source_agent_version", "artifact_set_version")
ARTIFACT = ("logical_path", "media_type", "original_size_bytes", "original_sha256", "stored_size_bytes", "stored_sha256", "compression")


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _parsed(text: str | None) -> tuple[bool, Any]:
    """(whether the text is one strict JSON value, the value)."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return False, None


def _compact(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _without_strings(value: Any, replacement: str, keep: frozenset[str]) -> Any:
    if isinstance(value, str):
        return value if value in keep else replacement
    if isinstance(value, list):
        return [_without_strings(x, replacement, keep) for x in value]
    if isinstance(value, dict):
        return {k: _without_strings(x, replacement, keep) for k, x in value.items()}
    return value


def sanitized(lines: DataFrame, raw: str = "raw", replacement: str = "redacted", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows with every string value in their JSON replaced, at any depth, but for those to keep; keys, numbers, true, false and null stay.

    Compact JSON in the order of the keys, of keys that repeat the last; `valid`
    says whether a line was strict JSON, and where it wasn't (null and blank
    lines too) it is replaced by null, as nothing of it is known to be harmless.
    """
    kept = frozenset(keep)
    schema = StructType([*lines.schema, StructField("valid", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_parsed(x) for x in batch.column(raw).to_pylist()]
            texts = [_compact(_without_strings(x, replacement, kept)) if good else None for good, x in found]
            columns = [pa.array(texts, batch.schema.field(n).type) if n == raw else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([good for good, _ in found])], [*batch.schema.names, "valid"])

    return lines.mapInArrow(run, schema)


def profile(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row: bytes, lines, lines that are JSON and those that are objects, of all texts. Lines are parted at line feeds, blank ones count; what follows the last line feed is a line if it isn't empty."""
    lines = _lines(texts, text)
    whole = texts.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_parsed(x) for x in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(found)]), pa.array([sum(g for g, _ in found)]), pa.array([sum(isinstance(x, dict) for _, x in found)])], ["lines", "valid_lines", "objects"])

    counts = lines.mapInArrow(run, "lines long, valid_lines long, objects long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "valid_lines", "objects")))
    return whole.withColumn("one_", F.lit(1)).join(counts.withColumn("one_", F.lit(1)), "one_").drop("one_")


def _lines(texts: DataFrame, text: str) -> DataFrame:
    parts = F.split(F.col(text), "\n")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.explode(whole).alias("raw"))


def discriminators(lines: DataFrame, keys: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """(key, label, n): how often each of the keys has each scalar value, as JSON, in lines that are objects. Lists and objects are no discriminators; a key that no line has gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str]] = []
            for good, x in map(_parsed, batch.column(raw).to_pylist()):
                if good and isinstance(x, dict):
                    out += [(k, _compact(x[k])) for k in keys if k in x and not isinstance(x[k], list | dict)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([v for _, v in out], pa.string())], ["key", "label"])

    return lines.select(raw).mapInArrow(run, "key string, label string").groupBy("key", "label").agg(F.count("*").alias("n"))


def manifests(snapshots: DataFrame, artifacts: DataFrame, key: str, writer: str, schema_version: int = 1, order: str = "position") -> DataFrame:
    """(key, manifest): JSON of each snapshot with its artifacts in order; what is null is said.

    snapshots have source_agent, source_session_id, CAPTURE's columns and
    `<writer>_version`, the version of the program that writes; artifacts have
    ARTIFACT's and an order. A snapshot without artifacts has an empty list; one
    snapshot's artifacts are gathered, as they are one document. Equal places are
    ordered by the artifacts' fields.

    Artifacts are dealt by the key before they are gathered: lists can't be made
    shorter where the rows are read, only sorted and spilled. Hashes are packed
    while they are shuffled, a stored one that is the original's as no bytes.
    """
    original, stored, same = F.col("original_sha256"), F.col("stored_sha256"), F.lit(b"")
    whole = artifacts.withColumns({"original_sha256": prefixed(original), "stored_sha256": prefixed(stored)})
    rows = whole.withColumns({"original_sha256": packed_hash(original), "stored_sha256": F.when(stored == original, same).otherwise(packed_hash(stored))}).select(key, F.col(order).alias("at"), *ARTIFACT)
    lists = rows.repartition(key).groupBy(key).agg(F.collect_list(F.struct("at", *ARTIFACT)).alias("gathered"))

    def entry(x: Column) -> Column:
        hashes = {"original_sha256": x["original_sha256"], "stored_sha256": F.when(x["stored_sha256"] == same, x["original_sha256"]).otherwise(x["stored_sha256"])}
        return F.struct(*((unpacked_hash(hashes[c]) if c in hashes else x[c]).alias(c) for c in ARTIFACT))

    entries = F.array_sort(F.transform("gathered", lambda x: F.struct(x["at"].alias("at"), entry(x).alias("entry"))))
    joined = snapshots.withColumn("source_state_hash", packed_hash(F.col("source_state_hash"))).join(lists, key, "left").withColumn("source_state_hash", unpacked_hash(F.col("source_state_hash")))
    body = F.struct(
        F.lit(schema_version).alias("schema_version"),
        F.struct("source_agent", "source_session_id").alias("session"),
        F.struct(*CAPTURE, f"{writer}_version").alias("capture"),
        F.transform(F.when(F.col("gathered").isNull(), F.array()).otherwise(entries), lambda x: x["entry"]).alias("artifacts"),
    )
    return joined.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("manifest"))


def first_user_events(events: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """(session, content) of each session's first event by a user."""
    return events.where("kind = 'user'").groupBy(session).agg(F.min_by("content", order).alias("content"))


def is_request(text: Column, instructions: tuple[str, ...]) -> Column:
    """Whether the text is a request to a summarizer: the value of its first instruction key begins with one of the known texts."""
    key = '"instruction":"'
    value = F.substring(text, F.instr(text, key) + len(key), F.length(text))
    some = F.lit(False)
    for x in instructions:
        some = some | value.startswith(x)
    return F.coalesce((F.instr(text, key) > 0) & some, F.lit(False))


def exhaust_sessions(events: DataFrame, instructions: tuple[str, ...]) -> DataFrame:
    """Sessions that are a summarizer's own: their first event by a user is a request."""
    return first_user_events(events).where(is_request(F.col("content"), instructions)).select("session_id")
