"""Source files as rows: what is accepted and what is rejected with a code, and what leading records say.

Nothing is dropped silently: a file that is too large, that changed while it was
read or whose last record isn't whole is a row of the rejected ones.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .transcripts import MAX_BYTES, session_id_of

#: Leading records that are looked at, bytes of one at most, lines and bytes of a workspace file.
LEADING_RECORDS, LEADING_BYTES = 32, 256 << 10
WORKSPACE_LINES, WORKSPACE_BYTES = 64, 64 << 10
#: Codes of rejected files.
TOO_LARGE, CHANGED, INCOMPLETE = "source-limit", "changed-during-read", "incomplete-trailing-record"


def whole_json(text: Any) -> bool:
    """Whether the text is one strict JSON value."""
    try:
        json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError, TypeError):
        return False
    return True


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _whole(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts:
        good = [x is None or whole_json(x) for x in batch.column("tail").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(good, pa.bool_())], ["path", "whole"])


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified_at) of the files, without their content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified_at"))


def read_stable(spark: SparkSession, path: str, source: str, into: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted lines, rejected files) of the files that the path names.

    Lines are (source, session_id, path, line, record, raw), rejected files
    (source, session_id, path, code, length). The content is read once and
    written to `into`, with what the listing said of each file; then the files
    are listed again, and one whose length or time is another now, or that gave
    other bytes than listed, counts as changed. A last record without a line end
    has to be whole JSON. Of several codes the first is given: too large,
    changed, incomplete. Empty files are accepted and have no lines; no files
    give no rows.
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    small = files.where(F.col("length") <= max_bytes).select("path", "length", F.col("modificationTime").alias("modified_at"), F.octet_length("content").cast("long").alias("got"), F.split(text, "\n").alias("lines"))
    small.write.mode("overwrite").parquet(f"{into}/read")
    read = spark.read.schema(small.schema).parquet(f"{into}/read")
    large = listed(spark, path).where(F.col("length") > max_bytes).select("path", "length", F.lit(TOO_LARGE).alias("code"))
    # listed anew: the content is written by now
    now = listed(spark, path).select("path", F.col("length").alias("length_now"), F.col("modified_at").alias("modified_now"))
    same = (F.col("length") == F.col("length_now")) & (F.col("modified_at") == F.col("modified_now")) & (F.col("got") == F.col("length"))
    changed = read.select("path", "length", "modified_at", "got").join(now, "path", "left").where(~F.coalesce(same, F.lit(False))).select("path", "length", F.lit(CHANGED).alias("code"))
    # after the last line end: null where nothing is there
    tails = read.select("path", F.nullif(F.element_at("lines", -1), F.lit("")).alias("tail")).where("tail is not null")
    broken = tails.mapInArrow(_whole, "path string, whole boolean").where("not whole").join(read.select("path", "length"), "path").select("path", "length", F.lit(INCOMPLETE).alias("code"))
    both = changed.unionByName(broken.join(changed, "path", "left_anti"))
    named = lambda rows: rows.select(F.lit(source).alias("source"), session_id_of(F.col("path"), source).alias("session_id"), "path", "*")
    rejected = named(large.unionByName(both).withColumnRenamed("path", "p").withColumn("path", F.col("p"))).select("source", "session_id", "path", "code", "length")
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).cast("long").alias("line"), x.alias("raw")))
    lines = read.join(both.select("path"), "path", "left_anti").select("path", F.posexplode(F.filter(numbered, lambda x: x["raw"] != "")).alias("record", "x"))
    accepted = lines.select(F.lit(source).alias("source"), session_id_of(F.col("path"), source).alias("session_id"), "path", "x.line", (F.col("record") + 1).cast("long").alias("record"), "x.raw")
    return accepted, rejected


# ---- leading records


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Leading:
    """Lines from a file's start, read in small steps; `read` counts the bytes asked for."""

    def __init__(self, path: str, step: int = 16 << 10):
        system, name = opened(path)
        self.stream, self.step, self.read, self.held, self.end = system.open_input_stream(name, buffer_size=0), step, 0, b"", False

    def line(self, most: int) -> bytes | None:
        """The next line without its end; None at the file's end. A line over `most` bytes raises."""
        while (at := self.held.find(b"\n")) < 0 and not self.end and len(self.held) <= most:
            got = self.stream.read(self.step)
            self.read += len(got)
            self.end = not got
            self.held += got
        size = at + 1 if at >= 0 else len(self.held)
        if size > most:
            raise ValueError("line too long")
        if not size:
            return None
        line, self.held = self.held[:size], self.held[size:]
        return line.rstrip(b"\r\n")

    def close(self) -> None:
        self.stream.close()


def fits(source: str, record: dict) -> bool:
    """Whether a harness's record has the keys that tell it, whatever they hold."""
    string = lambda k: isinstance(record.get(k), str)
    if source == "copilot":
        return string("id") and {"timestamp", "parentId"} <= record.keys() and string("type") and isinstance(record.get("data"), dict)
    if source == "claude-code":
        told = isinstance(record.get("message"), dict) or bool({"leafUuid", "sessionId", "uuid"} & record.keys())
        return string("type") and told and "payload" not in record
    return source == "codex" and string("type") and {"timestamp", "payload"} <= record.keys()


def leading_facts(path: str, source: str) -> dict:
    """What a file's leading records say; the first that isn't a JSON object ends the look.

    supported: the first record has the source's keys. cwd (absolute only),
    git_branch and agent_version are the first non-empty ones. Reading stops as
    soon as all are known.
    """
    facts: dict = {"path": path, "supported": False, "cwd": None, "git_branch": None, "agent_version": None, "records": 0}
    keys = {"cwd": "cwd", "git_branch": "gitBranch", "agent_version": "version"} if source == "claude-code" else {}
    leading = Leading(path)
    try:
        for _ in range(LEADING_RECORDS):
            line = leading.line(LEADING_BYTES)
            if line is None:
                break
            if not line:
                continue
            record = json.loads(line, parse_constant=_no_constant)
            if not isinstance(record, dict):
                break
            if not facts["records"]:
                facts["supported"] = fits(source, record)
            facts["records"] += 1
            for name, key in keys.items():
                value = record.get(key)
                if facts[name] is None and isinstance(value, str) and value and (name != "cwd" or posixpath.isabs(value)):
                    facts[name] = value
            if all(facts[name] is not None for name in keys):
                break
    except (ValueError, RecursionError):
        pass
    finally:
        leading.close()
    return facts | {"bytes_read": leading.read}


def workspace_cwd(text: str) -> str | None:
    """The first top-level cwd of a workspace file's leading lines, without quotes, if it is an absolute path."""
    for line in text.split("\n")[:WORKSPACE_LINES]:
        if line.startswith("cwd:"):
            value = line[4:].strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            return value if posixpath.isabs(value) else None
    return None


def workspace_origin(path: str) -> str | None:
    """The cwd that the workspace file beside a transcript gives."""
    system, name = opened(path)
    beside = posixpath.join(posixpath.dirname(name), "workspace.yaml")
    info = system.get_file_info(beside)
    if info.type != fs.FileType.File or info.size > WORKSPACE_BYTES:
        return None
    with system.open_input_stream(beside) as stream:
        try:
            return workspace_cwd(stream.read().decode("utf-8"))
        except UnicodeDecodeError:
            return None


LEADING = "path string, modified_at timestamp, supported boolean, cwd string, git_branch string, agent_version string, records long, bytes_read long"


def read_leading(spark: SparkSession, path: str, source: str) -> DataFrame:
    """LEADING of each file, of its first LEADING_RECORDS lines; executors read only those, files are listed by Spark.

    A file that can't be opened is not supported and says nothing.
    """
    schema = to_arrow_schema(StructType.fromDDL(LEADING))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, at in zip(batch.column("path").to_pylist(), batch.column("modified_at").to_pylist(), strict=True):
                try:
                    facts = leading_facts(name, source)
                    if source == "copilot":
                        facts["cwd"] = workspace_origin(name)
                except OSError:
                    facts = {"path": name, "supported": False, "records": 0, "bytes_read": 0}
                rows.append(facts | {"modified_at": at})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return listed(spark, path).mapInArrow(run, LEADING)


def stale_and_supported(leading: DataFrame, cutoff: Column) -> DataFrame:
    """Files untouched since the cutoff whose first record is the source's."""
    return leading.where((F.col("modified_at") <= cutoff) & F.col("supported"))


def undiscovered(candidates: DataFrame, sessions: DataFrame, source: str) -> DataFrame:
    """Candidate files whose session isn't known yet."""
    named = candidates.withColumn("session_id", session_id_of(F.col("path"), source))
    return named.join(sessions.select(F.col("source_session_id").alias("session_id")), "session_id", "left_anti")
