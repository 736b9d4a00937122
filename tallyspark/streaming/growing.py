"""Files that grow, as a stream: each is read on from a cursor, anew where the cursor doesn't hold.

`GrowingFiles` is a source that lists what changed; its offset is a time, not a
list of files. `appended` keeps a cursor for each file in the query's state:
bytes and records read, the hash of those bytes and the version of the reader.
A file goes on where all of that holds, and is read in full where it doesn't,
with the same reasons as `operators.reading.reading_mode`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyspark.sources.files import opened, whole_json
from tallyspark.sources.transcripts import MAX_BYTES

FILES = "path string, length bigint, modified_ms bigint"
LINES = "path string, mode string, reason string, code string, record bigint, raw string, read_bytes bigint"
#: Version of the reader that cursors are of.
VERSION = 1
#: Files of one partition of a listing, and lines of one batch of rows.
FILES_EACH, LINES_EACH = 256, 2048


class Listed(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.ending = options["path"], options.get("ending", ".jsonl")

    def _files(self) -> list[tuple[str, int, int]]:
        system, name = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
        prefix = self.folder[: len(self.folder) - len(name)] if self.folder.endswith(name) else ""
        return [(prefix + f.path, f.size, f.mtime_ns // 1_000_000) for f in found if f.type == fs.FileType.File and f.path.endswith(self.ending)]

    def initialOffset(self) -> dict:
        return {"modified_ms": -1}

    def latestOffset(self) -> dict:
        return {"modified_ms": max((at for _, _, at in self._files()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Listed]:
        """Files changed in the time. The start is in it again: a file may change twice in a millisecond, and its cursor tells."""
        files = [f for f in sorted(self._files()) if start["modified_ms"] <= f[2] <= end["modified_ms"]]
        return [Listed(files[i : i + FILES_EACH]) for i in range(0, len(files), FILES_EACH)]

    def read(self, partition: Listed) -> Iterator[tuple]:
        yield from partition.files


class GrowingFiles(DataSource):
    """Files of a folder (`path`, with `ending`), a row whenever one has changed."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return FILES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


class Cursor:
    """A file's reading from a cursor (bytes, records, hash, version), or from none."""

    def __init__(self, at: tuple[int, int, str, int] | None, version: int):
        self.at, self.version = at, version

    def read(self, path: str, length: int, max_bytes: int) -> tuple[dict, list[bytes], tuple | None]:
        """(mode, reason, code and read_bytes; new records; the next cursor) of a file's first `length` bytes."""
        if length > max_bytes:
            return {"mode": "rejected", "reason": None, "code": "source-limit", "read_bytes": 0}, [], self.at
        system, name = opened(path)
        with system.open_input_stream(name) as stream:
            data = stream.read(length)
        offset, mode, reason = 0, "full", None
        if self.at is not None:
            size, records, known, version = self.at
            rest = data[size:]
            went_on = rest and size and data[size - 1 : size] != b"\n" and rest[:1] != b"\n"
            if version != self.version:
                reason = "normalizer-changed"
            elif len(data) < size:
                reason = "source-truncated"
            elif hashlib.sha256(data[:size]).hexdigest() != known or count(data[:size]) != records or went_on:
                reason = "cursor-mismatch"
            else:
                offset, mode = size, "delta"
        end, code = len(data), None
        tail = data[data.rfind(b"\n") + 1 :]
        if tail and not whole_json(tail):
            # what isn't whole yet is left for the next time
            end, code = end - len(tail), "incomplete-trailing-record"
        new = [x for x in data[offset:end].split(b"\n") if x]
        if mode == "delta" and not new:
            mode = "unchanged"
        before = self.at[1] if offset else 0
        done = max(end, offset)
        return {"mode": mode, "reason": reason, "code": code, "read_bytes": done - offset}, new, (done, before + len(new), hashlib.sha256(data[:done]).hexdigest(), self.version)


def count(data: bytes) -> int:
    """Records: lines that aren't empty."""
    return sum(1 for x in data.split(b"\n") if x)


class Appended(StatefulProcessor):
    def __init__(self, version: int, max_bytes: int):
        self.version, self.max_bytes = version, max_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "bytes long, records long, hash string, version int")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        length = max(int(frame["length"].max()) for frame in rows)
        at = tuple(self.cursor.get()) if self.cursor.exists() else None
        try:
            found, new, cursor = Cursor(at, self.version).read(key[0], length, self.max_bytes)
        except OSError:
            found, new, cursor = {"mode": "rejected", "reason": None, "code": "unreadable", "read_bytes": 0}, [], at
        if cursor is not None:
            self.cursor.update(cursor)
        head = (key[0], found["mode"], found["reason"], found["code"])
        columns = [x.split(" ")[0] for x in LINES.split(", ")]
        yield pd.DataFrame([(*head, None, None, found["read_bytes"])], columns=columns).astype(object)
        first = (cursor[1] if cursor else 0) - len(new) + 1
        for i in range(0, len(new), LINES_EACH):
            some = [(key[0], found["mode"], None, None, first + j, raw.decode("utf-8", "replace"), None) for j, raw in enumerate(new[i : i + LINES_EACH], i)]
            yield pd.DataFrame(some, columns=columns).astype(object)


def read_growing(spark: SparkSession, folder: str, ending: str = ".jsonl") -> DataFrame:
    """A stream of FILES: what changed in the folder."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("path", folder).option("ending", ending).load()


def appended(files: DataFrame, version: int = VERSION, max_bytes: int = MAX_BYTES) -> DataFrame:
    """LINES of a stream of FILES: for each file that changed one row that says how it was read (without record), and one for each new record.

    A file over max_bytes or one that can't be read is rejected with a code and
    keeps its cursor; a last record that isn't whole JSON is left for the next
    time, with a code. A file is one task's work, at most max_bytes of it. Needs
    the RocksDB state store.
    """
    return files.groupBy("path").transformWithStateInPandas(Appended(version, max_bytes), LINES, "Append", "None")


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """New records as columns of the schema; what can't be parsed is null in all."""
    return lines.where("record is not null").select("path", "record", F.from_json("raw", schema).alias("x")).select("path", "record", "x.*")


