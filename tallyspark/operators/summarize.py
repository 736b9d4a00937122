"""Summaries of sessions too large for one request: chunks, then reductions until one request holds what is left.

A summarizer is a Python function of (phase, request) that gives a summary's
JSON; phases are complete, chunk and reduce. Every level is written to a folder
before the next begins, so no call is made twice for a level that is done, and
a lost executor only repeats its own tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import event_chunks

#: Bytes of a request at most, and of a chunk's events.
THRESHOLD, CHUNK = 2_621_440, 1_572_864
#: Codes of sessions without a summary: a request can't be made small enough, or the summarizer failed.
TOO_LARGE, FAILED = "summary-input-limit", "summarizer-failed"

Summarizer = Callable[[str, str], str]


def request(phase: str, meta: str, items: str, position: int, count: int, carry: str | None) -> str:
    """A request's JSON: `items` are the events or summaries, joined by commas; carry: the chunk's summary before, or the session's former one."""
    return f'{{"phase":"{phase}","session":{meta},"chunk":{position},"chunks":{count},"previous":{carry or "null"},"items":[{items}]}}'


def envelope_bytes(meta: Column, carry: Column, count: Column) -> Column:
    """Bytes of a reduce request without items; position and count have room for all of the count's digits."""
    fixed = len(request("reduce", "", "", 0, 0, "x")) - len("00x")
    return F.octet_length(meta) + F.octet_length(F.coalesce(carry, F.lit("null"))) + 2 * F.length(count.cast("string")) + fixed


def _called(call: Summarizer, phase: str, text: str, threshold: int) -> tuple[str | None, str | None]:
    """(summary, error) of one call; a summary must be JSON."""
    if len(text.encode()) > threshold:
        return None, TOO_LARGE
    try:
        summary = call(phase, text)
        json.loads(summary)
    except Exception:  # whatever the function does wrong is the session's error
        return None, FAILED
    return summary, None


_LEVEL = "session_id string, position long, summary string, error string"


def _mapped(call: Summarizer, threshold: int):
    """Chunks by session in order -> a summary each, with the one before as carry; after an error a session's rest isn't called."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, carry, error = None, None, None
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.session_id != own:
                    own, carry, error = r.session_id, None, None
                if error is None:
                    one = r.count == 1
                    text = request("complete" if one else "chunk", r.meta, r.items, r.position + 1, r.count, r.previous if one else carry)
                    carry, error = _called(call, "complete" if one else "chunk", text, threshold)
                    out.append((r.session_id, r.position, carry, error))
            yield pd.DataFrame(out, columns=["session_id", "position", "summary", "error"])

    return run


def _reduced(call: Summarizer, threshold: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(r.session_id, r.position, *_called(call, "reduce", request("reduce", r.meta, r.items, r.position + 1, r.count, r.carry), threshold)) for r in f.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["session_id", "position", "summary", "error"])

    return run


def _joined(rows: DataFrame, order: str, text: str) -> Column:
    """A group's texts in order, joined by commas; a group is bounded by a request's size."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), ",")


def summarize(events: DataFrame, sessions: DataFrame, call: Summarizer, folder: str, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """(session_id, summary, error, calls, levels) of sessions (session_id, meta: JSON, previous: a former summary's JSON or null).

    events are (session_id, seq, event: JSON); seq is unique in its session. They
    are packed in order into chunks of `chunk` bytes; a chunk's request carries
    the summary of the chunk before. One chunk is one complete request. While the
    reduction of a session's summaries is over `threshold`, they are packed into
    groups and each group is reduced; a session whose groups don't get fewer than
    its summaries, or with a request that no packing makes small enough, has the
    error summary-input-limit. Sessions without events have no row.

    A session's chunks are called one after another, as each needs the one
    before; sessions go in parallel, and so do the groups of a reduction. levels
    counts rounds of calls; there are about log(chunks) of them.
    """
    spark = events.sparkSession
    known = sessions.select("session_id", F.coalesce("meta", F.lit("null")).alias("meta"), "previous")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    sized = events.where("session_id is not null and event is not null").select("session_id", "seq", "event", (F.octet_length("event") + 1).cast("long").alias("size"))
    numbered = event_chunks(sized, "session_id", "seq", "size", min(chunk, threshold)).join(sized, ["session_id", "seq"])
    chunks = kept(numbered.groupBy("session_id", F.col("chunk").alias("position")).agg(_joined(numbered, "seq", "event").alias("items")), "chunks")
    counts = chunks.groupBy("session_id").agg(F.count("*").alias("count"))
    asked = chunks.join(counts, "session_id").join(known, "session_id").select("session_id", "position", "count", "items", "meta", "previous")
    level = kept(asked.repartition("session_id").sortWithinPartitions("session_id", "position").mapInPandas(_mapped(call, threshold), _LEVEL), "level-0")
    single = counts.where("count = 1").select("session_id")
    done = [level.join(single, "session_id").select("session_id", "summary", "error", F.lit(1).alias("levels"))]
    made = [level.groupBy("session_id").agg(F.count("*").alias("calls"))]
    open_ = level.join(single, "session_id", "left_anti")
    for n in range(1, 64):
        failed = open_.where("error is not null").groupBy("session_id").agg(F.min("error").alias("error"))
        done.append(failed.select("session_id", F.lit(None).cast("string").alias("summary"), "error", F.lit(n).alias("levels")))
        rows = open_.join(failed.select("session_id"), "session_id", "left_anti").select("session_id", "position", "summary", (F.octet_length("summary") + 1).cast("long").alias("size"))
        if rows.isEmpty():
            break
        of = rows.groupBy("session_id").agg(F.count("*").alias("count"), F.sum("size").alias("bytes")).join(known, "session_id")
        of = of.withColumn("fits", envelope_bytes(F.col("meta"), F.col("previous"), F.col("count")) + F.col("bytes") - 1 <= threshold)
        budget = F.greatest(F.lit(threshold) - envelope_bytes(F.col("meta"), F.lit(None).cast("string"), F.col("count")), F.lit(0))
        of = kept(of.withColumn("cap", F.when(F.col("fits"), F.lit(1 << 62)).otherwise(budget)), f"sessions-{n}")
        groups = kept(event_chunks(rows.join(of.select("session_id", "cap"), "session_id"), "session_id", "position", "size", "cap"), f"groups-{n}")
        stuck = groups.groupBy("session_id").agg((F.max("chunk") + 1).alias("groups")).join(of, "session_id").where(~F.col("fits") & (F.col("groups") >= F.col("count"))).select("session_id")
        done.append(stuck.select("session_id", F.lit(None).cast("string").alias("summary"), F.lit(TOO_LARGE).alias("error"), F.lit(n).alias("levels")))
        texts = groups.join(stuck, "session_id", "left_anti").join(rows, ["session_id", "position"])
        texts = texts.groupBy("session_id", F.col("chunk").alias("group")).agg(_joined(texts, "position", "summary").alias("items"))
        asked = texts.join(of, "session_id").select("session_id", F.col("group").alias("position"), "count", "items", "meta", F.when(F.col("fits"), F.col("previous")).alias("carry"))
        level = kept(asked.repartition("session_id", "position").mapInPandas(_reduced(call, threshold), _LEVEL), f"level-{n}")
        made.append(level.groupBy("session_id").agg(F.count("*").alias("calls")))
        last = of.where("fits").select("session_id")
        done.append(level.join(last, "session_id").select("session_id", "summary", "error", F.lit(n + 1).alias("levels")))
        open_ = level.join(last, "session_id", "left_anti")
    else:
        raise RuntimeError("reductions that get fewer each time have not ended")
    calls = _united(made).groupBy("session_id").agg(F.sum("calls").alias("calls"))
    return _united(done).join(calls, "session_id", "left").select("session_id", "summary", "error", F.coalesce("calls", F.lit(0)).alias("calls"), "levels")


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
