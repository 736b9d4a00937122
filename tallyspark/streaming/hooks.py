"""Hook events as a stream: deduplicated, folded into one lifecycle row for each session.

Events may come twice, late or out of order. The fold keeps the largest times
and the path of the newest stop, so any order of the same events gives the same
times. Duplicates are told by a key; state for keys lives as long as the
watermark, so one that returns later than that counts as new. `lifecycle` is
the same fold over a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.functions.scalars import dedupe_key

from .tables import KeyedTable

SCHEMA = "source string, session_id string, kind string, at_ms bigint, path string, reason string"
MAX_EVENT_BYTES = 64 << 10
#: How an end's reason is read.
COMPLETION = {"complete": "complete", "user_exit": "interrupted"}


def classified(lines: DataFrame) -> DataFrame:
    """Lines (value) with the event x of each and, where there is none, a code: too-large, not-an-object or no-session."""
    size, x = F.octet_length("value"), F.from_json("value", SCHEMA)
    rows = lines.withColumn("x", F.when(size <= MAX_EVENT_BYTES, x))
    unnamed = F.col("x.session_id").isNull() | F.col("x.at_ms").isNull()
    plain = ~F.coalesce(F.trim("value").startswith("{") & F.trim("value").endswith("}"), F.lit(False))
    return rows.withColumn("code", F.when(size > MAX_EVENT_BYTES, "too-large").when(plain, "not-an-object").when(unnamed, "no-session"))


def read_hooks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the folder's events, one JSON object a line; other lines are those of `rejected_hooks`."""
    return keyed(classified(_lines(spark, folder)).where("code is null").select("x.*"))


def rejected_hooks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, code, length, hash) of the folder's lines that give no event; what they hold is not repeated."""
    rows = classified(_lines(spark, folder)).where("code is not null")
    return rows.select("path", "code", F.octet_length("value").cast("long").alias("length"), F.sha2("value", 256).alias("hash"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", 100).text(folder).select("value", F.col("_metadata.file_path").alias("path")).where("value <> ''")


def keyed(events: DataFrame) -> DataFrame:
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "session_id", "kind", "at_ms", "path"))
    return events.withColumn("key", dedupe_key(*parts)).withColumn("at", F.timestamp_millis("at_ms"))


def completion(reason: Column) -> Column:
    out = F.lit("unknown")
    for k, v in COMPLETION.items():
        out = F.when(reason == k, v).otherwise(out)
    return out


def folded(events: DataFrame) -> DataFrame:
    """One row for each session, by partial aggregation: no key's events are gathered."""
    stop, end = F.col("kind") == "agent-stop", F.col("kind") == "session-end"
    rows = events.groupBy("source", "session_id").agg(
        F.count("*").alias("events"),
        F.max(F.when(stop, F.col("at_ms"))).alias("last_agent_stop_ms"),
        F.max(F.when(end, F.col("at_ms"))).alias("last_session_end_ms"),
        F.max(F.when(stop, F.struct("at_ms", "path")))["path"].alias("transcript_path"),
        F.max(F.when(end, F.struct("at_ms", "reason")))["reason"].alias("end_reason"),
        F.max(F.struct("at_ms", "kind"))["kind"].alias("last_kind"),
    )
    done = F.when(completion(F.col("end_reason")) == "complete", "summary-pending").otherwise("interrupted")
    return rows.withColumn("lifecycle_state", F.when(F.col("last_kind") == "session-end", done).otherwise("observed")).drop("last_kind")


def lifecycle(events: DataFrame) -> DataFrame:
    return folded(keyed(events).dropDuplicates(["key"]))


FOLDED = "source string, session_id string, events bigint, last_agent_stop_ms bigint, last_session_end_ms bigint, transcript_path string, end_reason string, lifecycle_state string"


def lifecycle_stream(hooks: DataFrame, table: KeyedTable, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Runs over what is there; sessions that changed go to a table of FOLDED rows keyed by source and session."""
    once = hooks.withWatermark("at", delay).dropDuplicatesWithinWatermark(["key"])
    return folded(once).writeStream.outputMode("update").foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
