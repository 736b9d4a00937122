"""How sources are read again, what fits a budget, and totals of restores and memory syncs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import event_chunks

#: Limits of sidecar files: how many, bytes of each, bytes of all of a session.
SIDECAR_FILES, SIDECAR_FILE_BYTES, SIDECAR_TOTAL_BYTES = 64, 1 << 20, 4 << 20
#: Results of restored artifacts that count as written, and states of a memory.
WRITTEN = ("written", "replaced", "would-write", "would-replace")
SYNC_STATES = ("synced", "pending", "failed", "dead-letter", "blocked")


def record_count(text: Column) -> Column:
    """Lines that are not empty."""
    return F.regexp_count(text.cast("string"), F.lit("[^\n]+"))


def reading_mode(content: Column, offset: Column, prefix_hash: Column, records: Column, version: Column, current: int) -> Column:
    """(mode, reason) of reading bytes again after a cursor of an offset, the hash and records before it, and a normalizer's version.

    full without a cursor or where it does not hold: normalizer-changed,
    source-truncated or cursor-mismatch, the first that applies; a line that went
    on is a mismatch too. Else delta, or unchanged where no record is new. Null
    content is empty.
    """
    content = F.coalesce(content, F.lit(b""))
    prefix, rest = F.substring(content, 1, offset.cast("int")), F.substring(content, offset.cast("int") + 1, F.octet_length(content))
    line_feed = F.lit(b"\n")
    went_on = (F.octet_length(rest) > 0) & (offset > 0) & (F.substring(content, offset.cast("int"), F.lit(1)) != line_feed) & (F.substring(rest, 1, 1) != line_feed)
    holds = F.coalesce((F.sha2(prefix, 256) == prefix_hash) & (record_count(prefix) == records), F.lit(False))

    def result(mode: str, reason: str | None = None) -> Column:
        return F.struct(F.lit(mode).alias("mode"), F.lit(reason).cast("string").alias("reason"))

    return (
        F.when(offset.isNull(), result("full"))
        .when(~version.eqNullSafe(F.lit(current)), result("full", "normalizer-changed"))
        .when(F.octet_length(content) < offset, result("full", "source-truncated"))
        .when(~holds | went_on, result("full", "cursor-mismatch"))
        .when(record_count(rest) == 0, result("unchanged"))
        .otherwise(result("delta"))
    )


def within_budget(rows: DataFrame, group: str, order: str, size: str, files: int = SIDECAR_FILES, each: int = SIDECAR_FILE_BYTES, total: int = SIDECAR_TOTAL_BYTES) -> DataFrame:
    """(group, order, taken): in order, what is not too large and still fits is taken until there are enough; what does not fit is skipped, not the end.

    Whether a row fits depends on those taken before, so one pass over each
    group; only sizes go through it, streamed. Null sizes are not taken.
    """
    kind = dict(rows.dtypes)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n, used = None, 0, 0
        for f in frames:
            taken = []
            for key, x in zip(f["key_"], f["size_"], strict=True):
                if key != own:
                    own, n, used = key, 0, 0
                fits = n < files and x <= each and used + x <= total
                n, used = n + fits, used + x * fits
                taken.append(bool(fits))
            yield pd.DataFrame({group: f[group], order: f[order], "taken": taken})

    # a null group is a group too; a null size is over every limit
    slim = rows.select(group, order, F.coalesce(F.col(size).cast("long"), F.lit(each + 1)).alias("size_"), F.to_json(F.struct(group)).alias("key_"))
    return slim.repartition(group).sortWithinPartitions(group, order, "size_").mapInPandas(fold, f"{group} {kind[group]}, {order} {kind[order]}, taken boolean")


def summary_chunks(rows: DataFrame, session: str, order: str, size: str, threshold: int, envelope: int) -> DataFrame:
    """(session, order, chunk): summaries in order, packed greedily into requests whose envelope takes its part of the threshold; each has a separator."""
    return event_chunks(rows.withColumn(size, F.coalesce(F.col(size), F.lit(0)) + 1), session, order, size, max(threshold - envelope, 0))


def restore_totals(snapshots: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row of a restore's totals, of snapshots (status, superseded) and artifacts (result, bytes, finding)."""
    result, finding = F.col("result"), F.coalesce(F.col("finding"), F.lit(False))
    of_snapshots = snapshots.agg(F.count("*").alias("snapshots"), F.coalesce(F.sum("superseded"), F.lit(0)).alias("superseded"), *(F.count_if(F.col("status") == x).alias(x) for x in ("restored", "refused", "skipped", "failed")))
    of_artifacts = artifacts.agg(
        F.count_if(result.isin(*WRITTEN)).alias("artifacts_written"),
        F.coalesce(F.sum(F.when(result.isin(*WRITTEN), F.col("bytes"))), F.lit(0)).alias("bytes_written"),
        F.count_if(result == "present").alias("artifacts_present"),
        F.count_if(result == "refused-differs").alias("artifacts_refused"),
        F.count_if((result == "skipped") & finding).alias("artifacts_skipped"),
        F.count_if((result == "skipped") & ~finding).alias("artifacts_skipped_by_request"),
        F.count_if(result == "failed").alias("artifacts_failed"),
    )
    # one row each
    return of_snapshots.withColumn("one_", F.lit(1)).join(of_artifacts.withColumn("one_", F.lit(1)), "one_").drop("one_")


def sync_counts(memories: DataFrame) -> DataFrame:
    """Memories by state in one row; other states are not counted."""
    return memories.agg(*(F.count_if(F.col("state") == x).alias(x.replace("-", "_")) for x in SYNC_STATES))


def newest_matches(matches: DataFrame, time: str, key: str, limit: int) -> DataFrame:
    """The newest matches, times compared as text, equal ones by the larger key first."""
    return matches.orderBy(F.desc(F.col(time).cast("string")), F.desc(key)).limit(limit)
