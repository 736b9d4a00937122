"""Attempts: outcomes in time bins, reports, budgets, leases and failure streaks.

Every clock is a parameter in epoch milliseconds. Frames of attempts have id,
session_id, state_generation, started_at_ms, finished_at_ms,
lease_expires_at_ms, outcome and error_category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_MS = 30 * 60 * 1000
HOUR_MS = 60 * 60 * 1000
WINDOW_MS = 6 * HOUR_MS
#: The outcomes that are charted, in their order.
CHARTED = ("succeeded", "failed", "recovered", "superseded")
#: Minutes until a failed session is tried again, by the length of its failure streak.
RETRY_MINUTES = (10, 30, 90, 240, 1440)
PARKED = -1


def _binned(attempts: DataFrame, time: Column, start: int, end: int) -> DataFrame:
    """Counts by bin and outcome of [start, end), with a row for every bin. The spine is as long as the window, whatever the data."""
    at = attempts.select(time.alias("at"), "outcome").where(F.col("at").between(start, end - 1) & F.col("outcome").isin(*CHARTED))
    counts = at.groupBy((F.col("at") - F.pmod(F.col("at"), F.lit(BIN_MS))).alias("bin_start_ms")).agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in CHARTED))
    spine = attempts.sparkSession.range(start, end, BIN_MS, 1).toDF("bin_start_ms")
    return spine.join(counts, "bin_start_ms", "left").na.fill(0, list(CHARTED))


def outcome_bins(attempts: DataFrame, now_ms: int) -> DataFrame:
    """Finished attempts of the last six hours in half-hour bins; the running bin is the thirteenth."""
    start = (now_ms - WINDOW_MS) // BIN_MS * BIN_MS
    return _binned(attempts, F.col("finished_at_ms"), start, (now_ms // BIN_MS + 1) * BIN_MS)


def desktop_outcome_bins(attempts: DataFrame, now_ms: int) -> DataFrame:
    """Twelve bins that end at now rounded up; unfinished attempts count where they started."""
    newest = -(-now_ms // BIN_MS) * BIN_MS
    return _binned(attempts, F.coalesce("finished_at_ms", "started_at_ms"), newest - WINDOW_MS, newest)


def attempt_report(attempts: DataFrame, sessions: DataFrame, since_ms: int | None = None, limit: int = 50) -> DataFrame:
    """Attempts with their sessions: finished ones first, newest first; with since_ms only those that ended (or, if unfinished, began) from then on."""
    rows = attempts if since_ms is None else attempts.where(F.coalesce("finished_at_ms", "started_at_ms") >= since_ms)
    names = sessions.select(F.col("id").alias("session_id"), "source_kind", "source_session_id")
    joined = rows.join(names, "session_id").select("id", "source_kind", "source_session_id", "outcome", "started_at_ms", "finished_at_ms")
    return joined.orderBy(F.col("finished_at_ms").isNull(), F.desc("finished_at_ms"), F.desc("id")).limit(limit)


def outcome_counts(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("outcome").agg(F.count("*").alias("n"), F.count("finished_at_ms").alias("n_finished"))


def budget_counts(attempts: DataFrame, now_ms: int, hourly: int, daily: int) -> DataFrame:
    """Calls of each session in the last hour and day, and the verdict: the hour's limit is looked at first, a limit reached is exhausted."""
    called = attempts.where(F.col("started_at_ms").between(now_ms - 24 * HOUR_MS, now_ms)).groupBy("session_id")
    counts = called.agg(F.count_if(F.col("started_at_ms") >= now_ms - HOUR_MS).alias("last_hour"), F.count("*").alias("last_day"))
    return counts.withColumn("verdict", F.when(F.col("last_hour") >= hourly, "hourly-limit").when(F.col("last_day") >= daily, "daily-limit").otherwise("allowed"))


def active_leases(attempts: DataFrame, now_ms: int) -> DataFrame:
    """One row: unfinished attempts whose lease still runs."""
    return attempts.agg(F.count_if(F.col("finished_at_ms").isNull() & (F.col("lease_expires_at_ms") > now_ms)).alias("active_leases"))


def capture_failures(attempts: DataFrame, now_ms: int, newest: int = 500, least: int = 5) -> DataFrame:
    """One row: failures of a source within a day among the newest attempts, and whether they are enough to warn."""
    recent = attempts.orderBy(F.col("finished_at_ms").isNull(), F.desc("finished_at_ms"), F.desc("id")).limit(newest)
    hit = (F.col("outcome") == "failed") & F.col("error_category").startswith("source-") & (F.col("finished_at_ms") >= now_ms - 24 * HOUR_MS)
    return recent.agg(F.count_if(hit).alias("failures")).withColumn("warn", F.col("failures") >= least)


def failure_streaks(attempts: DataFrame) -> DataFrame:
    """Failed attempts with the length of their streak so far: it begins anew when a session's category or generation changes.

    Windows are per session and hold only failed attempts; a session's attempts
    are spaced by the retry schedule, so none is large.
    """
    by = Window.partitionBy("session_id").orderBy("id")
    failed = attempts.where("outcome = 'failed'").select("id", "session_id", "state_generation", "error_category")
    same = F.col("error_category").eqNullSafe(F.lag("error_category").over(by)) & F.col("state_generation").eqNullSafe(F.lag("state_generation").over(by))
    islands = failed.withColumn("island", F.sum(F.when(same, 0).otherwise(1)).over(by))
    streak = F.row_number().over(Window.partitionBy("session_id", "island").orderBy("id")).cast("long")
    return islands.select("id", "session_id", "error_category", streak.alias("streak"))


def retry_at(streak: Column, failed_at_ms: Column, retryable: Column) -> Column:
    """When a failure is tried again by the schedule; PARKED at the fifth in a row or if it can't be."""
    minutes = F.element_at(F.array(*(F.lit(x) for x in RETRY_MINUTES)), F.least(F.greatest(streak, F.lit(1)), F.lit(len(RETRY_MINUTES))).cast("int"))
    return F.when(retryable & (streak < len(RETRY_MINUTES)), failed_at_ms + minutes * F.lit(60_000)).otherwise(F.lit(PARKED)).cast("long")


def sink_backoff_ms(attempts: Column) -> Column:
    """A minute doubled with each attempt after the first, an hour at most."""
    doubled = F.lit(60_000) * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(16)))
    return F.least(doubled, F.lit(HOUR_MS)).cast("long")


def eligible_sessions(sessions: DataFrame, attempts: DataFrame, now_ms: int, limit: int = 32) -> DataFrame:
    """Sessions a worker may take, in fair order: pending ones, failed ones whose retry is due, and those whose lease ran out."""
    expired = attempts.where(F.col("finished_at_ms").isNull() & (F.col("lease_expires_at_ms") <= now_ms)).select(F.col("session_id").alias("id")).distinct().withColumn("expired", F.lit(True))
    last = attempts.groupBy(F.col("session_id").alias("id")).agg(F.max("started_at_ms").alias("last_start"))
    due = F.col("lifecycle_state").isin("summary-pending", "revision-pending", "interrupted") | ((F.col("lifecycle_state") == "failed") & F.col("next_retry_at_ms").between(0, now_ms))
    rows = sessions.join(expired, "id", "left").where(due | ((F.col("lifecycle_state") == "processing") & F.col("expired")))
    order = rows.join(last, "id", "left").select("id", "lifecycle_state", F.coalesce("next_retry_at_ms", F.lit(0)).alias("retry_at"), F.coalesce("last_start", F.lit(0)).alias("last_start"))
    return order.orderBy("retry_at", "last_start", "id").limit(limit)
