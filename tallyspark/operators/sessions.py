"""Session listings, reported states, grouped counts and the ledgers that hang on sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error categories of projects that are switched off.
DISABLED = ("project-disabled", "project-override-disabled", "project-override-invalid")
#: Stored states, and the states reported instead of them.
STORED = ("observed", "summary-pending", "interrupted", "revision-pending", "processing", "archived", "failed")
REPORTED = (*STORED, "disabled-project", "delivery-related", "transcript-lost", "not-archive-worthy", "unknown")
QUEUED = ("interrupted", "observed")
PENDING = ("summary-pending", "revision-pending", "interrupted", "observed")
UNKNOWN = "(unknown)"


def reported_state() -> Column:
    """The state a report shows for a stored one; what comes first wins."""
    state, error = F.col("lifecycle_state"), F.coalesce("last_error_category", F.lit(""))
    verdict = F.col("last_session_end_ms").isNotNull() | F.col("not_archive_worthy_at_ms").isNotNull()
    return (
        F.when(error.isin(*DISABLED) & ~state.eqNullSafe(F.lit("archived")), "disabled-project")
        .when((state == "failed") & error.startswith("delivery-"), "delivery-related")
        .when((state == "observed") & F.col("transcript_lost_at_ms").isNotNull(), "transcript-lost")
        .when((state == "observed") & (F.col("current_revision") == 0) & verdict, "not-archive-worthy")
        .when(state.isin(*STORED), state)
        .otherwise("unknown")
    )


def named(column: str) -> Column:
    """The column, or the mark of an unknown name where it is null or empty."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(UNKNOWN))


def with_state(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("state", reported_state())


def state_histogram(sessions: DataFrame) -> DataFrame:
    """One row: all sessions, a count for each reported state, placeholders and parked ones."""
    counts = [F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in REPORTED]
    parked = (F.col("lifecycle_state") == "failed") & (F.col("next_retry_at_ms") < 0)
    return with_state(sessions).agg(F.count("*").alias("total"), *counts, F.count_if("placeholder").alias("placeholders"), F.count_if(parked).alias("parked"))


def by_state_source(sessions: DataFrame) -> DataFrame:
    return with_state(sessions).groupBy("state", named("source_kind").alias("source")).agg(F.count("*").alias("n")).orderBy("state", "source")


def remaining_by_project(sessions: DataFrame) -> DataFrame:
    """Queued sessions of each project, most first, then by name."""
    rows = with_state(sessions).where(F.col("state").isin(*QUEUED))
    return rows.groupBy(named("project").alias("project")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project")


def desktop_remaining(sessions: DataFrame, top: int = 10) -> DataFrame:
    """Pending sessions of each project, unnamed ones as unattributed; the largest projects."""
    label = F.coalesce(F.nullif(F.trim("project"), F.lit("")), F.lit("unattributed"))
    rows = with_state(sessions).where(F.col("state").isin(*PENDING))
    return rows.groupBy(label.alias("project")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(top)


def archived_by_source(sessions: DataFrame) -> DataFrame:
    return with_state(sessions).where("state = 'archived'").groupBy(named("source_kind").alias("source")).agg(F.count("*").alias("n"))


def session_list(sessions: DataFrame, state: str | None = None, limit: int = 50) -> DataFrame:
    """The newest sessions, of one reported state if given."""
    rows = with_state(sessions)
    rows = rows if state is None else rows.where(F.col("state") == state)
    return rows.orderBy(F.desc("updated_at_ms"), F.desc("id")).limit(limit).select("id", "source_kind", "source_session_id", named("project").alias("project"), "state", "current_revision", "updated_at_ms")


def session_list_with_uploads(sessions: DataFrame, uploads: DataFrame, state: str | None = None, limit: int = 50) -> DataFrame:
    """The listing with each session's last upload; the join comes after the limit, and only listed sessions' uploads are aggregated."""
    page = session_list(sessions, state, limit)
    wanted = uploads.join(F.broadcast(page.select(F.col("id").alias("session_id"))), "session_id", "left_semi")
    last = wanted.groupBy(F.col("session_id").alias("id")).agg(F.max("id").alias("upload_id"))
    return page.join(last, "id", "left")


def stale_sessions(sessions: DataFrame, cutoff_ms: int) -> DataFrame:
    """Active sessions that stopped, were not touched since the cutoff and have no end after their stop."""
    open_ = F.col("last_session_end_ms").isNull() | (F.col("last_session_end_ms") < F.col("last_agent_stop_ms"))
    return sessions.where(F.col("active") & F.col("last_agent_stop_ms").isNotNull() & (F.col("updated_at_ms") <= cutoff_ms) & open_).select("id", "last_agent_stop_ms")


def parked_causes(sessions: DataFrame) -> DataFrame:
    """Parked sessions by error category."""
    parked = sessions.where((F.col("lifecycle_state") == "failed") & (F.col("next_retry_at_ms") < 0))
    return parked.groupBy(F.coalesce("last_error_category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


#: What a parked session's error means for a check: size caps, identities, transcripts that are gone.
SIZE_CAPS = ("source-oversized", "summary-input-limit")
MISMATCH, MISSING = "source-id-mismatch", "source-missing"


def parked_checks(sessions: DataFrame) -> DataFrame:
    """(code, n) of the checks that parked sessions give, those without any left out.

    size-cap-parked: a size cap holds them; id-mismatch-parked: their id is not
    their transcript's; of those whose transcript is gone the ones of which
    nothing was ever read, neither archived nor with a cursor, are
    phantom-invocations-parked, the others source-missing-parked.
    """
    parked = sessions.where((F.col("lifecycle_state") == "failed") & (F.col("next_retry_at_ms") < 0))
    error = F.col("last_error_category")
    phantom = (F.coalesce("current_revision", F.lit(0)) == 0) & F.col("cursor_bytes").isNull()
    code = (
        F.when(error.isin(*SIZE_CAPS), "size-cap-parked")
        .when(error == MISMATCH, "id-mismatch-parked")
        .when(error == MISSING, F.when(phantom, "phantom-invocations-parked").otherwise("source-missing-parked"))
    )
    return parked.select(code.alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n"))


def attention(sessions: DataFrame) -> DataFrame:
    """(id, reason) of sessions that a sweep looks at, a row for each reason.

    unresolved: work without a transcript's path; stuck-observed: inactive,
    neither ended nor settled; parked-unarchived: parked with a path and nothing
    archived; oversized-parked: parked on the source's size; settled-lost:
    settled as lost, with a path that may come back.
    """
    state, path = F.col("lifecycle_state"), F.col("transcript_path").isNotNull()
    parked = (state == "failed") & (F.col("next_retry_at_ms") < 0)
    reasons = {
        "unresolved": ~path & state.isin("summary-pending", "revision-pending", "interrupted", "failed"),
        "stuck-observed": ~F.col("active") & (state == "observed") & F.col("last_session_end_ms").isNull() & F.col("transcript_lost_at_ms").isNull(),
        "parked-unarchived": parked & (F.col("current_revision") == 0) & path,
        "oversized-parked": parked & (F.col("last_error_category") == SIZE_CAPS[0]) & path,
        "settled-lost": F.col("transcript_lost_at_ms").isNotNull() & path,
    }
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in reasons.items())), lambda x: x.isNotNull())
    return sessions.select("id", F.explode(found).alias("reason"))


def ledger_status(ledger: DataFrame) -> DataFrame:
    """Rows and bytes of each state of a ledger."""
    return ledger.groupBy("state").agg(F.count("*").alias("n"), saturating_sum("bytes").alias("bytes"), F.max("attempts").alias("most_attempts"))


def saturating_sum(column: str) -> Column:
    """A sum of longs that stays at the largest or smallest long instead of going over; null of no values."""
    most, total = (1 << 63) - 1, F.sum(F.col(column).cast("decimal(28,0)"))
    return F.when(total.isNotNull(), F.greatest(F.least(total, F.lit(most)), F.lit(-most - 1))).cast("long")


def due_uploads(ledger: DataFrame, sessions: DataFrame, endpoint: str, now_ms: int, limit: int = 32) -> DataFrame:
    """Pending and failed rows of an endpoint whose next attempt is due, oldest first, with their sessions."""
    due = (F.col("endpoint") == endpoint) & F.col("state").isin("pending", "failed") & (F.coalesce("next_attempt_at_ms", F.lit(0)) <= now_ms)
    rows = ledger.where(due).select("id", "session_id", "state", "attempts", F.coalesce("next_attempt_at_ms", F.lit(0)).alias("due_at_ms"))
    names = sessions.select(F.col("id").alias("session_id"), "source_kind", "source_session_id")
    return rows.join(names, "session_id").orderBy("due_at_ms", "id").limit(limit)


def backfill(sessions: DataFrame, ledger: DataFrame, endpoint: str) -> DataFrame:
    """Archived sessions without a complete upload at the endpoint: none, an incomplete or outdated one, or an unfinished one that had a revision before."""
    mine = ledger.where(F.col("endpoint") == endpoint).select(F.col("session_id").alias("id"), F.col("state").alias("upload_state"), "snapshot_id", "uploaded_revision", "uploaded_markdown_hash")
    rows = sessions.where("lifecycle_state = 'archived'").join(mine, "id", "left")
    outdated = F.col("snapshot_id").isNull() | ~F.col("uploaded_markdown_hash").eqNullSafe(F.col("markdown_hash"))
    halfway = F.col("uploaded_revision").isNotNull() & F.col("snapshot_id").isNull()
    wanted = F.col("upload_state").isNull() | ((F.col("upload_state") == "uploaded") & outdated) | ((F.col("upload_state") == "pending") & halfway)
    return rows.where(wanted).groupBy("id").agg(F.count("upload_state").alias("uploads"))


def newest_snapshots(snapshots: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key and how many it superseded."""
    best = snapshots.groupBy(key).agg(F.max(order).alias(order), (F.count("*") - 1).alias("superseded"))
    return best


def reconcile(local: DataFrame, remote: DataFrame, endpoint: str, repair_missing: bool = False) -> DataFrame:
    """Uploads of an endpoint against the remote listing, by outcome.

    local: endpoint, snapshot_id, remote_session_id; remote: snapshot_id,
    session_id. In turn: no snapshot; repaired, where it is to be repaired and
    the snapshot is gone remotely; already, where the remote session is known;
    reconciled, where the listing tells it; unmatched.
    """
    listed = remote.groupBy("snapshot_id").agg(F.max("session_id").alias("listed_session"), F.lit(True).alias("listed"))
    rows = local.where(F.col("endpoint") == endpoint).join(listed, "snapshot_id", "left")
    outcome = F.when(F.col("snapshot_id").isNull(), "no-snapshot")
    if repair_missing:
        outcome = outcome.when(F.col("listed").isNull(), "repaired")
    outcome = outcome.when(F.col("remote_session_id").isNotNull(), "already").when(F.col("listed"), "reconciled").otherwise("unmatched")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, one for each key: the one with the largest order, new before old."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("is_new"), F.desc(order)))
    return both.withColumn("rank", rank).where("rank = 1").drop("rank", "is_new")


def inserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows and the new ones whose key isn't there yet, of several the one with the smallest order; what is there stays as it is. Null keys equal each other."""
    there = old.select(*(F.col(k).alias(f"{k}_") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), order).alias("row")).select("row.*")
    return old.unionByName(first.join(there, same, "left_anti").select(old.columns))


def delivered_sessions(deliveries: DataFrame, sessions: DataFrame, endpoint: str, vault: str) -> DataFrame:
    """Deliveries of an endpoint and vault with their sessions, by source and the source's session id."""
    names = sessions.select("id", F.col("source_kind").alias("source"), F.col("source_session_id").alias("name"), "current_revision")
    return deliveries.where((F.col("endpoint") == endpoint) & (F.col("vault") == vault)).join(names, ["source", "name"])
