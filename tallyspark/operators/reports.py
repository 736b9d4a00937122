"""Listings and reports over sessions, diagnostics, deliveries, archives, checks and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a session that want attention (fixed values).
UNHAPPY = ("failed", "interrupted")
#: Limits of a structured summary's fields (fixed values): most characters, single line or not.
SUMMARY_LIMITS = {"title": (200, True), "goal": (4000, False)}
ITEM_LIMIT, TAG_LIMIT, LIST_LIMIT = 4000, 100, 200
#: A directory must have been quiet so long before it is pruned, and so many are pruned at once (fixed values).
QUIET_MS, PRUNE_LIMIT = 600_000, 200


def recent_diagnostics(diagnostics: DataFrame, sessions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest diagnostics with their sessions, those without one too. Only the limited rows are joined."""
    tail = diagnostics.orderBy(F.desc("recorded_at_ms"), F.desc("id")).limit(limit)
    names = sessions.select(F.col("id").alias("session_id"), "source_kind", "source_session_id")
    return tail.join(names, "session_id", "left").select("id", "operation", "category", "recorded_at_ms", "source_kind", "source_session_id")


def newest_first(rows: DataFrame, time: str, sequence: str, limit: int) -> DataFrame:
    """The newest rows, without a time last; equal times keep the order of their sequence."""
    return rows.orderBy(F.desc_nulls_last(time), F.asc(sequence)).limit(limit)


def recent_sessions(sessions: DataFrame, states: tuple[str, ...], limit: int = 12) -> DataFrame:
    """Sessions of some states, newest update first, none counting as 0; equal ones by id."""
    wanted = sessions.where(F.col("lifecycle_state").isin(*states))
    return wanted.orderBy(F.desc(F.coalesce("updated_at_ms", F.lit(0))), "id").limit(limit).select("id", "lifecycle_state", "updated_at_ms")


#: A dashboard's lists: what runs, what was archived or failed last, the newest diagnostics.
RUNNING = ("processing", "summary-pending")
RUNNING_LIMIT, RECENT_LIMIT, DIAGNOSTICS_LIMIT = 20, 10, 5


def dashboard_lists(sessions: DataFrame, attempts: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(list, rank, session_id, source, project, detail, at_ms) of a dashboard's four lists, the newest first, without time last.

    sessions have session_id, source, project, state, title and updated_at_ms;
    attempts session_id, source, project, outcome, error_category and
    finished_at_ms; diagnostics operation, category and recorded_at_ms; all have
    id, by which equal times rank. Rows without session are left out of the
    lists of sessions; an unnamed project is said to be unknown. Each list is a
    top-k of its own: only so many rows of a task are shuffled.
    """
    project = F.coalesce(F.nullif("project", F.lit("")), F.lit("(unknown)"))
    named = F.coalesce(F.col("session_id") != "", F.lit(False))

    def top(rows: DataFrame, name: str, detail: str, time: str, limit: int, session: bool = True) -> DataFrame:
        columns = [F.col("session_id"), F.col("source"), project.alias("project")] if session else [F.lit(None).cast("string").alias(c) for c in ("session_id", "source", "project")]
        first = rows.select("id", *columns, F.col(detail).alias("detail"), F.col(time).alias("at_ms")).orderBy(F.desc_nulls_last("at_ms"), "id").limit(limit)
        ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("at_ms"), "id")))
        return ranked.select(F.lit(name).alias("list"), "rank", "session_id", "source", "project", "detail", "at_ms")

    lists = [
        top(sessions.where(named & F.col("state").isin(*RUNNING)), "processing", "state", "updated_at_ms", RUNNING_LIMIT),
        top(sessions.where(named & (F.col("state") == "archived")), "archived", "title", "updated_at_ms", RECENT_LIMIT),
        top(attempts.where(named & (F.col("outcome") == "failed")), "failures", "error_category", "finished_at_ms", RECENT_LIMIT),
        top(diagnostics.withColumn("said", F.concat_ws("/", "operation", "category")), "diagnostics", "said", "recorded_at_ms", DIAGNOSTICS_LIMIT, session=False),
    ]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3])


def failing_checks(checks: DataFrame) -> DataFrame:
    """Checks that are not ok with their rank, errors first, then warnings, then anything else; in their own order otherwise."""
    rank = F.when(F.col("status") == "error", 0).when(F.col("status") == "warning", 1).otherwise(2)
    return checks.where(F.coalesce(F.col("status") != "ok", F.lit(True))).withColumn("rank", rank).orderBy("rank", "seq")


def latest_archives(records: DataFrame, last_wins: bool = False) -> DataFrame:
    """Of each (source, session_id) the scan_order of the record with the highest revision: of equal ones the first scanned, or the last."""
    place = F.col("scan_order") if last_wins else -F.col("scan_order")
    return records.groupBy("source", "session_id").agg(F.max("revision").alias("revision"), F.max_by("scan_order", F.struct("revision", place)).alias("scan_order"))


def worst_exit_code(codes: Column) -> Column:
    """Of exit codes the worst by rank: verification 6, transport 5, local failure 1, findings 4, anything else clean."""
    rank = F.when(codes == 6, 4).when(codes == 5, 3).when(codes == 1, 2).when(codes == 4, 1).otherwise(0)
    return F.max_by(F.when(rank > 0, codes).otherwise(F.lit(0)), rank)


def combined_status(status: Column) -> Column:
    """error where there is one, else warning where there is one, else ok."""
    return F.when(F.bool_or(F.coalesce(status == "error", F.lit(False))), "error").when(F.bool_or(F.coalesce(status == "warning", F.lit(False))), "warning").otherwise("ok")


def unexpected_versions(rows: DataFrame, version: str, expected: int) -> DataFrame:
    """The other schema versions there are, ascending, in one row."""
    return rows.agg(F.array_sort(F.collect_set(F.when(F.col(version) != expected, F.col(version)))).alias("versions"))


def deliverable(sessions: DataFrame, deliveries: DataFrame, endpoint: str, vault: str, disabled: tuple[str, ...], selection: str = "backfill", force: bool = False) -> DataFrame:
    """Ids of the sessions to deliver: revised, written, of an enabled project, and

    - backfill: without a delivery there, or with one that isn't of the current revision and summary;
    - failed: whose delivery there failed or is blocked, with force also a dead letter.
    """
    ready = sessions.where((F.col("current_revision") > 0) & F.col("markdown_relative_path").isNotNull() & F.col("project").isNotNull() & ~F.col("project").isin(*disabled))
    there = deliveries.where((F.col("endpoint") == endpoint) & (F.col("vault") == vault)).select("session_id", F.col("state").alias("delivery_state"), "delivered_revision", "delivered_summary_hash")
    if selection == "failed":
        states = ("failed", "blocked", "dead-letter") if force else ("failed", "blocked")
        return ready.join(there.where(F.col("delivery_state").isin(*states)), ready["id"] == there["session_id"], "left_semi").select("id")
    rows = ready.join(there, ready["id"] == there["session_id"], "left")
    current = (F.col("delivery_state") == "delivered") & (F.col("delivered_revision") == F.col("current_revision")) & (F.col("delivered_summary_hash") == F.col("markdown_hash"))
    return rows.where(~F.coalesce(current, F.lit(False))).select("id")


def delivery_counts(deliveries: DataFrame) -> DataFrame:
    """Deliveries by state in one row; sink_failed joins failed ones and dead letters."""
    n = {x: F.count_if(F.col("state") == x) for x in ("delivered", "pending", "failed", "dead-letter", "blocked")}
    return deliveries.agg(*(c.alias(x.replace("-", "_")) for x, c in n.items()), (n["failed"] + n["dead-letter"]).alias("sink_failed"))


def sync_eligibility(state: Column, known_hash: Column, next_attempt_ms: Column, manifest_hash: Column, now_ms: int, force: bool = False) -> Column:
    """sync, unchanged or deferred, for the state of a memory and its manifest now; no state is sync."""
    same = known_hash.eqNullSafe(manifest_hash)
    parked = F.when(F.lit(force) | next_attempt_ms.isNull() | (next_attempt_ms <= now_ms), "sync").otherwise("deferred")
    return F.when((state == "synced") & same, "unchanged").when(state == "failed", parked).when((state == "dead-letter") & ~F.lit(force), "unchanged").otherwise("sync")


def directory_measures(files: DataFrame, directory: str = "directory") -> DataFrame:
    """Newest change and bytes of each directory."""
    return files.groupBy(directory).agg(F.max("mtime_ms").alias("newest_ms"), F.sum("bytes").alias("bytes"))


def prunable(files: DataFrame, now_ms: int, retention_ms: int, limit: int = PRUNE_LIMIT) -> DataFrame:
    """Directories older than the retention and quiet, by name, at most so many in a pass."""
    old = (F.col("newest_ms") < now_ms - retention_ms) & (F.col("newest_ms") <= now_ms - QUIET_MS)
    return directory_measures(files).where(old).orderBy("directory").limit(limit)


def prune_totals(files: DataFrame, now_ms: int, retention_ms: int, limit: int = PRUNE_LIMIT) -> DataFrame:
    """One row of a pass: directories it prunes, those that remain (too new, not quiet or over the limit) and the bytes it frees."""
    pruned = prunable(files, now_ms, retention_ms, limit).agg(F.count("*").alias("pruned"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("reclaimed_bytes"))
    every = files.agg(F.count_distinct("directory").alias("directories"))
    both = pruned.withColumn("one_", F.lit(1)).join(every.withColumn("one_", F.lit(1)), "one_")
    return both.select("pruned", (F.col("directories") - F.col("pruned")).alias("remaining"), "reclaimed_bytes")


def undiscovered(candidates: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that no session has yet."""
    return candidates.join(sessions.select(*keys).distinct(), keys, "left_anti")


def purged(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id", set_null: bool = False) -> DataFrame:
    """children after their parents' purge: those of no parent go, or lose the key."""
    there = parents.select(F.col(parent_key).alias(key)).distinct()
    if not set_null:
        return children.join(there, key, "left_semi").select(children.columns)
    left = children.join(there.withColumn("is_there_", F.lit(True)), key, "left").withColumn(key, F.when(F.col("is_there_"), F.col(key)))
    return left.select(children.columns)


def archive_path(source_prefix: Column, component: Column, session_id: Column) -> Column:
    """component/id.md, with the source's prefix between where there is one."""
    return F.concat_ws("/", component, source_prefix, F.concat(session_id, F.lit(".md")))


def invalid_text(value: Column, most: int, single_line: bool) -> Column:
    """Whether a summary's text is not allowed: empty or too long once trimmed, other controls than tab and line feed, a line feed or a heading inside."""
    text = F.regexp_replace(F.regexp_replace(value, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", ""), "\r\n?", "\n")
    breaks = text.contains("\n") if single_line else text.contains("\n## ")
    return F.coalesce((F.char_length(text) == 0) | (F.char_length(text) > most) | text.rlike(r"[\p{Cc}&&[^\n\t]]") | breaks, F.lit(True))


def any_invalid(items: str, most: int) -> Column:
    return F.exists(items, lambda x: invalid_text(x, most, True))


def summary_violations(summaries: DataFrame, key: str, lists: tuple[str, ...], required: tuple[str, ...] = ("work_completed",)) -> DataFrame:
    """(key, field, code) of all violations: invalid-text, too-many-items, missing-items."""
    found = [F.when(invalid_text(F.col(f), *SUMMARY_LIMITS[f]), F.struct(F.lit(f).alias("field"), F.lit("invalid-text").alias("code"))) for f in SUMMARY_LIMITS]
    for f in lists:
        most = TAG_LIMIT if f == "tags" else ITEM_LIMIT
        bad = any_invalid(f, most)
        found.append(F.when(F.size(f) > LIST_LIMIT, F.struct(F.lit(f).alias("field"), F.lit("too-many-items").alias("code"))).when(bad, F.struct(F.lit(f).alias("field"), F.lit("invalid-text").alias("code"))))
        if f in required:
            found.append(F.when(F.size(f) == 0, F.struct(F.lit(f).alias("field"), F.lit("missing-items").alias("code"))))
    return summaries.select(key, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def is_placeholder(tags: Column, tag: str) -> Column:
    """Whether a summary carries the tag that its writer gives to placeholders; no tags, or null ones, are none."""
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))
