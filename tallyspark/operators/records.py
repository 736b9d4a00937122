"""Records: classes of parsed lines, and the folds over sessions and corpora."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Record types with content, and known ones without, of each harness.
CONTENT = {
    "copilot": ("user.message", "assistant.message", "tool.execution_start", "tool.execution_complete", "tool.user_requested", "skill.invoked", "external_tool.requested", "external_tool.completed"),
    "claude-code": ("user", "assistant"),
    "codex": ("message", "function_call", "custom_tool_call", "function_call_output", "custom_tool_call_output", "local_shell_call"),
}
BOOKKEEPING = {
    "copilot": (
        "abort", "assistant.turn_end", "assistant.turn_start", "hook.end", "hook.start", "permission.completed", "permission.requested", "session.binary_asset",
        "session.compaction_complete", "session.compaction_start", "session.context_changed", "session.error", "session.info", "session.mode_changed",
        "session.model_change", "session.permissions_changed", "session.plan_changed", "session.resume", "session.shutdown", "session.start",
        "session.task_complete", "session.truncation", "session.usage_checkpoint", "session.warning", "session.workspace_file_changed",
        "subagent.completed", "subagent.started", "system.message", "system.notification",
    ),
    "claude-code": ("agent-name", "ai-title", "attachment", "file-history-delta", "file-history-snapshot", "frame-link", "last-prompt", "mode", "permission-mode", "pr-link", "queue-operation", "summary", "system"),
    "codex": ("compacted", "event_msg", "session_meta", "turn_context"),
}
#: Codex items that are known and left out.
IGNORED_ITEMS = ("reasoning", "web_search_call")
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def utc(text: Column) -> Column:
    """An RFC 3339 time; null for anything else, a bare date too."""
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(F.upper(text)))


def _class(source: str) -> Column:
    """The class of a parsed object of this harness."""
    shaped = F.when(~F.col("shaped"), "ignored").when(F.size("events") == 0, "empty").otherwise("content")
    if source != "codex":
        return F.when(F.col("type").isin(*CONTENT[source]), shaped).when(F.col("type").isin(*BOOKKEEPING[source]), "ignored").otherwise("unknown")
    items = F.when(F.col("item").isNull() | F.col("item").isin(*IGNORED_ITEMS), "ignored").when(F.col("item").isin(*CONTENT[source]), shaped).otherwise("unknown")
    return F.when(F.col("type").isin(*BOOKKEEPING[source]), "ignored").when(F.col("type") == "response_item", items).otherwise("unknown")


def classified(facts: DataFrame) -> DataFrame:
    """Parsed lines with class (content, empty, ignored, unknown, error), ignored_kind, unknown_kind and ts."""
    by_source = F.lit("unknown")
    for source in CONTENT:
        by_source = F.when(F.col("source") == source, _class(source)).otherwise(by_source)
    kind = F.when(F.col("status") == "error", "error").when(F.col("status") == "other", "ignored").when(F.col("type").isNull(), "unknown").otherwise(by_source)
    name = F.coalesce("item", "type")
    ignored = F.when(F.col("status") == "other", "non-object-json").when((F.col("source") == "codex") & (F.col("type") == "response_item"), name).otherwise(F.col("type"))
    unknown = F.when(F.col("type").isNull(), "<untyped>").when((F.col("source") == "codex") & F.col("item").isNotNull(), F.concat_ws("/", "type", "item")).otherwise(F.col("type"))
    rows = facts.withColumn("class", kind).withColumn("ts", utc(F.col("raw_timestamp")))
    return rows.withColumn("ignored_kind", F.when(F.col("class") == "ignored", ignored)).withColumn("unknown_kind", F.when(F.col("class") == "unknown", unknown)).withColumn("events", F.when(F.col("class") == "content", F.col("events")).otherwise(F.array().cast(dict(facts.dtypes)["events"])))


def rendered(fields: Column, derived: Column) -> Column:
    """A tool event as text: key=value in the order of the keys, without derived ones."""
    shown = F.map_filter(fields, lambda k, _: ~F.array_contains(F.coalesce(derived, F.array().cast("array<string>")), k))
    return F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ")


def events(records: DataFrame) -> DataFrame:
    """One row for each event: (source, session_id, record, seq, kind, content, call_id, command)."""
    rows = records.select("source", "session_id", "record", F.posexplode("events").alias("seq", "e"))
    f = F.col("e.fields")
    content = F.when(F.col("e.kind") == "tool", rendered(f, F.col("e.derived"))).otherwise(F.col("e.text"))
    return rows.select("source", "session_id", "record", "seq", F.col("e.kind").alias("kind"), content.alias("content"), F.coalesce(f["tool_use_id"], f["tool_call_id"], f["call_id"]).alias("call_id"), f["command"].alias("command"))


def _events_of(kind: str) -> Column:
    return F.sum(F.size(F.filter("events", lambda e: e["kind"] == kind))).cast("long")


def session_summary(records: DataFrame) -> DataFrame:
    """Counts of each session: of events for content, of records for the rest; times of all records count."""
    return records.groupBy("source", "session_id").agg(
        _events_of("user").alias("user_requests"), _events_of("assistant").alias("assistant_messages"), _events_of("tool").alias("tool_activities"),
        F.count_if(F.col("class").isin("ignored", "unknown")).alias("ignored_events"), F.count_if(F.col("class") == "error").alias("malformed_records"),
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"),
    )


def worth_keeping() -> Column:
    return (F.col("user_requests") > 0) & ((F.col("assistant_messages") > 0) | (F.col("tool_activities") > 0))


def continued(previous: DataFrame, delta: DataFrame) -> DataFrame:
    """Summaries of sessions with the summaries of their new records added: the first start and the newest end are kept, not the extremes."""
    counts = ("user_requests", "assistant_messages", "tool_activities", "ignored_events", "malformed_records")
    both = previous.alias("p").join(delta.alias("d"), ["source", "session_id"], "full")
    sums = [(F.coalesce(f"p.{c}", F.lit(0)) + F.coalesce(f"d.{c}", F.lit(0))).alias(c) for c in counts]
    return both.select("source", "session_id", *sums, F.coalesce("p.started_at", "d.started_at").alias("started_at"), F.coalesce("d.updated_at", "p.updated_at").alias("updated_at"))


def token_usage(records: DataFrame) -> DataFrame:
    """Tokens of each session, a message that is logged in several records counted once; a counter no record has is null, not 0."""
    usage = records.where("assistant_meta.usage is not null").select("source", "session_id", "record", "assistant_meta.message_id", "assistant_meta.usage")
    once = usage.where("message_id is not null").groupBy("source", "session_id", "message_id").agg(F.max_by("usage", "record").alias("usage")).drop("message_id")
    rows = once.unionByName(usage.where("message_id is null").select("source", "session_id", "usage"))
    names = [x.name for x in records.schema["assistant_meta"].dataType["usage"].dataType.fields if x.dataType.typeName() == "long"]
    return rows.groupBy("source", "session_id").agg(*(F.sum(f"usage.{x}").alias(x) for x in names))


def compactions(records: DataFrame) -> DataFrame:
    """Markers of each session, completed ones, and those that did not fail."""
    done = F.col("compaction.phase") == "complete"
    return records.where("compaction is not null").groupBy("source", "session_id").agg(
        F.count("*").alias("markers"), F.count_if(done).alias("completed"), F.count_if(done & ~F.col("compaction.succeeded").eqNullSafe(F.lit(False))).alias("effective")
    )


def _census(kind: str, keys: list[str], records: DataFrame) -> DataFrame:
    """A map of the kind's names and counts; there are as many names as record types, whatever the rows."""
    counts = records.where(F.col(kind).isNotNull()).groupBy(*keys, kind).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias(f"{kind}s"))


def parse_accounting(records: DataFrame, keys: list[str]) -> DataFrame:
    """What was read of each snapshot: records by class, events by kind, names of ignored and unknown kinds, and the share that was typed."""
    total = records.groupBy(*keys).agg(
        F.count("*").alias("records_seen"), _events_of("user").alias("user_events"), _events_of("assistant").alias("assistant_events"), _events_of("tool").alias("tool_events"),
        *(F.count_if(F.col("class") == x).alias(f"{x}_records") for x in ("empty", "ignored", "unknown", "error")),
    )
    share = F.try_divide(F.col("records_seen") - F.col("unknown_records") - F.col("error_records"), F.col("records_seen"))
    return total.withColumn("typed_share", share).join(_census("ignored_kind", keys, records), keys, "left").join(_census("unknown_kind", keys, records), keys, "left")


def corpus_rollup(rows: DataFrame, agent: str, version: str, measures: list[Column]) -> DataFrame:
    """Measures by (agent, version) and in total; is_total tells the total from a group of null names."""
    return rows.groupingSets([[F.col(agent), F.col(version)], []], agent, version).agg((F.grouping_id() == 3).alias("is_total"), *measures)


def event_chunks(rows: DataFrame, session: str, order: str, size: str, cap: int | str) -> DataFrame:
    """(session, order, chunk): events in order, a new chunk where the next would not fit; one larger than cap stands alone.

    cap: bytes, or the column that has them for the row's session. Greedy, so one
    pass over each session; only sizes go through it, and a session's rows stream
    through their task.
    """
    kind = dict(rows.dtypes)

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, chunk, used = None, 0, 0
        for f in frames:
            numbers = []
            for key, size, most in zip(f["key_"], f["size_"], f["cap_"], strict=True):
                if key != own:
                    own, chunk, used = key, 0, size
                elif used + size > most:
                    chunk, used = chunk + 1, size
                else:
                    used += size
                numbers.append(chunk)
            yield pd.DataFrame({session: f[session], order: f[order], "chunk": numbers})

    # a null session is a session too
    most = F.lit(cap) if isinstance(cap, int) else F.col(cap)
    slim = rows.select(session, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size_"), most.cast("long").alias("cap_"), F.to_json(F.struct(session)).alias("key_"))
    sorted_ = slim.repartition(session).sortWithinPartitions(session, order, "size_")
    return sorted_.mapInPandas(chunks, f"{session} {kind[session]}, {order} {kind[order]}, chunk long")
