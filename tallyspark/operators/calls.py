"""Tool calls and their results, paired by id in order; as a stream by an outer join within a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired(events: DataFrame) -> DataFrame:
    """(session_id, call_id, call_seq, result_seq, status, repeated) of events (session_id, seq, call_id, phase: call or result).

    Of one id in a session, in order of seq, a result answers the earliest call
    that still waits; one that finds none stands alone. status: answered,
    unanswered or no-call; repeated: the id has several calls or results. Events
    without id can't be paired and stand alone, not repeated. Equal seq: calls
    first, as a result can't come before its call. Other phases are left out; no
    events give no rows.

    A result finds no call when the results so far outnumber the calls by more
    than ever before, so running counts tell the pairs: no event is joined with
    another, and none of an id's events are gathered.
    """
    rows = events.where(F.col("phase").isin("call", "result")).select("session_id", "seq", "call_id", (F.col("phase") == "result").cast("long").alias("is_result"))
    named, bare = rows.where("call_id is not null"), rows.where("call_id is null")
    until = Window.partitionBy("session_id", "call_id").orderBy("seq", "is_result").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = named.withColumns({"calls": F.sum(1 - F.col("is_result")).over(until), "results": F.sum("is_result").over(until)})
    counted = counted.withColumn("alone", F.greatest(F.max(F.col("results") - F.col("calls")).over(until), F.lit(0)))
    lonely = (F.col("is_result") == 1) & (F.col("alone") > F.coalesce(F.lag("alone").over(Window.partitionBy("session_id", "call_id").orderBy("seq", "is_result")), F.lit(0)))
    pair = F.when(F.col("is_result") == 0, F.col("calls")).when(lonely, -F.col("alone")).otherwise(F.col("results") - F.col("alone"))
    whole = Window.partitionBy("session_id", "call_id")
    numbered = counted.withColumn("pair", pair).withColumn("repeated", (F.max("calls").over(whole) > 1) | (F.max("results").over(whole) > 1))
    of = lambda result: F.max(F.when(F.col("is_result") == result, F.col("seq")))
    pairs = numbered.groupBy("session_id", "call_id", "pair", "repeated").agg(of(0).alias("call_seq"), of(1).alias("result_seq")).drop("pair")
    single = bare.select("session_id", "call_id", F.when(F.col("is_result") == 0, F.col("seq")).alias("call_seq"), F.when(F.col("is_result") == 1, F.col("seq")).alias("result_seq"), F.lit(False).alias("repeated"))
    status = F.when(F.col("call_seq").isNull(), "no-call").when(F.col("result_seq").isNull(), "unanswered").otherwise("answered")
    return pairs.unionByName(single).withColumn("status", status).select("session_id", "call_id", "call_seq", "result_seq", "status", "repeated")


def pairing_totals(pairs: DataFrame) -> DataFrame:
    """Pairs by status, those of repeated ids, and the longest way from a call to its result."""
    return pairs.groupBy("status").agg(F.count("*").alias("n"), F.count_if("repeated").alias("n_repeated"), F.max(F.col("result_seq") - F.col("call_seq")).alias("longest"))


def paired_stream(events: DataFrame, wait: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """A stream of (session_id, call_id, call_at, result_at, status) of a stream of events (session_id, call_id, phase, at: timestamp).

    A full outer join of calls and results at most `wait` apart: pairs come at
    once, what stays alone when the watermark is past the wait. State holds calls
    and results of that time only. An id that is repeated within the wait pairs
    all its calls with all later results; `paired` tells them apart by order.
    Events without session, id or time are left out.
    """
    rows = events.where("session_id is not null and call_id is not null and at is not null").withWatermark("at", delay)
    side = lambda phase: rows.where(F.col("phase") == phase).select(*(F.col(c).alias(f"{phase}_{c}") for c in ("session_id", "call_id", "at")))
    near = f"call_session_id = result_session_id AND call_call_id = result_call_id AND result_at >= call_at AND result_at <= call_at + INTERVAL {wait}"
    joined = side("call").join(side("result"), F.expr(near), "full_outer")
    status = F.when(F.col("call_at").isNull(), "no-call").when(F.col("result_at").isNull(), "unanswered").otherwise("answered")
    return joined.select(F.coalesce("call_session_id", "result_session_id").alias("session_id"), F.coalesce("call_call_id", "result_call_id").alias("call_id"), "call_at", "result_at", status.alias("status"))
