"""Chat formatting: logged conversations without the snapshots of longer ones.

A logger writes a conversation again and again as it grows. Every turn gets the
rolling hash of the turns up to it; a conversation whose whole hash is the hash
of a shorter part of another is a snapshot and goes (anti-join). Of equal
conversations the smallest id stays. Those left are rendered.

Only ids and hashes are shuffled and sorted to roll; a long conversation
streams through its task and is never held. Rendering builds one string a
conversation, the output row itself.

Turns go by turn, role, text; null turns first. Rows without conv_id are
dropped, rows that repeat a turn wholly count once, a null role is `unknown`, a
null text empty. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import checkpointed

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _rolling(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted turns: (conv_id, k, hash of the turns up to the k-th)."""
    conv, last, state, k = None, None, b"", 0
    for f in frames:
        out = []
        for row in f.itertuples(index=False):
            if row.conv_id != conv:
                conv, last, state, k = row.conv_id, None, b"", 0
            turn = (row.has_turn, row.turn, row.digest)
            if turn == last:
                continue
            last, k = turn, k + 1
            state = hashlib.blake2b(state + row.digest, digest_size=16).digest()
            out.append((conv, k, state))
        yield pd.DataFrame(out, columns=["conv_id", "k", "hash"])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other one continues."""
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), text.alias("text"))
    # the order of equal turns is the texts', so texts themselves are needed only where a turn has several; their hash order would do as well
    slim = slim.select("conv_id", "has_turn", "turn", "role", F.unhex(F.sha2(F.concat_ws("\0", "role", "text"), 256)).alias("digest"))
    sorted_ = slim.repartition("conv_id").sortWithinPartitions("conv_id", "has_turn", "turn", "role", "digest").drop("role")
    prefixes = checkpointed(sorted_.mapInPandas(_rolling, "conv_id long, k long, hash binary"))
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("k", "hash")).alias("x")).select("conv_id", F.col("x.k").alias("n_turns"), F.col("x.hash").alias("hash"))
    kinds = whole.groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count("*").alias("n_copies"))
    parts = prefixes.join(kinds.select("conv_id", "n_turns"), "conv_id").where("k < n_turns").select("hash").distinct()
    return kinds.join(parts, "hash", "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    keep = maximal_conversations(turns)
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(F.concat_ws("\0", role, text), 256)).alias("digest"), text.alias("text"))
    each = rows.join(keep, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_set(F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn", "role", "digest", "text"))).alias("turns"))
    lines = F.transform("turns", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(f"{CLOSE}\n")))
    return each.select("conv_id", "n_turns", "n_copies", F.array_join(lines, "").alias("rendered"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || chr(0) || text)) AS k FROM t),
s AS (SELECT conv_id, k, role, text, string_agg(sha256(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM r),
w AS (SELECT conv_id, max(k) AS n, arg_max(prefix, k) AS whole FROM s GROUP BY conv_id),
u AS (SELECT whole, min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS n_copies FROM w GROUP BY whole),
kept AS (SELECT * FROM u WHERE whole NOT IN (SELECT prefix FROM s JOIN w USING (conv_id) WHERE k < n))
SELECT kept.conv_id AS conv_id, n_turns, n_copies, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM kept JOIN s ON s.conv_id = kept.conv_id GROUP BY kept.conv_id, n_turns, n_copies
"""
