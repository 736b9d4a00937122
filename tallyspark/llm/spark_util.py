"""Cutting lineage in the shared folder, and connected components by label propagation."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read from there.

    The folder is the session's; only where none is set (tests, one machine) a
    temporary one is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, smaller than a checkpoint where there are many narrow rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set first where it isn't yet; only on one machine may that be a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a bitmap that one task puts together.
BLOCK_BITS = 1 << 16


def slot_bits(slots: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of so many bits (a power of two, BLOCK_BITS at least) as int64 words, with the bits in column `slot` set.

    Tasks build blocks of the bitmap; the driver only gets finished blocks, so
    what it holds depends on `bits` alone.
    """

    def block(f: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(BLOCK_BITS, np.uint8)
        flags[f["at"].to_numpy()] = 1
        return pd.DataFrame({"block": f["block"].iloc[:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    parts = slots.select(F.expr(f"slot div {BLOCK_BITS}").alias("block"), F.expr(f"slot % {BLOCK_BITS}").alias("at")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("block").applyInPandas(block, "block long, bits binary").collect():
        at = row["block"] * BLOCK_BITS // 8
        out[at : at + BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out.view(np.int64)


def dense(sums: DataFrame, size: int) -> np.ndarray:
    """Column `n` by column `at` (each once, below size) as float32 array; tasks build its blocks, the driver only gets those."""

    def block(f: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(BLOCK_BITS, np.float32)
        values[f["at"].to_numpy() % BLOCK_BITS] = f["n"].to_numpy()
        return pd.DataFrame({"block": f["block"].iloc[:1], "values": [values.tobytes()]})

    out = np.zeros(-(-size // BLOCK_BITS) * BLOCK_BITS, np.float32)
    for row in sums.withColumn("block", F.expr(f"at div {BLOCK_BITS}")).groupBy("block").applyInPandas(block, "block long, values binary").toLocalIterator():
        out[row["block"] * BLOCK_BITS :][:BLOCK_BITS] = np.frombuffer(row["values"], np.float32)
    return out[:size]


def has_bit(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 6].view(np.uint64) >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


#: Bits of the sketch of wanted ids; a clash only costs a row more in a shuffle.
WANTED_BITS = 1 << 24


def id_slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(WANTED_BITS)).cast("long")


def wanted_ids(ids: DataFrame) -> np.ndarray:
    """A sketch of fixed size of the column `id`."""
    return slot_bits(ids.select(id_slot("id").alias("slot")), WANTED_BITS)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge list (a, b): component is the smallest node reachable.

    Every node of an edge is present. Each round a node takes the smallest
    label among itself and its neighbours, then the label's own label (pointer
    jumping), so rounds grow with the logarithm of a chain's length. Edges are
    kept as they are; labels are cut off from their lineage each round by a
    checkpoint. Null ends are ignored; no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = checkpointed(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        over = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = checkpointed(step.join(over, "label").select("node", "old", F.least("label", "up").alias("label")))
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
