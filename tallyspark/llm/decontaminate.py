"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of a test item is a seed. Training texts are scanned once for
seeds (a bitmap of fixed size goes to the tasks, the exact join follows). Each
seed of a text starts an alignment, however many texts it is in, so what is
found in a text doesn't depend on the others; seeds near one diagonal start one
together. Only a passage that holds too few of the item's words for any
alignment to reach `min_score` is not aligned.

Around each seed the passage is aligned with the item, word by word, with
scores `MATCH`, `MISMATCH` and `GAP`; the score over the best possible one must
reach `min_score`. Edited and paraphrased copies keep most of it.

Null or empty texts match nothing; an item with fewer words than n is one seed
as a whole. Null ids are ignored on both sides. Repeated rows give one result;
of several texts of one id any one is taken. Of equal scores the one with the larger
end_word is given. No documents or no items give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .spark_util import checkpointed, has_bit, id_slot, slot_bits, wanted_ids

SEED_BITS = 1 << 24
MATCH, MISMATCH, GAP = 2, -1, -1
#: Pairs aligned at once, and cells of a step's matrix.
LANES, CELLS = 512, 1 << 20


def _items(ngram: int):
    """(id, words, [(place, seed)]) of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in X.chunks(batch.column("text")):
                w = X.words(c)
                first, h = X.ngrams(w, ngram)
                short = np.flatnonzero((np.diff(w.word_offsets) > 0) & (np.diff(w.word_offsets) < ngram))
                rows = [(int(w.text[i]), int(i - w.word_offsets[w.text[i]]), x) for i, x in zip(first, X.signed(h).tolist(), strict=True)]
                for t in short:
                    rows.append((int(t), 0, int(X.signed(_whole(w.hash[w.word_offsets[t] : w.word_offsets[t + 1]])))))
                seeds: list[list[tuple[int, int]]] = [[] for _ in range(c.n)]
                for t, place, x in rows:
                    seeds[t].append((place, x))
                kind = pa.list_(pa.struct([("place", pa.int64()), ("seed", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(c.first, c.n), X.list_column(X.signed(w.hash), w.word_offsets), pa.array([[{"place": p, "seed": x} for p, x in s] for s in seeds], kind)], ["id", "words", "seeds"])

    return run


def _whole(h: np.ndarray) -> np.ndarray:
    """The hash ngrams() gives to a run of exactly these words."""
    x = np.zeros(1, np.uint64)
    for i in range(len(h)):
        x = X.mix(x + h[i : i + 1] * X._K[i % len(X._K)])
    return x


def _hits(sizes: tuple[int, ...], bitmap: np.ndarray):
    """(id, place, seed) of the texts' n-grams that may be seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in X.chunks(batch.column("text")):
                w = X.words(c)
                for size in sizes:
                    first, h = X.ngrams(w, size)
                    ok = has_bit(bitmap, (h % np.uint64(SEED_BITS)).astype(np.int64))
                    first, h = first[ok], h[ok]
                    text = w.text[first]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(c.first, c.n).take(pa.array(text)), pa.array(first - w.word_offsets[text]), pa.array(X.signed(h))], ["id", "place", "seed"])

    return run


def _texts(wanted: np.ndarray):
    """(id, words) of the texts whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(np.flatnonzero(has_bit(wanted, batch.column("slot").to_numpy(zero_copy_only=False))))
            ids, texts = batch.column("id").take(keep), batch.column("text").take(keep)
            for c in X.chunks(texts):
                w = X.words(c)
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.n), X.list_column(X.signed(w.hash), w.word_offsets)], ["id", "words"])

    return run


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local alignment score, passage place after its end) of each pair of word arrays, lane by lane."""
    m, w = max(map(len, items)), max(map(len, passages))
    a, b = np.full((len(items), m), 1, np.int64), np.full((len(items), w), 2, np.int64)
    rows, columns = np.zeros(len(items), np.int64), np.zeros((len(items), w), bool)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
        rows[i], columns[i, : len(y)] = len(x), True
    ramp = np.arange(w, dtype=np.int32) * -GAP
    above = np.zeros((len(items), w + 1), np.int32)
    best, at = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(m):
        step = np.where((b == a[:, i : i + 1]) & columns, MATCH, MISMATCH).astype(np.int32)
        row = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        # a gap along the row costs GAP a word: running maximum of what a cell is worth further on
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        row[i >= rows] = 0
        top = row.argmax(axis=1)
        high = row[np.arange(len(items)), top]
        better = high > best
        best, at = np.where(better, high, best), np.where(better, top + 1, at)
        above[:, 1:] = row
    return best, at


def _align(min_score: float):
    """Candidates with the words of item and passage: those whose alignment reaches min_score."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.reset_index(drop=True)
            items, passages, start = f["item_words"].tolist(), f["passage"].tolist(), f["start"].to_numpy()
            score, end = np.zeros(len(f)), np.zeros(len(f), np.int64)
            # a word of the item that the passage lacks can't match
            may = np.array([np.isin(x, y).sum() / len(x) >= min_score for x, y in zip(items, passages, strict=True)], bool)
            order = np.argsort([max(len(x), len(y)) for x, y in zip(items, passages, strict=True)], kind="stable")
            order = order[may[order]]
            i = 0
            while i < len(order):
                widest = len(passages[order[min(i + LANES, len(order)) - 1]])
                lanes = order[i : i + max(1, min(LANES, CELLS // max(widest, 1)))]
                best, at = smith_waterman([items[k] for k in lanes], [passages[k] for k in lanes])
                score[lanes] = best / [MATCH * len(items[k]) for k in lanes]
                end[lanes] = at + start[lanes]
                i += len(lanes)
            ok = score >= min_score
            yield pd.DataFrame({"id": f["id"][ok], "item": f["item"][ok], "score": score[ok], "end": end[ok]})

    return run


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", ngram: int = 3, min_score: float = 0.4
) -> DataFrame:
    """(id, item id, score, end_word) for each text and item with an alignment of min_score or more.

    score is the best one; end_word is the place in the text after that alignment's last word.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    test = items.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).alias("text")).where("id is not null")
    kind = "id long, words array<long>, seeds array<struct<place:long,seed:long>>"
    test = checkpointed(test.mapInArrow(_items(ngram), kind).where("size(words) > 0"))
    seeds = test.select(F.col("id").alias("item"), F.size("words").alias("m"), F.explode("seeds").alias("s")).select("item", "m", F.col("s.place").alias("at"), "s.seed")
    sizes = sorted({ngram, *(r["m"] for r in seeds.where(F.col("m") < ngram).select("m").distinct().collect())})
    bitmap = spark.sparkContext.broadcast(slot_bits(seeds.select(F.pmod("seed", F.lit(SEED_BITS)).alias("slot")), SEED_BITS))
    hits = docs.mapInArrow(lambda it: _hits(tuple(sizes), bitmap.value)(it), "id long, place long, seed long")
    found = checkpointed(hits.join(seeds, "seed").select("id", "item", "seed", "m", (F.col("place") - F.col("at")).alias("diagonal")))

    # a band of diagonals as wide as half an item; its neighbour overlaps it, so near seeds meet in one of the two
    width = F.greatest(F.col("m") / 2, F.lit(4.0))
    band = F.floor(F.col("diagonal") / width)
    bands = found.withColumn("band", F.explode(F.array(band, band + 1)))
    runs = checkpointed(bands.groupBy("id", "item", "band").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high")).select("id", "item", "low", "high").distinct())
    wanted = spark.sparkContext.broadcast(wanted_ids(runs.select("id").distinct()))
    texts = docs.select("id", "text", id_slot("id").alias("slot")).mapInArrow(lambda it: _texts(wanted.value)(it), "id long, words array<long>")
    texts = texts.dropDuplicates(["id"])
    both = runs.join(test.select(F.col("id").alias("item"), F.col("words").alias("item_words")).dropDuplicates(["item"]), "item").join(texts, "id")
    slack = F.floor(F.size("item_words") / 2) + 4
    both = both.withColumn("start", F.greatest(F.lit(0), F.col("low") - slack).cast("int")).withColumn("stop", (F.col("high") + F.size("item_words") + slack).cast("int"))
    both = both.withColumn("passage", F.slice("words", F.col("start") + 1, F.col("stop") - F.col("start")))
    good = both.select("id", "item", "start", "item_words", "passage").mapInPandas(_align(min_score), "id long, item long, score double, end long")
    best = good.groupBy("id", "item").agg(F.max(F.struct("score", F.col("end").alias("end_word"))).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), "x.score", "x.end_word")
