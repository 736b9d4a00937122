"""N-gram Jaccard join by multiple-global-order prefix filtering.

Two texts link when den * |A & B| >= num * |A | B| for their sets of distinct
n-word shingles. The plan:

1. Documents with equal sets collapse to one class (set fingerprint).
2. Star links: each class is checked against the smallest class that shares a
   minimum hash with it. Verified links give provisional components; they only
   save work later and need not be complete.
3. First order, rarest shingle first: sets that link share a shingle among
   their first n - ceil(t*n) + 1 ones. Classes meet by shingle; pairs of
   different provisional components that pass the size and parity-bitmap
   bounds are candidates. Pairs inside a component are never made.
4. The candidates must also share a prefix shingle under two more orders (by
   two independent hashes). Only prefixes are shipped for that; the whole sets
   go only to the pairs left, which are verified on them.
5. Components over star links and verified links.

Both bounds are exact (they never drop a link): the bitmap holds the parity of
how many shingles fall on each bit, so the bits that differ are at most as many
as the shingles that differ. Which shingles are common is held in a sketch of
fixed size; it only moves shingles in the first order, the same for all texts,
so results don't depend on it.

Nulls, empty texts: no shingles, linked with nothing, component is the own id.
Texts of fewer than n words have their whole word sequence as the one shingle.
Rows with a null id are returned, and link nothing. Repeated rows come back each;
of several texts of one id any one is taken. No documents give no rows; a very long
text is one row like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .spark_util import checkpointed, components, has_bit, id_slot, wanted_ids

#: Bits of a class's parity bitmap.
BITMAP = 512
#: Slots of the sketch of common shingles, one byte each; the bound of what is broadcast for the first order.
COMMON_SLOTS = 1 << 20
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-num * n // den) + 1


def _parity(text: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each text's parity bitmap: BITMAP bits, doubled while the set has more than two elements a bit."""
    bits = BITMAP << np.ceil(np.log2(np.maximum(n / (2 * BITMAP), 1))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    at = base[text] + ((h >> np.uint64(40)).astype(np.int64) & (bits[text] - 1))
    flat = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
    return [flat[s:e] for s, e in zip(base[:-1] // 8, base[1:] // 8, strict=True)]


def _folded(bitmap: bytes, size: int = BITMAP // 64) -> np.ndarray:
    """A bitmap folded to so many 64-bit words; parity survives folding."""
    x = np.frombuffer(bitmap, np.uint64)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _most(both: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many shingles two linked sets of so many shingles together can differ by."""
    return both - 2 * -(-num * both // (num + den))


def _features(ngram: int):
    """Of each text: set size, fingerprint, parity bitmap, minimum hashes. A row without id at a batch's end has its repeated shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            often: list[tuple[np.ndarray, np.ndarray]] = []
            for c in X.chunks(batch.column("text")):
                text, h = X.shingles(X.words(c), c.n, ngram)
                if len(h):
                    again, k = np.unique(h, return_counts=True)
                    often.append((again[k > 1], k[k > 1]))
                n = np.bincount(text, minlength=c.n)
                at = np.concatenate([[0], np.cumsum(n)])[:-1]
                full = n > 0
                out = {}
                for name, values, fold in (("fp1", X.mix(h), np.add), ("fp2", X.mix(h ^ _SEEDS[2]), np.add), ("m0", X.mix(h ^ _SEEDS[0]), np.minimum), ("m1", X.mix(h ^ _SEEDS[1]), np.minimum)):
                    x = np.zeros(c.n, np.uint64)
                    if full.any():
                        x[full] = fold.reduceat(values, at[full])
                    out[name] = pa.array(X.signed(x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(c.first, c.n), pa.array(np.ones(c.n, bool)), pa.array(n.astype(np.int64)), out["fp1"], out["fp2"], pa.array(_parity(text, h, n), pa.binary()), out["m0"], out["m1"], pa.nulls(c.n, pa.list_(pa.int64())), pa.nulls(c.n, pa.list_(pa.int64()))],
                    ["id", "is_text", "n", "fp1", "fp2", "bitmap", "m0", "m1", "common", "counts"],
                )
            h, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in often)]), return_inverse=True)
            k = np.bincount(which, np.concatenate([np.zeros(0), *(x[1] for x in often)]), len(h))
            h, k = h[k > 3], k[k > 3]
            null = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [null, pa.array([False]), null, null, null, pa.nulls(1, pa.binary()), null, null, X.list_column(X.signed(h), np.array([0, len(h)])), X.list_column(k.astype(np.int64), np.array([0, len(k)]))],
                ["id", "is_text", "n", "fp1", "fp2", "bitmap", "m0", "m1", "common", "counts"],
            )

    return run


_FEATURES = "id long, is_text boolean, n long, fp1 long, fp2 long, bitmap binary, m0 long, m1 long, common array<long>, counts array<long>"


def _prefixes(ngram: int, num: int, den: int, common: np.ndarray):
    """(id, prefix under the first order) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in X.chunks(batch.column("text")):
                text, h = X.shingles(X.words(c), c.n, ngram)
                order = np.lexsort((h, common[(h % np.uint64(COMMON_SLOTS)).astype(np.int64)], text))
                n = np.bincount(text, minlength=c.n)
                keep = np.where(n > 0, prefix_length(n, num, den), 0)
                at = np.concatenate([[0], np.cumsum(n)])
                rank = np.arange(len(h)) - at[text]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(c.first, c.n), X.list_column(X.signed(h[order][rank < keep[text]]), np.concatenate([[0], np.cumsum(keep)]))], ["id", "prefix"])

    return run


def _sets(ngram: int, wanted: np.ndarray):
    """(id, set) of the texts whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(has_bit(wanted, slot))
            ids, texts = batch.column("id").take(pa.array(keep)), batch.column("text").take(pa.array(keep))
            for c in X.chunks(texts):
                text, h = X.shingles(X.words(c), c.n, ngram)
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.n), X.list_column(X.signed(h), np.concatenate([[0], np.cumsum(np.bincount(text, minlength=c.n))]))], ["id", "set"])

    return run


def _orders(ngram: int, num: int, den: int, wanted: np.ndarray):
    """(id, prefixes under the second and third order) of the texts whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(np.flatnonzero(has_bit(wanted, batch.column("slot").to_numpy(zero_copy_only=False))))
            ids, texts = batch.column("id").take(keep), batch.column("text").take(keep)
            for c in X.chunks(texts):
                text, h = X.shingles(X.words(c), c.n, ngram)
                n = np.bincount(text, minlength=c.n)
                size = np.where(n > 0, prefix_length(n, num, den), 0)
                rank = np.arange(len(h)) - np.concatenate([[0], np.cumsum(n)])[text]
                out = []
                for seed in _SEEDS[:2]:
                    key = X.mix(h ^ seed)
                    out.append(X.list_column(X.signed(h[np.lexsort((key, text))][rank < size[text]]), np.concatenate([[0], np.cumsum(size)])))
                yield pa.RecordBatch.from_arrays([ids.slice(c.first, c.n), *out], ["id", "second", "third"])

    return run


def _verify(num: int, den: int):
    """Candidate pairs with their whole sets: those that link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            good = np.zeros(len(f), bool)
            for i, (a, b) in enumerate(zip(f["set_a"], f["set_b"], strict=True)):
                both = len(np.intersect1d(a, b, True))
                good[i] = den * both >= num * (len(a) + len(b) - both)
            yield f.loc[good, ["a", "b"]]
            X.release_memory()

    return run


def _pairs(num: int, den: int):
    """Rows sorted by token and size: pairs of different components within a token that pass the bounds.

    The bounds are on sizes, on the token's places in both orders (what comes
    before it isn't shared through it), and on the bitmaps. Steps run over all
    groups at once: the i-th row against the one `step` further.
    """

    def groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            last = f["token"].iloc[-1]
            if rest and f["token"].iloc[0] == last and rest[0]["token"].iloc[0] == last:
                rest.append(f)
                continue
            f = pd.concat([*rest, f])
            cut = int(np.searchsorted((f["token"] == last).to_numpy(), True))
            if cut:
                yield f.iloc[:cut]
            rest = [f.iloc[cut:]]
        if rest:
            yield pd.concat(rest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in groups(frames):
            token, doc, comp, n, pos = (f[k].to_numpy() for k in ("token", "id", "comp", "n", "pos"))
            maps = np.stack([_folded(x) for x in f["bitmap"]])
            i, step = np.arange(len(f)), 0
            while len(i):
                step += 1
                i = i[i + step < len(f)]
                # rows go by token and size, so what is over the size bound stays over it
                i = i[(token[i] == token[i + step]) & (den * n[i] >= num * n[i + step])]
                j = i + step
                both = n[i] + n[j]
                shared = -(-num * both // (num + den))
                k = np.flatnonzero((comp[i] != comp[j]) & (pos[i] <= n[i] - shared) & (pos[j] <= n[j] - shared))
                k = k[np.bitwise_count(maps[i[k]] ^ maps[j[k]]).sum(axis=1) <= _most(both[k], num, den)]
                if len(k):
                    x = np.stack([doc[i[k]], doc[j[k]]])
                    yield pd.DataFrame({"a": x.min(axis=0), "b": x.max(axis=0)})

    return run


def verified(docs: DataFrame, pairs: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link; pairs must be a materialised table."""

    def of_texts(pairs: DataFrame, give, columns: str) -> DataFrame:
        """give(sketch of wanted ids) over the texts of the pairs, one row an id."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = docs.sparkSession.sparkContext.broadcast(wanted_ids(ids))
        rows = docs.where("id is not null").select("id", "text", id_slot("id").alias("slot"))
        return rows.mapInArrow(lambda it: give(wanted.value)(it), f"id long, {columns}").join(ids, "id", "left_semi").dropDuplicates(["id"])

    def both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(table.select(F.col("id").alias(end), *(F.col(x).alias(f"{x}_{end}") for x in columns)), end)
        return pairs

    prefixes = of_texts(pairs, lambda wanted: _orders(ngram, num, den, wanted), "second array<long>, third array<long>")
    near = both(pairs.select("a", "b"), prefixes, "second", "third").where("arrays_overlap(second_a, second_b) and arrays_overlap(third_a, third_b)")
    near = checkpointed(near.select("a", "b"))
    sets = of_texts(near, lambda wanted: _sets(ngram, wanted), "set array<long>")
    return both(near, sets, "set").select("a", "b", "set_a", "set_b").mapInPandas(_verify(num, den), "a long, b long")


def _bounded(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, sizes n_*, bitmaps map_*) within the size bound and the bitmap bound."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            most = _most((f["n_a"] + f["n_b"]).to_numpy(), num, den)
            words = [min(len(x), len(y)) // 8 for x, y in zip(f["map_a"], f["map_b"], strict=True)]
            differ = np.array([np.bitwise_count(_folded(x, w) ^ _folded(y, w)).sum() for x, y, w in zip(f["map_a"], f["map_b"], words, strict=True)], np.int64)
            yield f.loc[differ <= most, ["a", "b"]]

    near = pairs.where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")
    return near.select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInPandas(run, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of docs; see the module."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    features = checkpointed(docs.mapInArrow(_features(ngram), _FEATURES))
    texts = features.where("is_text")
    classes = checkpointed(texts.where("n > 0 and id is not null").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("id"), F.min("bitmap").alias("bitmap"), F.min("m0").alias("m0"), F.min("m1").alias("m1")))

    keyed = classes.select("id", "n", "bitmap", F.posexplode(F.array("m0", "m1")).alias("seed", "m"))
    leader = keyed.groupBy("seed", "m").agg(F.min(F.struct("id", "n", "bitmap")).alias("first"), F.count("*").alias("k")).where("k > 1")
    star = keyed.join(leader, ["seed", "m"]).where("id <> first.id").select(F.col("first.id").alias("a"), F.col("id").alias("b"), F.col("first.n").alias("n_a"), F.col("n").alias("n_b"), F.col("first.bitmap").alias("map_a"), F.col("bitmap").alias("map_b"))
    stars = checkpointed(_bounded(star, num, den).distinct())
    linked = checkpointed(verified(docs, stars, ngram, num, den))
    near = components(linked)
    classes = checkpointed(classes.join(near.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "bitmap", "fp1", "fp2", F.coalesce("component", "id").alias("comp")))

    slots = features.where("not is_text").select(F.explode(F.arrays_zip("common", "counts")).alias("x")).groupBy("x.common").agg(F.sum("x.counts").alias("k")).where("k >= 32")
    slots = slots.groupBy(F.pmod(F.col("common"), F.lit(COMMON_SLOTS)).alias("slot")).agg(F.max("k").alias("k")).toPandas()
    common = np.zeros(COMMON_SLOTS, np.uint8)
    # 2**64 is a multiple of the number of slots, so the signed remainder is the unsigned one
    np.maximum.at(common, slots["slot"].to_numpy(np.int64), np.log2(np.maximum(slots["k"].to_numpy(float), 1)).astype(np.uint8))
    sketch = spark.sparkContext.broadcast(common)
    first_order = lambda it: _prefixes(ngram, num, den, sketch.value)(it)
    prefixes = docs.where("id is not null").mapInArrow(first_order, "id long, prefix array<long>")
    rows = prefixes.join(classes.select("id", "comp", "n"), "id").dropDuplicates(["id"]).select(F.posexplode("prefix").alias("pos", "token"), "id", "comp", "n")
    of_token = Window.partitionBy("token")
    met = checkpointed(rows.withColumn("low", F.min("comp").over(of_token)).withColumn("high", F.max("comp").over(of_token)).where("low <> high").select("token", "id", "comp", "n", "pos"))
    met = met.join(classes.select("id", "bitmap"), "id").repartition("token").sortWithinPartitions("token", "n", "id")
    pairs = met.mapInPandas(_pairs(num, den), "a long, b long").distinct()
    sizes = classes.select("id", "n", "bitmap")
    for end in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("bitmap").alias(f"map_{end}")), end)
    pairs = checkpointed(_bounded(pairs, num, den))
    links = linked.unionByName(verified(docs, pairs, ngram, num, den))
    final = components(links)
    classes = classes.join(final.withColumnRenamed("node", "id"), "id", "left").select("fp1", "fp2", "n", F.coalesce("component", "id").alias("component_id"))
    out = texts.select("id", "n", "fp1", "fp2").join(classes, ["fp1", "fp2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
