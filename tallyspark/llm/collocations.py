"""Phrase collocations by position bitmaps of words, extended depth first.

Texts fall into pieces and pieces into words. Each task cuts its words, by
language, into shards of a bounded number of positions; a free position parts
pieces, so nothing runs across one. Then:

1. Shards are written as a table: the words' numbers by position and the
   shard's dictionary. That cuts lineage and fixes the shards.
2. Every shard gives the hash buckets of its runs of 1 to 4 words with counts.
   Buckets are summed over shards; one whose sum is below the least count holds
   no frequent run. There are at least twice as many buckets as runs, so few
   others stay, and they only cost time. Each shard gets back the buckets of its
   own that stay: no table of words, buckets or phrases goes to all tasks.
3. A shard counts phrases. A word's occurrences are a compressed bitmap: only
   words of 64 bits that aren't zero, with their numbers. Each stands for WINDOW
   positions where phrases may start and, beyond them, copies of the next ones,
   so that a shift never leaves it. A phrase is shifted, ANDed with the bits
   that stay and with the bitmap of each word that follows, and counted by
   popcount; then the longer phrase goes on the same way. That is done for the
   phrases of some first words together, down to the longest, before the next.
4. Popcounts are summed over shards, by blocks of the phrases' hashes of 64 bits,
   which tell phrases apart. All parts of a frequent phrase are frequent, so
   every count that a score needs is there, exact.

Scores are exact decimals. Null and empty texts have no words; a null language is
`und`. Rows that repeat count again. Equal scores rank by count, then by the
phrase's bytes. A very long text spans as many windows and shards as it needs:
where one shard ends inside it, the first positions of the next are repeated as
context, so runs across the cut are counted once. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .spark_util import written

#: Words of a phrase at most.
LONGEST = 4
#: Bytes that end a piece, and those that part words.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
BETWEEN = PIECE_END.copy()
BETWEEN[[0x20, 0x09]] = True
#: Positions of a shard (runs that start there).
SHARD_WORDS = 1 << 20
#: Bitmaps' words that are extended at a time; words of the corpus for each block of phrases that is summed.
BATCH_BITMAPS, BLOCK_WORDS = 1 << 18, 1 << 21
#: Bits of a bitmap's word where phrases may start; the others are copies of the next ones.
WINDOW = 64 - (LONGEST - 1)
#: Buckets that one group sums.
BLOCK = 1 << 20
#: Parts of a language's phrases that are ranked first.
PARTS = 32


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after another."""
    total = np.cumsum(size)
    return data[np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)]


class Shards:
    """Gathers the words of a task's texts by language and gives a shard where there are enough."""

    def __init__(self, part: int):
        self.part, self.number = part, 0
        self.parts: dict[str, list[tuple]] = {}
        self.sizes: dict[str, int] = {}

    def add(self, lang: str, texts: pa.Array) -> Iterator[dict]:
        for c in X.chunks(texts):
            w = X.words(c, space=BETWEEN)
            if not len(w.hash):
                continue
            piece = np.cumsum(PIECE_END[c.data])[w.start]
            apart = np.ones(len(w.hash), bool)
            apart[1:] = (piece[1:] != piece[:-1]) | (w.text[1:] != w.text[:-1])
            known, first = np.unique(w.hash, return_index=True)
            size = w.end[first] - w.start[first]
            self.parts.setdefault(lang, []).append((w.hash, apart, known, X.LOWER[_gather(c.data, w.start[first], size)], size))
            self.sizes[lang] = self.sizes.get(lang, 0) + len(w.hash)
            while sum(self.sizes.values()) >= SHARD_WORDS:
                yield from self.shards(max(self.sizes, key=self.sizes.get))

    def rest(self) -> Iterator[dict]:
        for lang in list(self.sizes):
            yield from self.shards(lang)

    def shards(self, lang: str) -> Iterator[dict]:
        """All that is gathered of a language."""
        parts = self.parts.pop(lang)
        del self.sizes[lang]
        hashes, apart = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        known, first = np.unique(np.concatenate([p[2] for p in parts]), return_index=True)
        size = np.concatenate([p[4] for p in parts])
        begin = (np.cumsum(size) - size)[first]
        size, flat = size[first], np.concatenate([p[3] for p in parts])
        for a in range(0, len(hashes), SHARD_WORDS):
            b = min(a + SHARD_WORDS, len(hashes))
            end = min(b + LONGEST - 1, len(hashes))
            own, inverse = np.unique(hashes[a:end], return_inverse=True)
            # a free position before each piece but the first
            gap = apart[a:end].copy()
            gap[0] = False
            ids = np.full(end - a + int(gap.sum()), -1, np.int32)
            at = np.arange(end - a) + np.cumsum(gap)
            ids[at] = inverse
            k = np.searchsorted(known, own)
            joined = np.full(int(size[k].sum()) + len(k), 0x0A, np.uint8)
            ends = np.cumsum(size[k] + 1)
            hole = np.zeros(len(joined), bool)
            hole[ends - 1] = True
            joined[~hole] = _gather(flat, begin[k], size[k])
            yield {"shard": (self.part << 32) + self.number, "lang": lang, "n": b - a, "starts": int(at[b - a - 1]) + 1, "ids": pa.compress(ids.tobytes(), "zstd", asbytes=True), "positions": len(ids), "words": joined.tobytes()}
            self.number += 1


SHARD_SCHEMA = "shard long, lang string, n long, starts long, ids binary, positions long, words binary"
_SHARD_TYPES = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("starts", pa.int64()), ("ids", pa.binary()), ("positions", pa.int64()), ("words", pa.binary())])


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shards = Shards(TaskContext.get().partitionId())
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            for row in shards.add(lang, batch.column("text").filter(pc.equal(langs.indices, i))):
                yield pa.RecordBatch.from_pylist([row], _SHARD_TYPES)
    for row in shards.rest():
        yield pa.RecordBatch.from_pylist([row], _SHARD_TYPES)
    X.release_memory()


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids by position, words' bytes with a line feed after each, the words' hashes) of a shard's row."""
    ids = np.frombuffer(pa.decompress(row["ids"], 4 * row["positions"], "zstd", asbytes=True), np.int32)
    raw = np.frombuffer(row["words"], np.uint8)
    w = X.words(X.Chunk(0, 1, raw, np.array([0, len(raw)])), fold=False)
    return ids, raw, w.hash


def _seed(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode() + b"\n", np.uint8)
    return X.mix(np.array([np.sum(raw.astype(np.uint64) * X.powers(len(raw)), dtype=np.uint64)]))[0]


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs with one word more."""
    return X.mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _run_buckets(ids: np.ndarray, hashes: np.ndarray, lang: str, starts: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of words 1 to LONGEST: (positions where runs start, their buckets)."""
    at = np.flatnonzero(ids[:starts] >= 0)
    h = X.mix(hashes + _seed(lang))[ids[at]]
    yield at, h & np.uint64(buckets - 1)
    for k in range(1, LONGEST):
        on = at + k < len(ids)
        on[on] = ids[at[on] + k] >= 0
        at, h = at[on], h[on]
        h = _longer(h, hashes[ids[at + k]])
        yield at, h & np.uint64(buckets - 1)


def _counted_buckets(buckets: int, least: int):
    """Shards' counts by bucket as rows (block, shard, places, counts): places as gaps of 16 bits, counts to `least` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, hashes = _opened(row)
                every = np.concatenate([x for _, x in _run_buckets(ids, hashes, row["lang"], row["starts"], buckets)])
                every = np.sort(every.astype(np.uint32) if buckets <= 1 << 32 else every)
                edges = X.runs(every)
                place, count = every[edges[:-1]].astype(np.int64), np.minimum(np.diff(edges), least)
                cuts = X.runs(place // BLOCK)
                out = []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    out.append((int(place[a] // BLOCK), row["shard"], *packed_places(place[a:b] % BLOCK, count[a:b])))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["block", "shard", "places", "counts"])
        X.release_memory()

    return run


def packed_places(place: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending places as gaps below 2**16, with counts of 16 bits; a longer gap first takes steps of 2**16, entries that count nothing."""
    gap = np.diff(place, prepend=0)
    steps = gap >> 16
    at = np.arange(len(gap)) + np.cumsum(steps)
    gaps, counts = np.zeros((2, len(gap) + int(steps.sum())), np.int64)
    gaps[at], counts[at] = gap & 0xFFFF, count
    return gaps.astype("<u2").tobytes(), counts.astype("<u2").tobytes()


def unpacked_places(places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    gap, count = np.frombuffer(places, "<u2").astype(np.int64), np.frombuffer(counts, "<u2")
    gap[count == 0] = 1 << 16
    return np.cumsum(gap)[count > 0], count[count > 0]


def _staying(least: int):
    """A block's rows -> (shard, base, places) of the shard's buckets whose sum reaches the least count."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        total, rows = np.zeros(BLOCK, np.int64), []
        for places, counts in zip(f["places"], f["counts"], strict=True):
            place, count = unpacked_places(places, counts)
            total[place] += count
        stays = total >= least
        for shard, places, counts in zip(f["shard"], f["places"], f["counts"], strict=True):
            place = unpacked_places(places, counts)[0]
            if len(place := place[stays[place]]):
                rows.append((shard, int(f["block"].iloc[0]) * BLOCK, place.astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["shard", "base", "places"]).astype({"shard": "int64", "base": "int64"})

    return run


class Bitmaps:
    """Compressed bitmaps of the words of a shard, and the bits where runs of 1 to LONGEST words that may be frequent end."""

    def __init__(self, ids: np.ndarray, may_end: list[np.ndarray]):
        """may_end[k]: ascending positions where runs of k + 1 words end that may be frequent."""
        self.ids = ids
        self.n = -(-max(len(ids), 1) // WINDOW)
        self.ends = [self._dense(x, k) for k, x in enumerate(may_end)]
        at = np.flatnonzero(ids >= 0)
        # each position in its window, and in the one before it where that has a copy
        window, bit = at // WINDOW, at % WINDOW
        copy = (bit < 64 - WINDOW) & (window > 0)
        key = np.concatenate([ids[at], ids[at[copy]]]).astype(np.int64) * self.n + np.concatenate([window, window[copy] - 1])
        mask = np.left_shift(np.uint64(1), np.concatenate([bit, bit[copy] + WINDOW]).astype(np.uint64))
        order = np.argsort(key, kind="stable")
        edges = X.runs(key[order])
        self.mask = np.bitwise_or.reduceat(mask[order], edges[:-1]) if len(order) else mask
        self.word, self.window = np.divmod(key[order][edges[:-1]], self.n)
        # of each position its word's bitmap in the window, and in the one that has the copy
        of = np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(self.mask)), np.diff(edges))
        self.here, self.before = np.zeros((2, len(ids)), np.uint64)
        self.here[at], self.before[at[copy]] = self.mask[of[: len(at)]], self.mask[of[len(at) :]]

    def _dense(self, at: np.ndarray, k: int) -> np.ndarray:
        """Bits of runs' last words by the window that the runs start in."""
        start = at - k
        bit = (start % WINDOW + k).astype(np.uint64)
        out = np.zeros(self.n, np.uint64)
        if len(start):
            window = start // WINDOW
            edges = X.runs(window)[:-1]
            out[window[edges]] = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), bit), edges)
        return out

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words' numbers, a row each phrase; counts) of all phrases that may be frequent: some first words at a time, each time down to the longest."""
        mask = self.mask & self.ends[0][self.window]
        there = np.flatnonzero(mask)
        word, window, mask = self.word[there], self.window[there], mask[there]
        edges = X.runs(word)
        a = 0
        while a < len(edges) - 1:
            b = max(int(np.searchsorted(edges, edges[a] + BATCH_BITMAPS, side="right")) - 1, a + 1)
            some = slice(edges[a], edges[b])
            words = word[edges[a:b]][:, None]
            node = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
            yield words, np.add.reduceat(np.bitwise_count(mask[some]).astype(np.int64), edges[a:b] - edges[a])
            level = node, window[some], mask[some]
            for k in range(1, LONGEST):
                parent, last, counts, level = self._extended(*level, k)
                if not len(last):
                    break
                words = np.column_stack([words[parent], last])
                yield words, counts
            a = b

    def _extended(self, node: np.ndarray, window: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """(parents, last words, counts, bitmaps) of the phrases that go on from bitmaps of phrases of k words."""
        ahead = (mask << np.uint64(1)) & self.ends[k][window]
        parts: list[tuple] = []
        while True:
            there = np.flatnonzero(ahead)
            node, window, ahead = node[there], window[there], ahead[there]
            if not len(there):
                break
            # the word at each one's first bit: ANDed with its bitmap, which takes all its bits at once
            bit = np.bitwise_count((ahead & (~ahead + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            at = window * WINDOW + bit
            bitmap = np.where(bit < WINDOW, self.here[at], self.before[at])
            parts.append((node, self.ids[at], window, ahead & bitmap))
            ahead = ahead & ~bitmap
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, none, ()
        node, word, window, mask = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(node * (int(self.ids.max()) + 1) + word, kind="stable")
        node, word, window, mask = node[order], word[order], window[order], mask[order]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        counts = np.add.reduceat(np.bitwise_count(mask).astype(np.int64), first)
        return node[first], word[first], counts, (np.cumsum(new) - 1, window, mask)


COUNTED = "lang string, block long, hashes binary, counts binary, phrases binary"
_COUNTED_TYPES = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("phrases", pa.binary())])


def _counted_phrases(buckets: int, blocks: int):
    """A shard with its buckets that stay -> COUNTED: phrases by blocks of their hashes, with popcounts and texts (by line feeds)."""

    def run(shard: pa.Table, staying: pa.Table) -> pa.Table:
        out: list[dict] = []
        if shard.num_rows and staying.num_rows:
            row = shard.to_pylist()[0]
            ids, raw, hashes = _opened(row)
            stay = np.sort(np.concatenate([np.frombuffer(r["places"], "<u4").astype(np.uint64) + np.uint64(r["base"]) for r in staying.to_pylist()]))
            ends = []
            for k, (at, bucket) in enumerate(_run_buckets(ids, hashes, row["lang"], row["starts"], buckets)):
                place = np.searchsorted(stay, bucket)
                place[place == len(stay)] = 0
                ends.append(at[stay[place] == bucket] + k)
            begin = np.concatenate([[0], np.flatnonzero(raw == 0x0A) + 1])
            size = np.diff(begin)
            for words, counts in Bitmaps(ids, ends).phrases():
                h = X.mix(hashes[words[:, 0]] + _seed(row["lang"]))
                for k in range(1, words.shape[1]):
                    h = _longer(h, hashes[words[:, k]])
                order = np.argsort(h)
                words, counts, h = words[order], counts[order], h[order]
                edges = X.runs(h >> np.uint64(64 - blocks.bit_length() + 1)) if blocks > 1 else np.array([0, len(h)])
                spans = size[words].sum(axis=1)
                text = _gather(raw, begin[:-1][words].ravel(), size[words].ravel())
                inner = np.ones(words.shape, bool)
                inner[:, -1] = False
                text[(np.cumsum(size[words].ravel()) - 1)[inner.ravel()]] = 0x20
                till = np.concatenate([[0], np.cumsum(spans)])
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    out.append({"lang": row["lang"], "block": int(h[a]) * blocks >> 64, "hashes": h[a:b].astype("<u8").tobytes(), "counts": counts[a:b].astype("<u4").tobytes(), "phrases": text[till[a] : till[b]].tobytes()})
        X.release_memory()
        return pa.Table.from_pylist(out, _COUNTED_TYPES)

    return run


PHRASE_SCHEMA = "lang string, phrase string, k int, f long"


def _summed(least: int):
    """A block's rows of COUNTED -> (lang, phrase, k, f) of the phrases that are frequent in all shards together."""

    def run(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist()]
        known, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, inverse, np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("counts").to_pylist()]).astype(np.int64))
        # each frequent phrase's text from the first row that has it
        wanted, at, phrases, f = total >= least, 0, [], []
        for own, text in zip(hashes, rows.column("phrases"), strict=True):
            mine = inverse[at : at + len(own)]
            at += len(own)
            first = np.flatnonzero(wanted[mine])
            if len(first):
                texts = text.as_py().split(b"\n")
                phrases += [texts[i].decode("utf-8", "replace") for i in first.tolist()]
                f.append(total[mine[first]])
                wanted[mine[first]] = False
        lang = rows.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()), "k": pa.array([x.count(" ") + 1 for x in phrases], pa.int32()), "f": pa.array(np.concatenate(f) if f else [], pa.int64())})

    return run


def phrase_counts(docs: DataFrame, lang: Column, text: Column, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """((lang, n) of all words, (lang, phrase, k, f) of all phrases of 1 to LONGEST words that occur `least` times or more)."""
    shards = written(docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), text.alias("text")).where("text is not null").mapInArrow(_sharded, SHARD_SCHEMA))
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    runs = LONGEST * (shards.agg(F.sum("n")).first()[0] or 0)
    buckets = max(BLOCK, 1 << (2 * runs - 1).bit_length() if runs else 0)
    counted = shards.mapInArrow(_counted_buckets(buckets, least), "block long, shard long, places binary, counts binary")
    staying = counted.groupBy("block").applyInPandas(_staying(least), "shard long, base long, places binary")
    blocks = 1 << max(4, (runs // LONGEST // BLOCK_WORDS).bit_length())
    phrases = shards.groupBy("shard").cogroup(staying.groupBy("shard")).applyInArrow(_counted_phrases(buckets, blocks), COUNTED)
    return totals, written(phrases.groupBy("lang", "block").applyInArrow(_summed(least), PHRASE_SCHEMA))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, share: int = 80, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases of 2 to LONGEST words; see the module.

    A phrase occurs a times; cut after some of its words its parts occur l and r
    times and the score is floor(2000000 * a / (l + r)), of the cut that scores
    least. A phrase goes where a longer frequent one that contains it occurs
    share percent of a times or more.
    """
    totals, counts = phrase_counts(docs, F.col(lang_col), F.col(text_col), least)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    exact = F.expr("cast((cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    scored = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # what each longer phrase contains, with the most frequent of those
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda a: F.array_join(F.slice(words, a, n), " ")))))
    inside = counts.where("k > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * whole("longer") < F.lit(share) * whole("a")))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _oracle() -> str:
    """The same in DuckDB's SQL, for the defaults of collocations()."""
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest([array_to_string(ws[i:i+{k - 1}], ' ') FOR i IN range(1, len(ws) - {k} + 2)]) AS phrase FROM pieces WHERE len(ws) >= {k}" for k in range(1, LONGEST + 1))
    return rf"""
WITH parts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM parts),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
counts AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM ({grams}) GROUP BY lang, k, phrase HAVING count(*) >= 30),
words AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1),
cuts AS (SELECT lang, k, phrase, f, ws, unnest(range(1, k)) AS cut FROM words),
scored AS (SELECT c.lang, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i+n-1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM words)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


ORACLE = _oracle()
