"""Best-fit packing by length patterns fitted with non-negative least squares.

Documents become pieces of at most `capacity` tokens. Packing works on the
histogram of piece lengths, which has `capacity` bins whatever the corpus:

1. Patterns of one to three lengths that fill a sequence exactly are
   enumerated, and repeat counts fitted to the histogram by weighted
   non-negative least squares (short lengths weigh less: they fill gaps later).
2. Counts are rounded, never beyond what the histogram still has.
3. The residual histogram is packed best fit decreasing, in bulk.

Pieces are dealt to the plan by their rank among equal lengths, computed from
local ranks and per-partition counts, so no length gathers in one task.

A null text is empty; an empty text is the one end token. Null ids and repeated
rows are packed like any other. No documents: no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as X
from .spark_util import checkpointed

#: Pieces of words whose ids a worker keeps from task to task; beyond it starts anew.
CACHE_WORDS = 1 << 20
#: Pieces encoded at a time; an encoding holds much more than its ids.
BATCH_WORDS = 4096
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII that letters can be parted from: all but the apostrophe, which may begin a token of letters, and `<`, which may begin a special token.
APART = np.zeros(256, bool)
APART[[x for x in range(0x21, 0x7F) if not LETTER[x] and x not in b"'<"]] = True


class WordEncoder:
    """Token ids of whole texts from ids of pieces of their white-space separated words, each encoded once.

    Holds for tokenizers that drop white space and never merge across it. Where
    one also makes letters small and parts letters from other ASCII characters
    (it is tried out), words are cut there and folded, so there are fewer
    different ones. A word that may hold a special token is left as it is.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        parts = ["ab", ".", "cde", "(", "x", "12", "yz", "-", "q", ";"]
        whole, single = self._tokens("".join(parts).upper()), [x for p in parts for x in self._tokens(p)]
        self.cuts = whole == single
        # whether a token ends a run of letters, if the vocabulary tells
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(0, bool)
        if self.cuts and suffix:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._reset()

    def _tokens(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _reset(self) -> None:
        # hashes in order, and each one's place in ids
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = np.array([self.end_id], np.uint32), np.array([0, 1])

    def _pieces(self, c: X.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, hashes, whether letters only, offsets of texts) of the pieces of a chunk's words."""
        w = X.words(c, fold=False)
        if not self.cuts or not len(w.hash):
            return c.data, w.start, w.end, w.hash, np.zeros(len(w.hash), bool), w.word_offsets
        data = X.LOWER[c.data]
        word = np.cumsum(np.bincount(w.start, minlength=len(data))) - 1
        whole = np.zeros(len(w.hash), bool)
        whole[word[np.flatnonzero(data == 0x3C)]] = True
        raw = whole[word]
        data[raw] = c.data[raw]
        letter, apart = LETTER[data], APART[data]
        # U+00C0 to U+00FF are letters of two bytes, but for two signs
        pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[:-1] |= pair
        letter[1:] |= pair
        begins = np.zeros(len(data), bool)
        begins[1:] = ((letter[:-1] & apart[1:]) | (apart[:-1] & letter[1:])) & ~raw[1:]
        begins[w.start] = True
        start = np.flatnonzero(begins)
        end = np.minimum(np.append(start[1:], len(data)), w.end[word[start]])
        outside = np.concatenate([[0], np.cumsum(~letter)])
        return data, start, end, X.byte_hashes(data, start, end), outside[end] == outside[start], np.searchsorted(start, c.offsets)

    def _encoded(self, texts: list[str], letters: bool) -> tuple[list[int], list[int]]:
        """(ids one after another, how many of each text); runs of letters go as one text, parted where a token ends a run."""
        if letters and len(self.ends):
            ids = self._tokens(" ".join(texts))
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(texts) and last[-1] == len(ids) - 1:
                return ids, np.diff(last, prepend=-1).tolist()
        found = [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return list(chain.from_iterable(found)), list(map(len, found))

    def encode(self, c: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of texts); every text ends with end_id."""
        data, start, end, hashes, letters, offsets = self._pieces(c)
        h, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self._reset()
        place = np.searchsorted(self.known, h)
        there = place < len(self.known)
        there[there] = self.known[place[there]] == h[there]
        new = np.flatnonzero(~there)
        if len(new):
            raw = data.tobytes()
            ids, sizes = [self.ids], []
            new = new[np.argsort(~letters[first[new]], kind="stable")]
            joined = int(letters[first[new]].sum())
            for a in (*range(0, joined, BATCH_WORDS), *range(joined, len(new), BATCH_WORDS)):
                some = first[new[a : min(a + BATCH_WORDS, joined if a < joined else len(new))]]
                texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(start[some].tolist(), end[some].tolist(), strict=True)]
                found, n = self._encoded(texts, a < joined)
                ids.append(np.array(found, np.uint32))
                sizes += n
            slots = np.empty(len(h), np.int64)
            slots[new] = len(self.at) - 1 + np.arange(len(new))
            new = np.sort(new)
            self.known = np.insert(self.known, place[new], h[new])
            self.slots = np.insert(self.slots, place[new], slots[new])
            self.ids = np.concatenate(ids)
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes, dtype=np.int64)])
        slot = self.slots[np.searchsorted(self.known, h)][inverse]
        slot = np.insert(slot, offsets[1:], 0)
        size = self.at[slot + 1] - self.at[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[slot] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.concatenate([[0], offsets[1:] + np.arange(1, c.n + 1)])]


@lru_cache(1)
def _encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end_id)
        for batch in batches:
            for c in X.chunks(batch.column("text")):
                ids, at = encoder.encode(c)
                n = -(-np.diff(at) // capacity)
                row = np.repeat(np.arange(c.n), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(at)[row] - start)
                raw, begin = memoryview(ids.astype("<u4").tobytes()), at[row] + start
                crc = [zlib.crc32(raw[4 * s : 4 * (s + k)]) for s, k in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(c.first, c.n).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Every choice of one to three of the lengths that sums to the capacity, as ascending rows padded with 0."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.flatnonzero(there), np.flatnonzero(there), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = capacity - a - b
    ok = (a <= b) & (b <= c)
    a, b, c = a[ok], b[ok], c[ok]
    ok = there[c]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fitted(rows: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of pattern rows with the least weighted squares of (patterns' lengths - counts)."""
    size = len(counts)
    weight = np.linspace(0.1, 1.0, size)
    weight[0] = 0
    scale = max(counts.max(), 1)
    target = counts / scale

    def lengths(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(rows[:, k], x, size) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    # a diagonal step: each row's sum in the normal matrix bounds its curvature
    step = 1 / np.maximum(back(weight * lengths(np.ones(len(rows)))), 1e-9)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        z = np.maximum(0, y - step * back(weight * (lengths(y) - target)))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = z + (before - 1) / t * (z - x), z
    return x * scale


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: (lengths, repeats) of the sequences."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []
    done = []

    def put(space: int, lengths: tuple[int, ...], repeats: int) -> None:
        if not repeats:
            return
        if not space:
            done.append((lengths, repeats))
        elif space in open_:
            open_[space].append((lengths, repeats))
        else:
            open_[space] = [(lengths, repeats)]
            bisect.insort(spaces, space)

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            i = bisect.bisect_left(spaces, length)
            if i == len(spaces):
                each = capacity // length
                put(capacity - each * length, (length,) * each, left // each)
                put(capacity - left % each * length, (length,) * (left % each), int(left % each > 0))
                break
            space = spaces[i]
            lengths, repeats = open_[space].pop()
            if not open_[space]:
                del open_[space], spaces[i]
            used = min(left, repeats)
            put(space, lengths, repeats - used)
            put(space - length, (*lengths, length), used)
            left -= used
    return done + [x for group in open_.values() for x in group]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold the whole histogram (counts by length, 0 to capacity)."""
    left = counts.astype(np.int64).copy()
    out = []
    if left.any():
        rows = patterns(np.flatnonzero(left), capacity)
        x = fitted(rows, left.astype(float)) if len(rows) else np.zeros(0)
        repeats = np.floor(x + 0.5).astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            if repeats[j] <= 0:
                break
            lengths = rows[j][rows[j] > 0]
            kinds, times = np.unique(lengths, return_counts=True)
            n = int(min(repeats[j], (left[kinds] // times).min()))
            if n > 0:
                left[kinds] -= n * times
                out.append((tuple(lengths.tolist()), n))
    return out + best_fit(left, capacity)


def _slots(sequences: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, ranks from `rank` on go to sequences from `sequence` on, at `offset`."""
    used, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for lengths, repeats in sequences:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], base, offset))
            used[n] += repeats
            offset += n
        base += repeats
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _local_ranks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, seen = TaskContext.get().partitionId(), {}
    for f in frames:
        rank = f.groupby("length").cumcount() + f["length"].map(seen).fillna(0).astype("int64")
        for n, k in f["length"].value_counts().items():
            seen[n] = seen.get(n, 0) + k
        yield f.assign(part=part, rank=rank)


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; see the module."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = checkpointed(docs.mapInArrow(_pieces(tokenizer_path, end_id, capacity), "id long, piece int, start long, length long, ids_crc32 long"))
    ranked = checkpointed(pieces.mapInPandas(_local_ranks, "id long, piece int, start long, length long, ids_crc32 long, part int, rank long"))
    parts = ranked.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    slots = docs.sparkSession.sparkContext.broadcast(_slots(plan(counts, capacity), capacity))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value
        for f in frames:
            rank = (f["rank"] + f["base"]).to_numpy()
            at = np.searchsorted(table["key"], (f["length"].to_numpy() << 48) + rank, side="right") - 1
            f = f.assign(sequence_id=table["sequence"][at] + rank - table["rank"][at], offset=table["offset"][at])
            yield f[["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]
        X.release_memory()

    out = ranked.join(base, ["part", "length"]).mapInPandas(deal, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
