"""Repeated substrings by the common-prefix interval tree of an enhanced suffix array.

A repeat group is a string of `length` bytes with all its occurrences (at least
two, anywhere in the corpus, overlaps included; never across texts). Texts are
UTF-8 bytes. Suffixes are sampled, so that the array is spread over tasks:

1. In every window of `min_length` bytes the 32-byte string with the smallest
   hash is its anchor. Equal windows have equal anchors at equal places, so
   nothing of `min_length` bytes or more is missed.
2. Anchors whose string occurs once in the corpus are dropped. They are told by
   a Bloom filter of fixed size built from the counts of all anchors; its false
   positives only cost rows.
3. Each anchor left is a suffix with a bounded context: all windows it can
   anchor. Anchors with equal contexts (told by a hash) are one repeat group as
   they stand; only the first of them goes on, and only if its anchor string
   has other contexts too. Equal contexts are combined before the shuffle.
4. These suffixes go, with their contexts' bytes, to the task of the context's
   66 or 67 middle bytes (one half of the windows each), so a short common
   string doesn't gather its surroundings in one task. A task sorts its suffixes, takes common-prefix lengths of neighbours, and
   scans them with a stack: every interval is a set of suffixes that share so
   many bytes. Inside an interval, the left contexts get the same scan; an
   interval of theirs is left-diverse where it ends, so each pair of intervals
   with left + right >= min_length is a repeat group that neither side can
   extend within its context. All of its occurrences come out.

Contexts are bounded, so a longer repeat comes out as overlapping groups of
min_length to about 135 bytes, whose union it is; the bytes covered are exact.

Nulls and empty texts have no repeats. Rows with a null id are neither matched
nor cut. Ids are taken as unique: rows that repeat an id count as one document.
No documents give no rows; a very long text is a chunk of its own, held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .spark_util import checkpointed, has_bit, id_slot, slot_bits, wanted_ids, written

K = 32
#: Bits of each filter of anchors; broadcast, whatever the corpus.
FILTER_BITS = 1 << 26
_NONE = np.uint64(2**64 - 1)
_POSITION = np.uint64((1 << 24) - 1)
_BLOCK = 1 << 22
#: Bytes of texts looked at together; what repeats among them is combined before it is shuffled.
CHUNK = 1 << 20


def _substring_hashes(c: X.Chunk, total: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return X.mix((total[start + size] - total[start]) * X.powers(len(c.data) + 1, True)[start])


def _prefix_sums(c: X.Chunk) -> np.ndarray:
    total = np.zeros(len(c.data) + 1, np.uint64)
    np.cumsum(X._RAW[c.data] * X.powers(len(c.data)), out=total[1:])
    return total


def anchors(c: X.Chunk, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, prefix sums) of the chunk's anchors."""
    data, window = c.data, min_length - K + 1
    total = _prefix_sums(c)
    if len(data) < min_length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), total
    h = X.mix((total[K:] - total[:-K]) * X.powers(len(data) + 1, True)[: len(data) - K + 1])
    # a window is good where it starts at least min_length before its text's end
    good = np.ones(len(data) - min_length + 1, bool)
    for end in c.offsets[1:-1]:
        good[max(0, end - min_length + 1) : end] = False
    places = []
    for at in range(0, len(good), _BLOCK):
        n = min(_BLOCK, len(good) - at)
        key = (h[at : at + n + window - 1] & ~_POSITION) | np.arange(n + window - 1, dtype=np.uint64)
        low, width = key, 1
        while width * 2 <= window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[window - width : window - width + n])
        p = (low[good[at : at + n]] & _POSITION).astype(np.int64) + at
        if len(p):
            places.append(p[np.concatenate([[True], p[1:] != p[:-1]])])
    p = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
    return p, h[p], total


def _anchor_hashes(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in X.chunks(batch.column("text"), CHUNK):
                h, k = np.unique(anchors(c, min_length)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(h)), pa.array(k.astype(np.int64))], ["h", "k"])

    return run


def _place_slot(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The filter's bit for an anchor's place."""
    return (X.mix(X.mix(own.astype(np.uint64)) + at.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


@dataclass
class _Suffixes:
    """A chunk's repeated anchors: places, hashes, ids and places in their texts; bounds of their texts."""

    at: np.ndarray
    hash: np.ndarray
    id: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def _suffixes(batch: pa.RecordBatch, c: X.Chunk, min_length: int, repeated: np.ndarray) -> _Suffixes:
    p, h, total = anchors(c, min_length)
    keep = has_bit(repeated, (h % np.uint64(FILTER_BITS)).astype(np.int64))
    p, h = p[keep], h[keep]
    text = c.text_of(p)
    ids = batch.column("id").slice(c.first, c.n).to_numpy(zero_copy_only=False)
    return _Suffixes(p, h, ids[text].astype(np.int64), p - c.offsets[text], c.offsets[text], c.offsets[text + 1], total)


_SLIM = "h long, same long, id long, place long, back int, size int, first_id long, first_place long"


def _slim(min_length: int, repeated: np.ndarray):
    """Repeated anchors with a hash of their whole context; of equal ones in a chunk only the first has no first_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in X.chunks(batch.column("text"), CHUNK):
                x = _suffixes(batch, c, min_length, repeated)
                if not len(x.at):
                    continue
                s, e = np.maximum(x.at - (min_length - K), x.low), np.minimum(x.at + min_length, x.high)
                same = X.mix((x.total[e] - x.total[s]) * X.powers(len(c.data) + 1, True)[s])
                same = X.mix(same + (e - s).astype(np.uint64) * X._K[0] + (x.at - s).astype(np.uint64) * X._K[1])
                order = np.lexsort((x.place, x.id, same, x.hash))
                new = np.concatenate([[True], same[order][1:] != same[order][:-1]])
                first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                key = np.where(new, x.hash[order], X.mix(x.id[order].astype(np.uint64) + x.place[order].astype(np.uint64)))
                none = pa.array(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(X.signed(key)), pa.array(X.signed(same[order])), pa.array(x.id[order]), pa.array(x.place[order]), pa.array((x.at - s)[order].astype(np.int32)), pa.array((e - s)[order].astype(np.int32)), pc.if_else(none, None, pa.array(x.id[first])), pc.if_else(none, None, pa.array(x.place[first]))],
                    ["h", "same", "id", "place", "back", "size", "first_id", "first_place"],
                )

    return run


_CLASSES = "id long, start long, length long, first_id long, first_start long, slot long"


def _classes(min_length: int):
    """Slim rows sorted by all but sizes: later ones of equal contexts as occurrences; the firsts of strings with several contexts by slot."""

    def out(f: pd.DataFrame) -> pd.DataFrame:
        done = f["first_id"].notna().to_numpy()
        alone = f[~done]
        h, same, own, place = (alone[k].to_numpy() for k in ("h", "same", "id", "place"))
        new = np.ones(len(alone), bool)
        new[1:] = (h[1:] != h[:-1]) | (same[1:] != same[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = ~new & ((own != own[first]) | (place != place[first]))
        again = pd.concat([f[done], alone[later].assign(first_id=own[first][later], first_place=place[first][later])])
        again = again[again["size"] >= min_length]
        edge = X.runs(h)
        kinds = np.add.reduceat(new, edge[:-1]) if len(h) else np.zeros(0, np.int64)
        reps = new & np.repeat(kinds > 1, np.diff(edge))
        back = again["back"].to_numpy()
        found = pd.DataFrame({"id": again["id"], "start": again["place"] - back, "length": again["size"].astype("int64"), "first_id": again["first_id"].astype("int64"), "first_start": again["first_place"].astype("int64") - back, "slot": None})
        kept = pd.DataFrame({"id": own[reps], "start": None, "length": None, "first_id": None, "first_start": None, "slot": _place_slot(own[reps], place[reps])})
        return pd.concat([x.astype("Int64") for x in (found, kept)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames, "h"):
            yield out(f)

    return run


def _whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames sorted by key, cut anew so that none parts a key's rows."""
    rest: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        rest.append(f)
        if sum(map(len, rest)) < 20_000:
            continue
        f = pd.concat(rest)
        cut = int(np.argmax((f[key] == f[key].iloc[-1]).to_numpy()))
        if cut:
            yield f.iloc[:cut]
        rest = [f.iloc[cut:]]
        X.release_memory()
    if rest:
        yield pd.concat(rest)
    X.release_memory()


_CONTEXT = "key long, right_half boolean, id long, at long, l binary, r binary"


def _contexts(min_length: int, repeated: np.ndarray, wanted: np.ndarray):
    """The wanted anchors with their contexts' bytes, left ones backwards, for each half of the windows."""
    half = (min_length - K) // 2
    #: (left bytes kept, right bytes kept, left and right bytes of the key) of the windows that start up to half before, and of the others
    sides = ((True, half, min_length, 0, min_length - half), (False, min_length - K, min_length - half - 1, half + 1, K))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in X.chunks(batch.column("text"), CHUNK):
                x = _suffixes(batch, c, min_length, repeated)
                keep = has_bit(wanted, _place_slot(x.id, x.place))
                for right_half, left, right, key_left, key_right in sides:
                    ok = np.flatnonzero(keep & (x.at - key_left >= x.low) & (x.at + key_right <= x.high))
                    q = x.at[ok]
                    key = _substring_hashes(c, x.total, q - key_left, key_left + key_right)
                    l = [c.data[a:b][::-1].tobytes() for a, b in zip(np.maximum(q - left, x.low[ok]), q, strict=True)]  # noqa: E741
                    r = [c.data[a:b].tobytes() for a, b in zip(q, np.minimum(q + right, x.high[ok]), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(X.signed(key)), pa.array(np.full(len(ok), right_half)), pa.array(x.id[ok]), pa.array(x.place[ok]), pa.array(l, pa.binary()), pa.array(r, pa.binary())], ["key", "right_half", "id", "at", "l", "r"])

    return run


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of common-prefix lengths with their left neighbours: (length, start, end) of every interval of at least `least`."""
    stack = [(least - 1, 0)]
    for i, x in enumerate([*lcp.tolist(), -1]):
        if i == 0:
            continue
        start = i - 1
        while stack[-1][0] > x and len(stack) > 1:
            length, start = stack.pop()
            yield length, start, i
        if x > stack[-1][0]:
            stack.append((x, start))


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, padded with zeros, and their lengths."""
    n = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in values), np.uint8)
    return flat.reshape(len(values), width), n


def _common(m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of rows a and b."""
    differ = m[a] != m[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(first, np.minimum(n[a], n[b]))


def _sorted(m: np.ndarray, n: np.ndarray, *before: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(m), -(-m.shape[1] // 8) * 8), np.uint8)
    wide[:, : m.shape[1]] = m
    columns = wide.view(">u8")
    return np.lexsort((n, *(columns[:, i] for i in reversed(range(columns.shape[1]))), *before))


def _groups(min_length: int):
    """Suffixes of whole key groups: the occurrences of their repeat groups."""

    def found(f: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
        key = f["key"].to_numpy() * 2 + f["right_half"].to_numpy()
        own, at = f["id"].to_numpy(), f["at"].to_numpy()
        right, n_right = _matrix(f["r"].tolist(), min_length)
        left, n_left = _matrix(f["l"].tolist(), min_length - K)
        sa = _sorted(right, n_right, key)
        lcp = np.zeros(len(sa), np.int64)
        lcp[1:] = np.where(key[sa[1:]] == key[sa[:-1]], _common(right, n_right, sa[1:], sa[:-1]), -1)
        order = np.empty(len(f), np.int64)
        order[np.lexsort((at, own))] = np.arange(len(f))
        left_rank = np.empty(len(f), np.int64)
        left_rank[_sorted(left, n_left)] = np.arange(len(f))
        pairs = []
        for length, s, e in intervals(lcp, K):
            if e - s == 2:
                pairs.append((length, sa[s], sa[s + 1]))
                continue
            rows = sa[s:e][np.argsort(left_rank[sa[s:e]])]
            common = np.zeros(len(rows), np.int64)
            common[1:] = _common(left, n_left, rows[1:], rows[:-1])
            # 0 is an extension too: the suffixes share nothing to their left
            for more, a, b in intervals(common, max(min_length - length, 0)):
                group = rows[a:b]
                first = group[np.argmin(order[group])]
                yield own[group], at[group] - more, np.full(len(group), more + length), np.full(len(group), own[first]), np.full(len(group), at[first] - more)
        if pairs:
            length, a, b = np.array(pairs).T
            more = _common(left, n_left, a, b)
            ok = more + length >= min_length
            length, a, b, more = length[ok], a[ok], b[ok], more[ok]
            first = np.where(order[a] < order[b], a, b)
            for x in (a, b):
                yield own[x], at[x] - more, length + more, own[first], at[first] - more

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames, "key"):
            held: list[tuple[np.ndarray, ...]] = []
            n = 0
            for part in found(f) if len(f) > 1 else ():
                held.append(part)
                n += len(part[0])
                if n > OUT_ROWS:
                    yield _occurrences(held)
                    held, n = [], 0
            if held:
                yield _occurrences(held)

    return run


#: Occurrences that a task holds before it hands them on; nested intervals of a large group give far more than its rows.
OUT_ROWS = 50_000


def _occurrences(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    names = ("id", "start", "length", "first_id", "first_start")
    return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 100) -> DataFrame:
    """All occurrences of the repeat groups: (id, start, length, first_id, first_start).

    A group is told by its first occurrence (smallest id, then start) and length.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    counts = docs.mapInArrow(_anchor_hashes(min_length), "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).where("k > 1")
    seen = slot_bits(counts.select(F.pmod("h", F.lit(FILTER_BITS)).alias("slot")), FILTER_BITS)
    repeated = spark.sparkContext.broadcast(seen)
    slim = docs.mapInArrow(lambda it: _slim(min_length, repeated.value)(it), _SLIM)
    classes = written(slim.repartition("h").sortWithinPartitions("h", "same", "id", "place").mapInPandas(_classes(min_length), _CLASSES))
    wanted = spark.sparkContext.broadcast(slot_bits(classes.where("slot is not null").select("slot"), FILTER_BITS))
    contexts = docs.mapInArrow(lambda it: _contexts(min_length, repeated.value, wanted.value)(it), _CONTEXT)
    groups = contexts.repartition("key").sortWithinPartitions("key").mapInPandas(_groups(min_length), "id long, start long, length long, first_id long, first_start long")
    return groups.unionByName(classes.where("slot is null").drop("slot"))


def _joined_spans(f: pd.DataFrame) -> pd.DataFrame:
    """Spans sorted by text and start, those that touch made one."""
    start, end = f["start"].to_numpy(), f.groupby("id", sort=False)["end"].cummax().to_numpy()
    own = f["id"].to_numpy()
    new = np.ones(len(f), bool)
    new[1:] = (own[1:] != own[:-1]) | (start[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(f)) - 1
    return pd.DataFrame({"id": own[new], "start": start[new], "end": end[last]})


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in _whole_groups(frames, "id"):
        yield _joined_spans(f)


def _merged_here(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of one batch made fewer before they are shuffled."""
    for f in frames:
        if len(f):
            yield _joined_spans(f.sort_values(["id", "start"]))


Give = Callable[[bytes, int, bytes], tuple]


def _cut(give: Give, fields: list[pa.Field]):
    """give(text, number of removed runs, kept bytes) of each text; `spans` holds starts and ends in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, edges = text or b"", [0, *(spans or [])]
                kept = b"".join([*(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=False)), text[edges[-1] :]])
                rows.append(give(text, len(edges) // 2, kept))
            X.release_memory()
            columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, f.type) for x, f in zip(columns, fields, strict=True))], ["id", *(f.name for f in fields)])

    return run


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, min_length: int, give: Give, fields: list[pa.Field], schema: str) -> DataFrame:
    """give() of every row. Only texts that may have something removed are shuffled; the others are answered where they are read."""
    later = repeat_groups(docs, id_col, text_col, min_length).where("id <> first_id or start <> first_start")
    near = later.select("id", "start", (F.col("start") + F.col("length")).alias("end")).mapInPandas(_merged_here, "id long, start long, end long")
    parts = near.repartition("id").sortWithinPartitions("id", "start")
    each = parts.mapInPandas(_merged, "id long, start long, end long").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x"))
    spans = checkpointed(each.select("id", F.flatten(F.transform("x", lambda x: F.array(x["start"], x["end"]))).alias("spans")))
    sketch = docs.sparkSession.sparkContext.broadcast(wanted_ids(spans.select("id")))

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = batch.column("slot").to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(has_bit(sketch.value, slot) == inside))

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("slot", id_slot("id"))
    same, cut = (rows.mapInArrow(part(x), "id long, text string, slot long").drop("slot") for x in (False, True))
    both = same.withColumn("spans", F.lit(None).cast("array<long>")).unionByName(cut.join(spans, "id", "left"))
    return both.mapInArrow(_cut(give, fields), f"id long, {schema}")


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 100) -> DataFrame:
    """Bytes covered by a string of min_length bytes that also starts earlier, removed: (id, n_bytes, n_removed, n_spans, kept_sha256)."""

    def give(text: bytes, runs: int, kept: bytes) -> tuple:
        return len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()

    fields = [*(pa.field(x, pa.int64()) for x in ("n_bytes", "n_removed", "n_spans")), pa.field("kept_sha256", pa.string())]
    out = _without_repeats(docs, id_col, text_col, min_length, give, fields, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def removed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 100) -> DataFrame:
    """(id, text, n_removed) without later repeats; a character cut in its middle goes whole."""

    def give(text: bytes, runs: int, kept: bytes) -> tuple:
        return kept.decode("utf-8", "ignore"), len(text) - len(kept)

    out = _without_repeats(docs, id_col, text_col, min_length, give, [pa.field("text", pa.string()), pa.field("n_removed", pa.int64())], "text string, n_removed long")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})
