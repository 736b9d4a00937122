"""Hierarchical packing into context windows of several sizes (tiers).

A task packs its own documents, block by block; nothing is shuffled.

1. Routing: what a document has beyond whole windows of the largest tier belongs
   to the smallest tier that holds it; the whole windows are full as they are.
2. Packing: tier by tier, the largest first, each piece opens a window of its
   tier and its gap is filled from the pieces of shorter tiers, whole: by one,
   two or three that fit exactly, else by the longest that fits, and so on.
3. Where nothing fits whole, a piece is cut to fill the gap, if possible one
   whose rest is a window of a tier; what is left of it is routed anew.
4. A window that finds nothing to fill it is open until the task's next block.
   After the last block its tokens go to windows of powers of two. So every
   window is full, and every window's length is a power of two: no padding.
5. Balance: windows are dealt to step groups of about STEP windows' tokens of
   the largest tier, the longest first, then by attention work (the sum of the
   pieces' squared lengths), each to the group with the least tokens, then work.

A null text is empty; an empty text is the one end token. Null ids and repeated
rows are packed like any other. A very long document's windows are given while
it is read, only its rest waits for a block. No documents: no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .packing import _encoder

TIERS = (2048, 1024, 512, 256)
#: Waiting tokens that make a block, and rows of one batch of results.
BLOCK_TOKENS, BATCH_ROWS = 1 << 22, 1 << 14
#: Windows of the largest tier in a step group.
STEP = 16
#: Longest pieces tried for an exact fit of three.
TRIED = 16

#: (document, start, length): document is its place in the block.
Piece = tuple[int, int, int]


class Pool:
    """Pieces by length, with the lengths that there are as bits: upwards, and downwards from `size`."""

    def __init__(self, size: int):
        self.size, self.by = size, [[] for _ in range(size + 1)]
        self.up = self.down = 0

    def put(self, piece: Piece) -> None:
        n = piece[2]
        if not self.by[n]:
            self.up |= 1 << n
            self.down |= 1 << (self.size - n)
        self.by[n].append(piece)

    def take(self, n: int) -> Piece:
        piece = self.by[n].pop()
        if not self.by[n]:
            self.up ^= 1 << n
            self.down ^= 1 << (self.size - n)
        return piece

    def longest(self, most: int) -> int:
        """The longest length up to `most`, or 0."""
        return max((self.up & ((2 << most) - 1)).bit_length() - 1, 0)

    def pair(self, gap: int) -> int:
        """The greater of two lengths that fill the gap, or 0."""
        both = self.up & (self.down >> (self.size - gap)) & ((1 << gap) - 1)
        while both:
            n = both.bit_length() - 1
            if 2 * n != gap or len(self.by[n]) > 1:
                return n
            both ^= 1 << n
        return 0

    def fill(self, gap: int) -> list[int]:
        """Lengths to take next for the gap, none if nothing fits whole."""
        if self.by[gap]:
            return [gap]
        if n := self.pair(gap):
            return [n, gap - n]
        longest = n = self.longest(gap)
        for _ in range(TRIED):
            if not n:
                break
            if m := self.pair(gap - n):
                if [m, gap - n - m].count(n) < len(self.by[n]):
                    return [n, m, gap - n - m]
            n = self.longest(n - 1)
        return [longest] if longest else []


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """(full windows, pieces of the window that found nothing to fill it) of pieces below the largest tier."""
    pool, windows = Pool(tiers[0]), []
    for piece in pieces:
        pool.put(piece)
    for tier, below in zip(tiers, (*tiers[1:], 0), strict=True):
        while (n := pool.longest(tier)) > below:
            window, gap = [pool.take(n)], tier - n
            while gap:
                some = pool.fill(gap)
                if some:
                    window += [pool.take(x) for x in some]
                    gap -= sum(some)
                    continue
                # nothing fits whole: one is cut, best so that its rest is a window
                donor = next((gap + t for t in tiers if gap + t <= tiers[0] and pool.by[gap + t]), 0) or pool.longest(tier)
                if not donor:
                    return windows, window
                doc, start, length = pool.take(donor)
                window.append((doc, start, gap))
                pool.put((doc, start + gap, length - gap))
                gap = 0
            windows.append(window)
    return windows, []


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in windows of descending powers of two."""
    left, out = sum(n for _, _, n in pieces), []
    rest = pieces[::-1]
    while left:
        size = gap = 1 << (left.bit_length() - 1)
        window = []
        while gap:
            doc, start, n = rest.pop()
            window.append((doc, start, min(n, gap)))
            if n > gap:
                rest.append((doc, start + gap, n - gap))
            gap -= min(n, gap)
        out.append(window)
        left -= size
    return out


def balanced(sizes: list[int], work: list[int], step_tokens: int) -> list[int]:
    """Each window's group: as many groups as the tokens fill, about, even in tokens, then in work."""
    groups = [(0, 0, i) for i in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for j in sorted(range(len(sizes)), key=lambda j: (-sizes[j], -work[j])):
        tokens, done, i = groups[0]
        heapq.heapreplace(groups, (tokens + sizes[j], done + work[j], i))
        out[j] = i
    return out


class Packer:
    """A task's blocks. Rows are (document's id, start, length, crc, document's tokens, sequence, offset, tier, group)."""

    def __init__(self, part: int, tiers: tuple[int, ...]):
        self.base, self.tiers = part << 40, tiers
        self.sequences = self.groups = self.tokens = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        #: of each document the ids that wait, and where they begin in it
        self.waiting: list[tuple[int, np.ndarray]] = []
        self.pieces: list[Piece] = []
        self.full: list[tuple[int, int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        most, n = self.tiers[0], len(ids)
        whole = n // most * most
        d = len(self.ids)
        self.ids.append(doc)
        self.sizes.append(n)
        raw = memoryview(np.ascontiguousarray(ids[:whole], "<u4").view(np.uint8))
        self.full += [(d, a, zlib.crc32(raw[4 * a : 4 * (a + most)])) for a in range(0, whole, most)]
        self.waiting.append((whole, ids[whole:].astype("<u4")))
        if n > whole:
            self.pieces.append((d, whole, n - whole))
        self.tokens += n

    def rows(self, last: bool = False) -> list[tuple]:
        """Rows of the windows of all that waits; but for the last block a window that isn't full waits on."""
        windows, rest = pack(self.pieces, self.tiers)
        if last:
            windows += powers(rest)
            rest = []
        most = self.tiers[0]
        sizes = [most] * len(self.full) + [sum(p[2] for p in w) for w in windows]
        work = [most * most] * len(self.full) + [sum(p[2] ** 2 for p in w) for w in windows]
        groups = balanced(sizes, work, STEP * most) if sizes else []
        out = []
        for j, (d, start, crc) in enumerate(self.full):
            out.append((self.ids[d], start, most, crc, self.sizes[d], self.base + self.sequences + j, 0, most, self.base + self.groups + groups[j]))
        for j, window in enumerate(windows, len(self.full)):
            offset = 0
            for d, start, n in window:
                at, ids = self.waiting[d]
                out.append((self.ids[d], start, n, zlib.crc32(ids[start - at : start - at + n]), self.sizes[d], self.base + self.sequences + j, offset, sizes[j], self.base + self.groups + groups[j]))
                offset += n
        self.sequences += len(sizes)
        self.groups += max(groups, default=-1) + 1
        kept = sorted({d for d, _, _ in rest})
        place = {d: i for i, d in enumerate(kept)}
        self.ids, self.sizes, self.waiting = ([x[d] for d in kept] for x in (self.ids, self.sizes, self.waiting))
        self.pieces = [(place[d], start, n) for d, start, n in rest]
        self.full, self.tokens = [], sum(n for _, _, n in rest)
        return out


_SCHEMA = pa.schema([(n, pa.int64()) for n in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("tier", pa.int32()), ("step_group", pa.int64())])


def _tiered(path: str, end_id: int, tiers: tuple[int, ...]):
    def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows), BATCH_ROWS):
            columns = zip(*rows[a : a + BATCH_ROWS], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(path, end_id), Packer(TaskContext.get().partitionId(), tiers)
        for batch in batches:
            names = batch.column("id").to_pylist()
            for c in X.chunks(batch.column("text")):
                ids, at = encoder.encode(c)
                for i in range(c.n):
                    packer.add(names[c.first + i], ids[at[i] : at[i + 1]])
                if packer.tokens >= BLOCK_TOKENS:
                    yield from batches_of(packer.rows())
        yield from batches_of(packer.rows(last=True))
        X.release_memory()

    return run


def tiered(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group) of every piece; see the module.

    tiers are powers of two, descending; tier is a piece's window's length, at the
    end of a task also a lower power of two.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return docs.mapInArrow(_tiered(tokenizer_path, end_id, tiers), schema).withColumnRenamed("id", id_col)
