"""Ranked search over impact-ordered postings, score at a time.

Documents are searched shard by shard inside tasks: a shard holds the postings
of some thousand documents, of the queries' terms only. A posting's impact is
what it adds to a score, an integer; a term's postings lie in groups of equal
impact, the greatest first.

1. One pass counts the documents with a term, all terms, and the documents that
   hold each query term (over all documents).
2. A second pass builds the shards. For an item the groups of its terms are
   added to the documents' sums level by level, in descending order of impact,
   until what all its terms can still add is less than the item's k-th best sum
   so far (of this task's earlier shards too): documents not met by then can't
   be among the k best. Those whose sum and bound still reach it are completed
   exactly by looking up their postings.
3. Each task's k best for each item are merged in two steps, by item and some
   part of the tasks, then by item.

Items go to the tasks in blocks of a bounded number of items and terms; each
block is one such search over all documents.

Terms are maximal runs of ASCII letters and digits and of any characters beyond
ASCII, A-Z as a-z, and are told apart by a 64-bit hash. A null or empty text has
no terms: such a document is in no result, such an item has none. Equal scores
rank by ascending doc_id, null last. Rows that repeat a doc_id are documents of
their own. Rows that repeat an item_id are one item, that of the smallest text;
a null item_id is an item like another. Empty tables give no rows. A very long
document is a shard's row like any other; a very long item is a block alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import textops as X
from .spark_util import checkpointed

#: Bytes that are not part of a term.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Items and terms of a block (expected; items are dealt to blocks by hash), and what ends a shard.
BLOCK_ITEMS, BLOCK_TERMS = 4096, 1 << 20
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21
#: Groups are added until at most so many documents are left to complete, or none are left.
FEW = 1024
#: Parts of the tasks that are merged first.
PARTS = 32

_WHOLE, _TERMS = -1, -2


def _terms(c: X.Chunk) -> X.Words:
    return X.words(c, space=OUTSIDE)


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are there, their places)."""
    at = np.searchsorted(sorted_keys, keys)
    there = at < len(sorted_keys)
    there[there] = sorted_keys[at[there]] == keys[there]
    return there, at


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in X.chunks(batch.column("text")):
            w = _terms(c)
            order = np.lexsort((w.hash, w.text))
            text, h = w.text[order], w.hash[order]
            new = np.ones(len(h), bool)
            new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
            text, h = text[new], h[new]
            offsets = np.searchsorted(text, np.arange(c.n + 1))
            yield pa.RecordBatch.from_arrays([batch.column("item").slice(c.first, c.n), X.list_column(X.signed(h), offsets)], ["item", "terms"])


def _counted(wanted: np.ndarray):
    """Tasks' (term, n): documents that hold a wanted term; under _WHOLE documents with a term, under _TERMS all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, terms = np.zeros(len(wanted), np.int64), 0, 0
        for batch in batches:
            for c in X.chunks(batch.column("text")):
                w = _terms(c)
                docs += int((np.diff(w.word_offsets) > 0).sum())
                terms += len(w.hash)
                there, at = _among(wanted, w.hash)
                pairs = np.unique(w.text[there] * len(wanted) + at[there])
                n += np.bincount(pairs % max(len(wanted), 1), minlength=len(wanted))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [_WHOLE, _TERMS]])), pa.array(np.concatenate([n[some], [docs, terms]]))], ["term", "n"])

    return run


@dataclass
class Postings:
    """A shard's postings by term, then impact descending; keys (document and term) in order with their impacts, for completing."""

    start: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    keys: np.ndarray
    key_impact: np.ndarray
    n_docs: int


def postings(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> Postings:
    order = np.lexsort((doc, -impact, term))
    keys = doc * n_terms + term
    by_key = np.argsort(keys)
    return Postings(np.searchsorted(term[order], np.arange(n_terms + 1)), doc[order], impact[order], keys[by_key], impact[by_key], n_docs)


def best(p: Postings, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, exact scores) of all that may be among the k best, by score at a time; least: a score the k-th best has already."""
    at, end = p.start[terms].copy(), p.start[terms + 1]
    sums = np.zeros(p.n_docs, np.int64)
    depth = 16
    while True:
        open_ = np.flatnonzero(at < end)
        rest = int(p.impact[at[open_]].sum())
        reached = max(least, int(np.partition(sums, -k)[-k]) if p.n_docs >= k else 0)
        if rest < reached or not rest:
            found = np.flatnonzero((sums > 0) & (sums + rest >= reached))
            if len(found) <= FEW or not rest:
                break
        # the level below which each term keeps at least its groups beyond `depth` more postings
        level = int(p.impact[np.minimum(at[open_] + depth, end[open_] - 1)].max())
        for j in open_.tolist():
            a, b = int(at[j]), int(end[j])
            stop = a + int(np.searchsorted(-p.impact[a:b], -level, side="right"))
            if stop > a:
                sums[p.doc[a:stop]] += p.impact[a:stop]
                at[j] = stop
        depth *= 2
    if rest and len(found):
        keys = found[:, None] * (len(p.start) - 1) + terms[None, :]
        there, place = _among(p.keys, keys.ravel())
        place[~there] = 0
        return found, np.where(there, p.key_impact[place], 0).reshape(keys.shape).sum(axis=1)
    return found, sums[found]


class Searcher:
    """A task's search: shards of documents one after another, the k best of each item so far."""

    def __init__(self, table: dict, k: int):
        self.hash, self.weight, self.items, self.k = table["hash"], table["weight"], table["items"], k
        self.n, self.total = table["n"], table["total"]
        #: item -> [(-score, id is null, id)], the best first
        self.top: dict[int, list[tuple[int, bool, int]]] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_docs = self.n_postings = 0

    def add(self, ids: pa.Array, c: X.Chunk) -> None:
        w = _terms(c)
        length = np.diff(w.word_offsets).astype(np.int64)
        there, at = _among(self.hash, w.hash)
        keys, tf = np.unique(w.text[there] * len(self.hash) + at[there], return_counts=True)
        doc, term = keys // max(len(self.hash), 1), keys % max(len(self.hash), 1)
        spread = 10 + 90 * length * self.n // max(self.total, 1) if length.max(initial=0) * self.n < 1 << 56 else np.array([10 + 90 * x * self.n // self.total for x in length.tolist()], np.int64)
        impact = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * spread[doc]))
        some = impact > 0
        self.parts.append((doc[some] + self.n_docs, term[some], impact[some]))
        self.ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.nulls.append(ids.is_null().to_numpy(zero_copy_only=False))
        self.n_docs += c.n
        self.n_postings += int(some.sum())
        if self.n_docs >= SHARD_DOCS or self.n_postings >= SHARD_POSTINGS:
            self.search()

    def search(self) -> None:
        """All items over the shard gathered, which then is done with."""
        if self.n_postings:
            ids, nulls = np.concatenate(self.ids), np.concatenate(self.nulls)
            p = postings(*(np.concatenate([x[i] for x in self.parts]) for i in range(3)), self.n_docs, len(self.hash))
            there = np.diff(p.start) > 0
            for item, terms in enumerate(self.items):
                if len(terms := terms[there[terms]]):
                    top = self.top.get(item, [])
                    docs, scores = best(p, terms, self.k, -top[-1][0] if len(top) == self.k else 0)
                    if len(docs):
                        merged = top + list(zip((-scores).tolist(), nulls[docs].tolist(), ids[docs].tolist(), strict=True))
                        self.top[item] = sorted(merged)[: self.k]
        self._clear()


def _searched(table, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(table.value, k)
        for batch in batches:
            for c in X.chunks(batch.column("text")):
                searcher.add(batch.column("id").slice(c.first, c.n), c)
        searcher.search()
        X.release_memory()
        rows = [(i, TaskContext.get().partitionId() % PARTS, None if null else doc, -score) for i, top in searcher.top.items() for score, null, doc in top]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["number", "part", "id", "score"])

    return run


def _best_rows(rows: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents with a score above 0; see the module."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = items.groupBy(F.col(item_col).alias("item")).agg(F.min(item_text_col).alias("text"))
    items = checkpointed(items.mapInArrow(_item_terms, items.select("item").schema.add("terms", ArrayType(LongType()))))
    size = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks = max(1, -(-size["items"] // BLOCK_ITEMS), -(-size["terms"] // BLOCK_TERMS))
    found = [_block(docs, items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = items.collect()
    hashes = np.unique(X.unsigned(np.concatenate([np.array(r["terms"], np.int64) for r in rows]))) if rows else np.zeros(0, np.uint64)
    counts = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(_counted(hashes), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = counts.get(_WHOLE, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(hashes))], np.int64)
    terms = [np.searchsorted(hashes, X.unsigned(np.array(r["terms"], np.int64))) for r in rows]
    table = spark.sparkContext.broadcast({"hash": hashes, "weight": weight, "items": terms, "n": n, "total": counts.get(_TERMS, 0)})
    found = docs.mapInArrow(_searched(table, k), "number long, part long, id long, score long")
    found = _best_rows(_best_rows(found, ("number", "part"), k), ("number",), k)
    names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], items.select(F.lit(0).cast("long").alias("number"), "item").schema)
    return found.join(F.broadcast(names), "number").select("item", "rank", "id", "score")


#: The same in DuckDB's SQL, for k = 10.
ORACLE = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
lengths AS (SELECT doc_id, len(terms)::BIGINT AS n FROM lowered WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM lowered) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), totals),
spread AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM lengths, totals),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN spread USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
