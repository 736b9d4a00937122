"""Language-model scoring by online logistic context mixing.

A text is a sequence of words and one end; a word is coded as symbols and a
closing one, a symbol as five binary decisions (letters and the commonest marks
are a symbol each, any other byte is three). Six predictors give each decision
log odds: hashed contexts of the last two, three and five symbols, and the
word's whole beginning counted by distinct words, by all words and by the words
of one topic. A mixer adds them with weights from a set gated by how much the
contexts were seen; weights are refined online, by the error of each decision
in turn, every occurrence predicted as if it were not counted.

Words of context come in twice while a text is scored. The topics' word models
are weighted by how well each told the text's words so far. Then the token that
last followed the same three, two or one words in the text is expected: a second
mixer joins the topic mixture's odds for it with its context's hit rate so far
in the text; its weights start the same for each text and are refined after
every few tokens. Probabilities of all texts sum to one.

Topics: a text's three commonest words put it in a bucket; buckets are clustered
by their hashed word histograms, then texts dealt to topics by theirs.
All these tables are of fixed size and counted over all texts to learn from.

At scale: decisions inside a word depend on the word and topic alone, so they
are made once for each distinct word (a table that grows with the corpus, in
pieces of whole beginnings: words that share their first four symbols, or the
first twelve where a byte without symbol is among them), and texts are joined
with it block by block: a block's own dictionary meets the block's texts. Hashed
contexts have a number of slots that follows the distinct words up to MOST_SLOTS;
longer beginnings are counted exactly. Mixers are trained where the words lie
and averaged by what they saw. The words of one first-four-symbols group are in
one task; beyond it a group of millions would need longer beginnings.

Null and empty texts are one end; very long ones are scored in whole. Null ids
are held out: never learned from. Repeated rows count and are scored each. No
rows give no rows. Words are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import textops as X
from .spark_util import dense, written

#: Least and most slots of a table of hashed contexts (powers of two); the second bounds what is broadcast.
LEAST_SLOTS, MOST_SLOTS = 1 << 14, 1 << 18
ORDERS = (2, 3, 5)
#: Topics, buckets of texts, slots of a bucket's histogram.
TOPICS, BUCKETS, HISTOGRAM = 5, 1024, 256
#: Mixer: predictors, and weight sets by how often the topic saw the beginning, how often five symbols were seen, whether one bit only followed.
INPUTS = len(ORDERS) + 3
LEVELS = 12
GATES = LEVELS * 4 * 2
#: Step of the mixer's training, rows of a step, most occurrences in one of its rows.
STEP, STEP_ROWS, STEP_COUNT = 0.05, 8192, 256
#: Words looked at together, rows of a block.
PIECE, BLOCK_ROWS = 8192, 8192
END = np.uint64(0x5851F42D4C957F2D)
#: Symbols: letters 0 to 25, then the closing one, three marks and the first byte of most accented letters; ESCAPE comes before a byte's two halves.
CLOSE, ESCAPE, BITS = 26, 31, 5
_SYMBOL = np.full(256, ESCAPE, np.uint8)
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[[0x2E, 0x2C, 0x2D, 0xC3]] = [27, 28, 29, 30]
#: The bits of each symbol, and how many leading ones two symbols share by their exclusive or.
_BITS = ((np.arange(1 << BITS)[:, None] >> (BITS - 1 - np.arange(BITS))) & 1).astype(bool)
_LEAD = np.array([max(BITS - x.bit_length(), 0) for x in range(256)], np.int64)
_NODE = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 1 << BITS, np.uint64)
#: Beginnings of fewer symbols are in the table, others counted in their piece; the second where a byte without symbol is among the first.
SHORT, SHORT_ESCAPED = 4, 12


def symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Words (spans of bytes) as symbols with the closing one, as a binary column."""
    size = end - start
    base = np.cumsum(size) - size
    raw = data[np.repeat(start - base, size) + np.arange(size.sum())]
    out = _SYMBOL[raw]
    width = np.where(out == ESCAPE, 3, 1)
    at = np.concatenate([[0], np.cumsum(width)])
    # a closing symbol goes after each word
    first = at[np.append(base, len(raw))] + np.arange(len(size) + 1)
    place = at[:-1] + np.repeat(np.arange(len(size)), size)
    flat = np.full(at[-1] + len(size), CLOSE, np.uint8)
    flat[place] = out
    long = np.flatnonzero(width == 3)
    flat[place[long] + 1], flat[place[long] + 2] = raw[long] >> 4, raw[long] & 15
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(flat)])


def first_weights() -> np.ndarray:
    """Where mixers start: the more a beginning was seen, the more it says."""
    seen = np.repeat(np.arange(LEVELS) / (np.arange(LEVELS) + 1.0), 8)[:, None]
    rest = 1 - seen
    return np.hstack([rest * 0.1, rest * 0.25, rest * 0.35, rest * 0.3, seen * 0.4, seen * 0.6, np.zeros_like(seen)]).astype(np.float32)


def _bucket(w: X.Words, n_texts: int) -> np.ndarray:
    """A bucket for each text, by the three commonest of its repeated words (the smallest hashes on a tie), or one word where none repeats."""
    key = np.zeros(n_texts, np.uint64)
    if len(w.hash):
        # text and 40 bits of the word in one number
        both = np.sort((w.text.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        k = np.diff(np.append(at, len(both)))
        both = both[at]
        often = np.flatnonzero((k > 1) | np.concatenate([[True], (both[1:] ^ both[:-1]) >> np.uint64(40) > 0]))
        t, h, k = (both[often] >> np.uint64(40)).astype(np.int64), both[often], k[often]
        best = np.lexsort((h, -k, t))
        t, h = t[best], h[best]
        rank = np.arange(len(t)) - np.searchsorted(t, t)
        np.add.at(key, t[rank < 3], X.mix(h[rank < 3] << np.uint64(24)))
    return (key >> np.uint64(20)).astype(np.int64) % BUCKETS


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) % HISTOGRAM


def _topic(w: X.Words, n_texts: int, centres: np.ndarray) -> np.ndarray:
    """The topic of each text whose histogram (log probabilities) tells its words best."""
    log = centres[:, _slot(w.hash)]
    total = np.zeros((len(centres), len(w.hash) + 1))
    np.cumsum(log, axis=1, out=total[:, 1:])
    return (total[:, w.word_offsets[1:]] - total[:, w.word_offsets[:-1]]).argmax(axis=0)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word histograms of the buckets of a task's texts."""
    total = np.zeros(BUCKETS * HISTOGRAM, np.int64)
    for batch in batches:
        for c in X.chunks(batch.column("text")):
            w = X.words(c)
            total += np.bincount(_bucket(w, c.n)[w.text] * HISTOGRAM + _slot(w.hash), minlength=len(total))
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])


def _logs(histograms: np.ndarray) -> np.ndarray:
    rows = histograms + 0.5
    return np.log(rows / rows.sum(axis=1, keepdims=True))


def clustered(histograms: np.ndarray, topics: int = TOPICS) -> np.ndarray:
    """Log probabilities of topics by slot: k-means of multinomials, the farthest heavy buckets as first centres."""
    x = histograms[histograms.sum(axis=1) > 0].astype(float)
    rows = np.zeros((topics, histograms.shape[1]))
    if len(x):
        p = np.sqrt(x / x.sum(axis=1, keepdims=True))
        weight = x.sum(axis=1)
        centres = [int(weight.argmax())]
        while len(centres) < min(topics, len(x)):
            far = np.min([1 - p @ p[c] for c in centres], axis=0)
            centres.append(int((far * weight).argmax()))
        rows[: len(centres)] = x[centres]
        for _ in range(20):
            label = (x @ _logs(rows).T).argmax(axis=1)
            rows = np.stack([x[label == k].sum(axis=0) for k in range(topics)])
    return _logs(rows)


def _topics(texts: DataFrame) -> np.ndarray:
    """Log probabilities by topic and slot, of the column `text`; tables of fixed size."""
    tally = np.zeros(BUCKETS * HISTOGRAM, np.int64)
    got = texts.mapInArrow(_histograms, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    tally[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return clustered(tally.reshape(BUCKETS, HISTOGRAM))


def _dictionary(centres: np.ndarray):
    """(block, hash, word as symbols, topic, count in texts to learn from) of each batch's distinct words; lead: a word's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            found: dict[int, list[tuple]] = {}
            for c in X.chunks(batch.column("text")):
                w = X.words(c)
                data = X.LOWER[c.data]
                here, topic = learn[c.first : c.first + c.n], _topic(w, c.n, centres)
                # each text's end is a word of no symbols
                none = np.zeros(c.n, np.int64)
                hashes, texts = np.append(w.hash, np.full(c.n, END)), np.append(w.text, np.arange(c.n))
                starts, stops = np.append(w.start, none), np.append(w.end, none)
                own = block[c.first : c.first + c.n][texts]
                for b in np.unique(own):
                    rows = np.flatnonzero(own == b)
                    h, first, inverse = np.unique(hashes[rows], return_index=True, return_inverse=True)
                    weighted = here[texts[rows]]
                    kind, n = np.unique(inverse[weighted] * TOPICS + topic[texts[rows][weighted]], return_counts=True)
                    start, end = starts[rows[first]], stops[rows[first]]
                    found.setdefault(int(b), []).append((h, symbols(data, start, end), h[kind // TOPICS], kind % TOPICS, n))
            for b, parts in found.items():
                h, first = np.unique(np.concatenate([x[0] for x in parts]), return_index=True)
                key = np.searchsorted(h, np.concatenate([x[2] for x in parts])) * TOPICS + np.concatenate([x[3] for x in parts])
                key, inverse = np.unique(key, return_inverse=True)
                n = np.bincount(inverse, np.concatenate([x[4] for x in parts])).astype(np.int64) if len(key) else np.zeros(0, np.int64)
                alone = np.setdiff1d(np.arange(len(h)), key // TOPICS)  # words of held-out texts only
                row, topic, n = np.append(key // TOPICS, alone), np.append(key % TOPICS, np.zeros(len(alone), np.int64)), np.append(n, np.zeros(len(alone), np.int64))
                words, lead = pa.concat_arrays([x[1] for x in parts]).take(pa.array(first[row])), np.zeros(len(row), bool)
                lead[np.unique(row, return_index=True)[1]] = True
                for i in range(0, len(row), 65536):
                    cut = slice(i, i + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row[cut]), b)), pa.array(X.signed(h[row[cut]])), words[cut], pa.array(topic[cut].astype(np.int8)), pa.array(n[cut].astype(np.int32)), pa.array(lead[cut])], ["block", "hash", "word", "topic", "n", "lead"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by head and word made pieces of whole heads: (hashes, words one after another, counts by word and topic)."""
    rest: list[pa.RecordBatch] = []
    held, enough = 0, PIECE

    def piece(t: pa.Table) -> pa.RecordBatch:
        h = t.column("hash").to_numpy()
        new = np.concatenate([[True], h[1:] != h[:-1]])
        word = np.cumsum(new) - 1
        counts = np.bincount(word * TOPICS + t.column("topic").to_numpy(), t.column("n").to_numpy(), (word[-1] + 1) * TOPICS).astype(np.int64)
        blob = b"".join(t.column("word").take(pa.array(np.flatnonzero(new))).to_pylist())
        by_word = counts.reshape(-1, TOPICS).sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array([h[new]]), pa.array([blob], pa.binary()), pa.array([counts]), pa.array([by_word.sum()]), pa.array([np.count_nonzero(by_word)])], ["hashes", "words", "counts", "n", "known"])

    for batch in batches:
        rest.append(batch)
        held += len(batch)
        if held < enough:
            continue
        t = pa.Table.from_batches(rest).combine_chunks()
        head = t.column("head").to_numpy()
        edge, done = np.flatnonzero(head[1:] != head[:-1]) + 1, 0
        for at, cut in zip(edge, np.append(edge, len(head))[1:], strict=True):
            if at - done > 0 and cut - done > PIECE or cut == len(head):
                yield piece(t[done:at])
                done = at
        t = t[done:]
        rest, held = t.to_batches(), len(t)
        enough = max(PIECE, 2 * held)
    if held:
        yield piece(pa.Table.from_batches(rest).combine_chunks())


_PIECES = "hashes array<long>, words binary, counts array<long>, n long, known long"


class Trie:
    """The binary decisions of some words (symbol strings one after another, ascending), one node for each distinct beginning.

    Each node has zeros and ones by distinct words and by topic after its
    beginning among these words: columns of `counts`, zeros first. A word's
    decisions are nodes `node` with the bits `bit`, from `start` on.
    """

    def __init__(self, words: bytes, counts: np.ndarray):
        flat = np.frombuffer(words, np.uint8)
        stop = np.flatnonzero(flat == CLOSE) + 1
        size = np.diff(stop, prepend=0)
        begin = stop - size
        n = len(stop)
        counts = counts.reshape(n, TOPICS)
        self.total, self.start = counts.sum(axis=1), begin * BITS
        word = np.repeat(np.arange(n), size)
        place = np.arange(len(flat)) - begin[word]
        self.bit = _BITS.take(flat, axis=0).ravel()
        # bits each word shares with the word before
        other = np.where((word > 0) & (place < size[word - 1]), flat[np.minimum(np.where(word > 0, begin[word - 1] + place, 0), len(flat) - 1)], 255)
        differs = np.where(flat != other, place * BITS + _LEAD[flat ^ other], 1 << 40)
        shared = np.where(np.arange(n) > 0, np.minimum.reduceat(differs, begin), -1)
        deepest = np.maximum(shared, np.append(shared[1:], -1))
        beyond = np.minimum(shared[word] - place * BITS, BITS).astype(np.int32)
        new = np.flatnonzero(np.arange(BITS, dtype=np.int32) > beyond[:, None])
        self.node = np.empty(len(flat) * BITS, np.int32)
        self.node[new] = np.arange(len(new))
        # words first to last share the beginning, those from middle on go on with a one
        first = word[new // BITS]
        middle, last = first + ~self.bit[new], first + 1
        act = np.arange(n)
        for q in range(int(deepest.max(initial=-1)) + 1):
            act = act[deepest[act] >= q]
            at = self.start[act] + q
            group = np.flatnonzero(shared[act] < q)
            length = np.diff(np.append(group, len(act)))
            own = self.node[at[group]]
            middle[own] = act[group] + np.add.reduceat(~self.bit[at], group, dtype=np.int64)
            last[own] = act[group] + length
            self.node[at] = np.repeat(own, length)
        weights = np.column_stack([self.total > 0, counts])
        total = np.vstack([np.zeros((1, weights.shape[1]), np.int64), np.cumsum(weights, axis=0, dtype=np.int64)])
        part, width = total.take(middle, axis=0), 1 + TOPICS
        self.counts = np.empty((len(new), 2 * width), np.float32)
        self.counts[:, :width] = part - total.take(first, axis=0)
        self.counts[:, width:] = total.take(last, axis=0) - part

        symbol, level = np.divmod(new, BITS)
        within = _NODE[(1 << level) | (flat[symbol].astype(np.int64) >> (BITS - level))]
        context, self.hashes = np.zeros(len(flat), np.uint64), []
        for k in range(1, max(ORDERS) + 1):
            before = np.where(place >= k, np.concatenate([np.zeros(k, np.uint8), flat])[: len(flat)] + 1, 0).astype(np.uint64)
            context = context | before << np.uint64(6 * (k - 1))
            if k in ORDERS:
                self.hashes.append(X.mix(context | np.uint64(k << 40))[symbol] ^ within)
        # where a byte without symbol is among the first, longer beginnings are in the table too
        escape = np.minimum.reduceat(np.where(flat == ESCAPE, place, 1 << 40), begin)
        self.short = (place < np.where(escape < SHORT, SHORT_ESCAPED, SHORT)[word])[symbol]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat + np.uint64(1)) * X.powers(len(flat)))])
        whole = X.mix((sums[:-1] - sums[begin][word]) * X.powers(len(flat) + 1, True)[begin][word] + place.astype(np.uint64))
        self.hashes.append(whole[symbol[self.short]] ^ within[self.short])

    def slots(self, table: int, slots: int) -> np.ndarray:
        """Slots of the nodes in a table of contexts, or of the short nodes in the last one."""
        return (self.hashes[table] & np.uint64(slots - 1)).astype(np.int64)

    def add_to(self, tables: np.ndarray) -> None:
        """Count contexts by distinct words, short beginnings also by topic."""
        slots, width = len(tables) // KINDS, 1 + TOPICS
        kinds = [self.counts[:, b * width].copy() for b in (0, 1)]
        some = [np.flatnonzero(n) for n in kinds]
        for table in range(len(ORDERS)):
            where = self.slots(table, slots)
            for b in (0, 1):
                np.add.at(tables, (2 * table * slots + b) + 2 * where[some[b]], kinds[b][some[b]])
        at, n = self.slots(len(ORDERS), slots), self.counts[self.short]
        row, column = np.nonzero(n)
        np.add.at(tables, 2 * len(ORDERS) * slots + at[row] * (2 * width) + column, n[row, column])


#: Counts of each slot in the tables, which lie one after another: a zero and a one for each context; for short beginnings zeros by distinct words and by topic, then ones.
KINDS = 2 * len(ORDERS) + 2 * (1 + TOPICS)


def _counted(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros(KINDS * slots, np.float32)
        for trie, _ in _tries(batches):
            trie.add_to(tables)
        at = np.flatnonzero(tables)
        for i in range(0, len(at), 1 << 18):
            some = at[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(tables[some])], ["at", "n"])

    return run


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Trie, np.ndarray]]:
    for batch in batches:
        for hashes, words, counts in zip(batch.column("hashes"), batch.column("words"), batch.column("counts"), strict=True):
            yield Trie(words.as_py(), counts.values.to_numpy()), hashes.values.to_numpy()


def _odds(n0: np.ndarray, n1: np.ndarray, small: float) -> np.ndarray:
    return np.log((n1 + np.float32(small)) / (n0 + np.float32(small)))


def _level(n: np.ndarray) -> np.ndarray:
    """log2(n + 1), rounded down."""
    return ((n + np.float32(1)).view(np.int32) >> 23) - 127


class Predictors:
    """Log odds of each predictor at a trie's nodes, and the gates."""

    def __init__(self, trie: Trie, tables: np.ndarray):
        slots = len(tables) // KINDS
        self.contexts = [tables[2 * i * slots : 2 * (i + 1) * slots].reshape(slots, 2).take(trie.slots(i, slots), axis=0).T.copy() for i in range(len(ORDERS))]
        begin = trie.counts.copy()
        begin[trie.short] = tables[2 * len(ORDERS) * slots :].reshape(slots, -1).take(trie.slots(len(ORDERS), slots), axis=0)
        self.begin = np.ascontiguousarray(begin.T).reshape(2, 1 + TOPICS, -1)
        self.total = self.begin[:, 1:].sum(axis=1)
        self.five = 2 * np.minimum(_level(self.contexts[-1][0] + self.contexts[-1][1]) >> 1, 3)

    def shared(self) -> list[np.ndarray]:
        """Log odds that don't depend on the topic."""
        return [*(_odds(*n, 0.1) for n in self.contexts), _odds(*self.begin[:, 0], 0.3), _odds(*self.total, 0.02)]

    def gate(self, n0: np.ndarray, n1: np.ndarray, five: np.ndarray) -> np.ndarray:
        return (8 * np.minimum(_level(n0 + n1), LEVELS - 1) + five + (np.minimum(n0, n1) == 0)).astype(np.intp)

    def unseen(self) -> tuple[np.ndarray, np.ndarray]:
        """(log odds, gates) of a topic that never saw the nodes' beginnings."""
        none = np.zeros(len(self.five), np.float32)
        return none, self.gate(none, none, self.five)

    def of_topic(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes whose beginnings the topic saw, log odds by these, gates)."""
        n0, n1 = self.begin[:, 1 + k]
        some = np.flatnonzero(n0 + n1)
        n0, n1 = n0[some], n1[some]
        return some, _odds(n0, n1, 0.02), self.gate(n0, n1, self.five[some])

    def left_out(self, node: np.ndarray, bit: np.ndarray, topic: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(log odds that the bit is right, gates) of decisions of the given nodes and topics as if one such occurrence were not counted."""
        size = self.begin.shape[2]
        right, wrong = bit * size + node, (1 - bit) * size + node
        many = self.total.ravel()[right]
        # a distinct word goes where its occurrence is the only one
        alone = (many == 1).astype(np.float32)
        kinds = self.begin[:, 0].ravel()
        own = [self.begin.ravel().take((b * (1 + TOPICS) + 1 + topic) * size + node) for b in (bit, 1 - bit)]
        own[0] = np.maximum(own[0] - 1, 0)
        x = [_odds(n.ravel()[wrong], np.maximum(n.ravel()[right] - alone, 0), 0.1) for n in self.contexts]
        x += [_odds(kinds[wrong], kinds[right] - alone, 0.3), _odds(self.total.ravel()[wrong], many - 1, 0.02), _odds(own[1], own[0], 0.02)]
        return x, self.gate(*own, self.five[node])


def mixed(x: list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mixer's log odds; the last of x is what stands for one, or is left out."""
    columns = np.ascontiguousarray(weights.T)
    out = columns[0][gate] * x[0]
    for i in range(1, len(x)):
        out += columns[i][gate] * x[i]
    if len(x) == INPUTS:
        out += columns[INPUTS][gate]
    return np.clip(out, -16, 16)


def train(trie: Trie, tables: np.ndarray, weights: np.ndarray, square: np.ndarray, seen: np.ndarray) -> None:
    """Refine weights online over the occurrences that pass a piece's nodes, mixed, some thousand decisions at a step."""
    predictors, n = Predictors(trie, tables), trie.counts.ravel()
    at = np.flatnonzero(n)
    # the first of a bit's columns counts distinct words
    at = at[at % (1 + TOPICS) > 0]
    node, bit, topic = at // (2 * (1 + TOPICS)), at // (1 + TOPICS) % 2, at % (1 + TOPICS) - 1
    total = n[at]
    # frequent ones come in several steps, so that each step is like the texts
    times = np.ceil(total / STEP_COUNT).astype(np.int64)
    turn = np.repeat(np.arange(len(total)), times)
    turn = turn[np.argsort(X.mix(np.arange(len(turn), dtype=np.uint64)))]
    weight = (total / times).astype(np.float32)
    for s in range(0, len(turn), STEP_ROWS):
        rows = turn[s : s + STEP_ROWS]
        b, w = bit[rows], weight[rows]
        x, gate = predictors.left_out(node[rows], b, topic[rows])
        x.append((2 * b - 1).astype(np.float32))
        error = (1 / (1 + np.exp(-mixed(x, gate, weights))) - 1) * w
        mass = np.bincount(gate, w, GATES)
        slope = np.stack([np.bincount(gate, error * y, GATES) for y in x], axis=1) / np.maximum(mass, 1)[:, None]
        square += slope**2
        weights -= (STEP * slope / np.sqrt(square)).astype(np.float32)
        seen += mass


def _trained(tables: Broadcast):
    """Weights by gate after one pass over a partition's words, online in small steps, with what each gate saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = first_weights()
        square, seen = np.full(weights.shape, 1e-3), np.zeros(GATES)
        for trie, _ in _tries(batches):
            train(trie, tables.value, weights, square, seen)
        gates = np.repeat(np.arange(GATES), INPUTS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(gates), pa.array(np.tile(np.arange(INPUTS + 1), GATES)), pa.array(weights.ravel().astype(np.float64) * seen[gates]), pa.array(seen[gates])], ["gate", "input", "total", "seen"])

    return run


def word_log10(trie: Trie, tables: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log10 probability of each word under each topic."""
    out = np.zeros((len(trie.start), TOPICS))
    predictors = Predictors(trie, tables)
    shared, at = predictors.shared(), trie.node * 2 + trie.bit

    def costs(odds: np.ndarray) -> np.ndarray:
        zero = np.log1p(np.exp(odds))
        return np.stack([zero, zero - odds], axis=1)

    own, gate = predictors.unseen()
    unseen = costs(mixed([*shared, own], gate, weights))
    for k in range(TOPICS):
        some, own, gate = predictors.of_topic(k)
        bits = unseen.copy()
        bits[some] = costs(mixed([*(x[some] for x in shared), own], gate, weights))
        out[:, k] = np.add.reduceat(bits.ravel().take(at), trie.start, dtype=np.float64) / -np.log(10)
    return out


def _word_scores(tables: Broadcast, weights: np.ndarray):
    """(hash, n, log10 probabilities by topic in thousandths, as 32-bit integers) of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trie, h in _tries(batches):
            raw = np.round(word_log10(trie, tables.value, weights) * 1000).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(trie.total), pa.array([x.tobytes() for x in raw], pa.binary())], ["hash", "n", "logp"])

    return run


def topic_mixture(logp: np.ndarray, text: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Weights of the topics before each token: the prior, times the topics' probabilities of the text's tokens so far."""
    nat = logp * np.log(10)
    total = np.vstack([np.zeros(nat.shape[1]), np.cumsum(nat, axis=0)])
    first = np.searchsorted(text, text)
    told = np.log(prior) + total[:-1] - total[first]
    told -= told.max(axis=1, keepdims=True)
    weight = np.exp(told)
    return weight / weight.sum(axis=1, keepdims=True)


#: The match mixer: window of tokens after which a text's weights are refined, rate, first weights of (odds without match, hit rate's odds, one) by order 1, 2, 3.
WINDOW, RATE = 16, 0.02
MATCH = np.array([[1.0, 0.05, 0.0], [0.6, 0.4, 0.0], [0.2, 0.9, 0.0]])


def matched(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the token that followed the longest context of up to three words when it was last in the text, or -1; that context's order)."""
    n = len(h)
    last, order = np.full(n, -1), np.zeros(n, np.int64)
    for k in range(1, min(len(MATCH) + 1, n)):
        context = np.zeros(n - k, np.uint64)
        for i in range(k):
            context = X.mix(context + h[i : n - k + i] * X._K[i])
        at = np.arange(k, n)
        inside = text[: n - k] == text[k:]
        a, c = at[inside], context[inside]
        # one key for text and context; equal ones stay in the order of the text
        key = X.mix(c ^ X.mix(text[a].astype(np.uint64)))
        sort = np.argsort(key, kind="stable")
        a, key = a[sort], key[sort]
        again = np.flatnonzero(key[1:] == key[:-1]) + 1
        last[a[again]], order[a[again]] = a[again - 1], k
    return last, order


def adapted(h: np.ndarray, text: np.ndarray, logp: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Token log10 probabilities, by topic mixture and match mixer; tokens of a text are next to each other."""
    weight = topic_mixture(logp, text, prior)
    p = 10.0**logp
    alone = np.maximum((weight * p).sum(axis=1), 1e-300)
    out = np.log10(alone)
    last, order = matched(h, text)
    where = np.flatnonzero(last >= 0)
    if not len(where):
        return out
    guess = np.clip((weight[where] * p[last[where]]).sum(axis=1), 1e-12, 1 - 1e-6)
    right = h[where] == h[last[where]]
    kind = order[where] - 1
    own = text[where]
    rate = np.empty(len(where))
    for k in range(len(MATCH)):
        mine = np.flatnonzero(kind == k)
        tries, hits = np.arange(len(mine)), np.concatenate([[0], np.cumsum(right[mine])])[:-1]
        first = np.searchsorted(own[mine], own[mine])
        rate[mine] = (hits - hits[first] + 0.4) / (tries - first + 2) if len(mine) else 0
    x = np.stack([np.log(guess / (1 - guess)), np.log(rate / (1 - rate)), np.ones(len(where))], axis=1)
    _, lane = np.unique(own, return_inverse=True)
    rank = np.arange(len(where)) - np.searchsorted(own, own)
    weights = np.tile(MATCH, (int(lane[-1]) + 1, 1, 1)).reshape(-1, 3)
    key = lane * len(MATCH) + kind
    sure = np.empty(len(where))
    window = rank // WINDOW
    by_window = np.argsort(window, kind="stable")
    edge = X.runs(window[by_window])
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        rows = by_window[s:e]
        y = 1 / (1 + np.exp(-np.clip((weights[key[rows]] * x[rows]).sum(axis=1), -14, 14)))
        sure[rows] = y
        error = (right[rows] - y)[:, None] * x[rows] * RATE
        slot, inverse = np.unique(key[rows], return_inverse=True)
        for i in range(3):
            weights[slot, i] += np.bincount(inverse, error[:, i])
    # what is not guessed right shares the rest in its own proportions
    missed = np.log10(1 - sure) + out[where] - np.log10(1 - guess)
    out[where] = np.where(right, np.log10(sure), missed)
    return out


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Rows that lie together share words; any other stable division that follows the row count would do."""
    try:
        place = F.xxhash64(F.col("_metadata.file_path"), F.expr(f"_metadata.row_index div {BLOCK_ROWS}"))
        docs.select(place)
    except AnalysisException:
        place = F.pmod(F.xxhash64(F.col(id_col), F.crc32(F.col(text_col).cast("binary"))), F.lit(docs.count() // BLOCK_ROWS + 8))
    return place


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row; see the module.

    Learns from the rows whose crc32(id as text) mod 10 is not 0. base_score
    is the add-0.1 unigram score; score the mixed model's log10 probability.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _blocks(docs, id_col, text_col).alias("block"), held.alias("held"))
    centres = _topics(rows.where("not held").select("text"))
    local = written(rows.select("text", "block", (~F.col("held")).alias("learn")).mapInArrow(_dictionary(centres), "block long, hash long, word binary, topic byte, n int, lead boolean"))
    head = F.when(F.instr(F.substring("word", 1, SHORT).cast("string"), chr(ESCAPE)) > 0, F.substring("word", 1, SHORT_ESCAPED)).otherwise(F.substring("word", 1, SHORT))
    sorted_ = local.select("hash", "word", "topic", "n").withColumn("head", F.xxhash64(head)).repartition("head").sortWithinPartitions("head", "word")
    pieces = written(sorted_.mapInArrow(_pieces, _PIECES))
    by_topic = F.array(*(F.aggregate(F.sequence(F.lit(k), F.size("counts") - 1, F.lit(TOPICS)), F.lit(0).cast("long"), lambda s, i: s + F.get("counts", i)) for k in range(TOPICS)))
    total = pieces.select("n", "known", F.size("hashes").alias("words"), by_topic.alias("k")).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("words").alias("words"), *(F.sum(F.col("k")[k]).alias(f"k{k}") for k in range(TOPICS))).first()
    n_train, kinds = total["n"] or 0, total["known"] or 0

    slots = 1 << max(min((total["words"] or 0) // 4, MOST_SLOTS), LEAST_SLOTS).bit_length() - 1
    counted = pieces.mapInArrow(_counted(slots), "at int, n float").groupBy("at").agg(F.sum("n").alias("n"))
    tables = spark.sparkContext.broadcast(dense(counted, KINDS * slots))
    weights = first_weights()
    for r in pieces.mapInArrow(_trained(tables), "gate long, input long, total double, seen double").groupBy("gate", "input").agg(F.try_divide(F.sum("total"), F.sum("seen")).alias("w")).collect():
        if r["w"] is not None and r["w"] == r["w"]:
            weights[r["gate"], r["input"]] = round(r["w"], 4)
    scores = pieces.mapInArrow(_word_scores(tables, weights), "hash long, n long, logp binary")
    lookup = local.where("lead").select("block", "hash").join(scores, "hash").select("block", "hash", "n", "logp")
    prior = np.array([(total[f"k{k}"] or 0) + 1.0 for k in range(TOPICS)])
    prior /= prior.sum()
    unit = n_train + 0.1 * (kinds + 1)

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        h = X.unsigned(found["hash"].to_numpy())
        logp = [np.frombuffer(x.buffers()[2] or b"", "<i4")[np.frombuffer(x.buffers()[1], np.int32)[x.offset] // 4 :][: len(x) * TOPICS] for x in found["logp"].chunks if len(x)]
        logp = np.concatenate([*logp, np.zeros(0, "<i4")]).reshape(-1, TOPICS) / np.float32(1000)
        h, sort = np.unique(h, return_index=True)
        n, logp = found["n"].to_numpy()[sort], logp[sort]
        base = np.log10((n + 0.1) / unit)
        parts = []
        for c in X.chunks(texts["text"], 1 << 19):
            w = X.words(c)
            token = np.insert(w.hash, w.word_offsets[1:], END)
            size = np.diff(w.word_offsets) + 1
            text = np.repeat(np.arange(c.n), size)
            at = np.searchsorted(h, token)
            value = np.bincount(text, adapted(token, text, logp[at], prior), c.n)
            parts.append((size, np.bincount(text, n[at] > 0, c.n).astype(np.int64), np.full(c.n, n_train), np.bincount(text, base[at], c.n), value, value / -np.log10(2) / np.maximum(np.diff(c.offsets), 1)))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 6
        return pa.table([texts["id"], texts["held"], *(pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 3, strict=True))], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    out = rows.select("id", "text", "held", "block").groupBy("block").cogroup(lookup.groupBy("block")).applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return out.withColumnRenamed("id", id_col)
