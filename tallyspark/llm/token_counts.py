"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The tokens' bytes give their spans in
the text; token spans are interval-joined with section spans (both sorted, so
by binary search), and a token over a boundary goes by one of these rules:

- `first`: to the section its first byte is in;
- `majority`: to the section with most of its bytes, the earlier one on a tie;
- `split`: to each section by its share of bytes, so counts may be fractions.

Sections are the text's lines with their line feed (`lines`), or runs of lines
up to and with an empty one (`paragraphs`). Counts of a document's sections sum
to its tokens under every rule.

A null or empty text is one empty section without tokens. Null ids and repeated
rows come back as they are. No documents give no rows; a very long text is encoded
as a whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X


def attribute(length: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens over a boundary) of each section, for token lengths and section ends in bytes."""
    tokens, crossing = np.zeros(len(end)), np.zeros(len(end), np.int64)
    stop = np.cumsum(length)
    first = np.searchsorted(end, stop - length, side="right")
    last = np.searchsorted(end, stop - 1, side="right")
    inside = (first == last) | (rule == "first")
    np.add.at(tokens, first[inside], 1)
    over = np.flatnonzero(first != last)
    np.add.at(crossing, first[over], 1)
    if rule != "first":
        for i in over:
            edges = np.clip([stop[i] - length[i], *end[first[i] : last[i]], stop[i]], stop[i] - length[i], stop[i])
            share = np.diff(edges)
            if rule == "split":
                tokens[first[i] : last[i] + 1] += share / length[i]
            else:
                tokens[first[i] + int(share.argmax())] += 1
    return tokens, crossing


def _counts(rank_file: str, pattern: str, rule: str, sections: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        for batch in batches:
            for c in X.chunks(batch.column("text")):
                raw, parts = c.data.tobytes(), []
                for t in range(c.n):
                    own = c.data[c.offsets[t] : c.offsets[t + 1]]
                    end = np.flatnonzero(own == 0x0A) + 1
                    if sections == "paragraphs":
                        empty = np.concatenate([[len(own) == 0], np.diff(end) == 1]) if len(end) else np.zeros(0, bool)
                        end = end[empty & np.concatenate([~empty[1:], [True]])] if len(end) else end
                    if not len(end) or end[-1] < len(own):
                        end = np.append(end, len(own))
                    ids = encoding.encode_ordinary(raw[c.offsets[t] : c.offsets[t + 1]].decode("utf-8"))
                    tokens, crossing = attribute(size[np.array(ids, np.int64)], end, rule)
                    chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])[np.concatenate([[0], end])]
                    parts.append((np.full(len(end), t + c.first), np.arange(len(end)), chars[:-1], chars[1:], tokens, crossing))
                row, section, start, stop, tokens, crossing = map(np.concatenate, zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(section), pa.array(start), pa.array(stop), pa.array(tokens), pa.array(crossing)], ["id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return run


def section_tokens(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "majority", sections: str = "lines") -> DataFrame:
    """(id, section, start_char, end_char, n_tokens, n_crossing) of every section; n_crossing counts tokens that begin in it and leave it."""
    if rule not in ("first", "majority", "split"):
        raise ValueError(f"no such rule: {rule}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_counts(rank_file, pattern, rule, sections), f"id {dict(rows.dtypes)['id']}, section long, start_char long, end_char long, n_tokens double, n_crossing long")
    return out.withColumnRenamed("id", id_col)
