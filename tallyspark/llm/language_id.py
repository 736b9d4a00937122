"""Language identification by Bayesian evidence fusion.

The posterior of a row's language multiplies four kinds of evidence:

- the text: byte trigrams under one multinomial per language, learned from
  labelled texts (tempered, as neighbouring trigrams overlap). `und` stands for
  no known language: trigrams spread as in all languages' mean, flattened.
  Where a row is itself one of those texts, its own counts are left out;
  Of a page the text is its blocks, decoded and with white space squeezed,
  without what its markup declares to be a menu, footer or the like; a page of
  nothing else is asked as a whole;
- the declared markup language: right with probability `declared_right`;
- the address suffix: P(suffix | language), counted over rows by the language
  their text alone suggests;
- the host: a prior smoothed along its levels, broad to narrow, each level's
  counts added to `strength` times the level above, the row itself left out.

Counts are grouped aggregations; a hot host is combined before the shuffle and
only its one row of counts is joined back. The model has 65,536 trigram slots a
language, whatever the corpus.

Null, empty and wordless texts have no language and are not kept. Null
declared, suffix or host values are no evidence. Repeated rows come back each. Of
equally probable languages the first by name is given. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .html_extract import blocks
from .spark_util import checkpointed

SLOTS = 1 << 16
LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"


def _trigrams(c: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(first byte's place, slot) of the byte trigrams inside each text."""
    d = X.LOWER[c.data].astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot = ((d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inside = np.ones(len(slot), bool)
    for back in (1, 2):
        at = c.offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(slot))]] = False
    place = np.flatnonzero(inside)
    return place, slot[place].astype(np.int64)


def _index(label: Column, languages: Sequence[str]) -> Column:
    """A label's place among the languages, -1 for others and null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, languages)), label).cast("int") - 1, F.lit(-1))


def trigram_counts(labelled: DataFrame, text_col: str, label_col: str, languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Counts by language and slot over all rows whose label is one of the languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), SLOTS), np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for c in X.chunks(batch.column("text")):
                place, slot = _trigrams(c)
                text = np.repeat(np.arange(c.n), np.diff(np.searchsorted(place, c.offsets)))
                counts += np.bincount(label[c.first : c.first + c.n][text] * SLOTS + slot, minlength=counts.size).reshape(counts.shape)
        lang, slot = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(slot), pa.array(counts[lang, slot])], ["lang", "slot", "k"])

    rows = labelled.select(F.col(text_col).alias("text"), _index(F.col(label_col), languages).alias("label")).where("label >= 0")
    out = np.zeros((len(languages), SLOTS), np.int64)
    got = rows.mapInArrow(run, "lang long, slot long, k long").groupBy("lang", "slot").agg(F.sum("k").alias("k")).toPandas()
    out[got["lang"].to_numpy(np.int64), got["slot"].to_numpy(np.int64)] = got["k"].to_numpy(np.int64)
    return out


def _probabilities(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * SLOTS)


def _log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """Log probabilities by language and slot, the last row for an unknown language."""
    p = _probabilities(counts)
    return np.log(np.vstack([p, 0.5 * p.mean(axis=0) + 0.5 / SLOTS])).astype(np.float32)


def _score(counts: np.ndarray, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, p, total_of = _log_likelihoods(counts), _probabilities(counts), counts.sum(axis=1)
        mean = p.mean(axis=0)
        for batch in batches:
            label = batch.column("own").to_numpy(zero_copy_only=False)
            for c in X.chunks(batch.column("text")):
                place, slot = _trigrams(c)
                at = np.searchsorted(place, c.offsets)
                sums = []
                for row in table:
                    total = np.zeros(len(slot) + 1)
                    np.cumsum(row[slot], out=total[1:], dtype=np.float64)
                    sums.append(total[at[1:]] - total[at[:-1]])
                evidence = np.stack(sums, axis=1)
                own, size = label[c.first : c.first + c.n], np.diff(at)
                if (learned := np.flatnonzero((own >= 0) & (size > 0))).size:
                    # the language that learned from the text is asked without the text's own counts
                    text = np.repeat(np.arange(c.n), size)
                    key, k = np.unique((text * SLOTS + slot)[(own >= 0)[text]], return_counts=True)
                    text, slot = np.divmod(key, SLOTS)
                    lang = own[text]
                    q = (counts[lang, slot] - k + 0.05) / (total_of[lang] - size[text] + 0.05 * SLOTS)
                    unknown = 0.5 * (mean[slot] + (q - p[lang, slot]) / len(counts)) + 0.5 / SLOTS
                    evidence[learned, own[learned]] = np.bincount(text, k * np.log(q), c.n)[learned]
                    evidence[learned, -1] = np.bincount(text, k * np.log(unknown), c.n)[learned]
                letters = np.concatenate([[0], np.cumsum(~X.SPACE[c.data])])
                solid = letters[c.offsets[1:]] - letters[c.offsets[:-1]]
                lists = X.list_column(evidence.ravel(), np.arange(c.n + 1) * len(table))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(c.first, c.n) for x in passed), lists, pa.array(solid > 0)], [*passed, "text_evidence", "has_words"])

    return run


def identify(
    rows: DataFrame,
    counts: np.ndarray,
    id_col: str,
    text: Column,
    declared: Column | None = None,
    suffix: Column | None = None,
    levels: Sequence[Column] = (),
    learned_as: Column | None = None,
    languages: Sequence[str] = LANGUAGES,
    declared_right: float = 0.95,
    temper: float = 0.3,
    strength: float = 20.0,
    least_posterior: float = 0.5,
) -> DataFrame:
    """(id, lang, posterior, declared_lang, kept) of every row; lang is null without words, `und` for none of the languages.

    levels are host columns from broad to narrow; learned_as is the label under which counts hold the row's own text;
    kept: a known language with least_posterior or more.
    """
    names = [*languages, UNKNOWN]
    n = len(languages)
    none = F.lit(None).cast("string")
    level_names = [f"level{i}" for i in range(len(levels))]
    source = rows.select(F.col(id_col).alias("id"), text.alias("text"), (none if declared is None else F.lower(F.trim(declared))).alias("declared"), (none if suffix is None else F.lower(suffix)).alias("suffix"), (F.lit(-1) if learned_as is None else _index(learned_as, languages)).alias("own"), *(x.alias(k) for x, k in zip(levels, level_names, strict=True)))
    passed = ["id", "declared", "suffix", *level_names]
    kinds = dict(source.dtypes)
    schema = ", ".join([*(f"{x} {kinds[x]}" for x in passed), "text_evidence array<double>, has_words boolean"])
    table = source.sparkSession.sparkContext.broadcast(counts)
    scored = source.mapInArrow(lambda it: _score(table.value, passed)(it), schema)
    scored = scored.withColumn("text_evidence", F.transform("text_evidence", lambda x: x * temper))
    known = F.slice("text_evidence", 1, n)
    scored = checkpointed(scored.withColumn("guess", F.when(F.col("has_words"), F.array_position(known, F.array_max(known)).cast("int") - 1)))

    def tallies(key: str) -> DataFrame:
        counted = scored.where(F.col(key).isNotNull() & F.col("guess").isNotNull()).groupBy(key)
        return counted.agg(*(F.count_if(F.col("guess") == i).cast("double").alias(f"{key}_{i}") for i in range(n)))

    own = [(F.col("guess") == i).cast("double") for i in range(n)]
    own = [F.coalesce(x, F.lit(0.0)) for x in own]
    overall = scored.agg(*(F.count_if(F.col("guess") == i).alias(str(i)) for i in range(n))).first()
    total = sum(overall) + n
    prior = [F.lit((overall[i] + 1) / total) for i in range(n)]
    out = scored
    for key in level_names:
        out = out.join(tallies(key), key, "left")
        have = [F.greatest(F.coalesce(F.col(f"{key}_{i}"), F.lit(0.0)) - F.when(F.col(key).isNotNull(), own[i]).otherwise(0.0), F.lit(0.0)) for i in range(n)]
        all_ = sum(have[1:], have[0])
        out = out.withColumns({f"{key}_p{i}": (have[i] + strength * prior[i]) / (all_ + strength) for i in range(n)})
        prior = [F.col(f"{key}_p{i}") for i in range(n)]
    logs = [F.log(p) for p in prior]
    if suffix is not None:
        out = out.join(tallies("suffix"), "suffix", "left")
        logs = [x + F.log((F.coalesce(F.col(f"suffix_{i}"), F.lit(0.0)) + strength * (overall[i] + 1) / total) / (overall[i] + strength)) - F.log(F.lit((overall[i] + 1) / total)) for i, x in enumerate(logs)]
    wrong = (1 - declared_right) / max(n - 1, 1)
    base = F.substring_index(F.substring_index("declared", "-", 1), "_", 1)
    logs = [x + F.when(base.isin(*languages), F.when(base == languages[i], np.log(declared_right)).otherwise(np.log(wrong))).otherwise(0.0) for i, x in enumerate(logs)]
    logs.append(F.lit(np.log(1e-3)) + F.when(base.isin(*languages), np.log(1 / n)).otherwise(0.0))
    fused = F.array(*(F.col("text_evidence")[i] + x for i, x in enumerate(logs)))
    out = out.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    mass = F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    best = F.array_position("fused", F.col("top"))
    lang = F.when(F.col("has_words"), F.element_at(F.array(*map(F.lit, names)), best.cast("int")))
    out = out.select(F.col("id").alias(id_col), lang.alias("lang"), F.when(F.col("has_words"), 1 / mass).alias("posterior"), F.col("declared").alias("declared_lang"))
    return out.withColumn("kept", F.coalesce((F.col("lang") != UNKNOWN) & (F.col("posterior") >= least_posterior), F.lit(False)))


def identify_documents(docs: DataFrame, labelled: DataFrame | None = None, **options) -> DataFrame:
    """documents rows: lang is the declared language, source the host; learned from `labelled` by its lang, or from the other rows of docs."""
    own = F.col("lang") if labelled is None or labelled is docs else None
    labelled = docs if labelled is None else labelled
    return identify(docs, trigram_counts(labelled, "text", "lang"), "doc_id", F.col("text"), declared=F.col("lang"), levels=[F.col("source")], learned_as=own, **options)


_HIDDEN = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)


def page_text(page: str | None) -> str:
    """A page's blocks, or where it has none the whole text between its tags."""
    text = " ".join(x for _, _, x in blocks(page or ""))
    return text or " ".join(unescape(_HIDDEN.sub(" ", page or "")).split())


def _page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([page_text(x) for x in batch.column("html").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("declared"), texts], ["id", "host", "declared", "text"])


def identify_pages(pages: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """pages rows: the html element's lang, the host's last label as suffix, the host under its last two labels."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    lang = F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    read = pages.select(F.col("page_id").alias("id"), F.when(host != "", host).alias("host"), F.when(lang != "", lang).alias("declared"), "html")
    kind = read.schema["id"].dataType.simpleString()
    texts = read.mapInArrow(_page_texts, f"id {kind}, host string, declared string, text string")
    host = F.col("host")
    found = identify(texts, trigram_counts(labelled, "text", "lang"), "id", F.col("text"), declared=F.col("declared"), suffix=F.substring_index(host, ".", -1), levels=[F.substring_index(host, ".", -2), host], **options)
    return found.withColumnRenamed("id", "page_id")
