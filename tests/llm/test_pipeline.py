"""The pipeline as a whole against a plain version, and on odd input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm.language_id import identify_documents

tokenizers = pytest.importorskip("public_tokenizers")
WORDS = {"en": "the and of not also school between over house river green", "de": "der und nicht auch schule zwischen über haus fluss grün wald"}


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "s", "ed", "er", "ing"]) for _ in range(n))


def corpus(rng):
    texts = [prose(rng, rng.randint(60, 160), ("en", "de")[i % 2]) for i in range(24)]
    for x in texts[:4]:
        words = x.split()
        words[20] = "changed"
        texts += [x, " ".join(words)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(4)]
    item = prose(rng, 20) + " rare words here"
    texts += [f"{prose(rng, 30)} {item} {prose(rng, 30)}", " \n "]
    return [(i, x, "en" if i < len(texts) - 1 else None, f"s{i % 2}", len(x)) for i, x in enumerate(texts)], item


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plainly(rows, item, tokenizer):
    """(doc_id, text) left before packing, and the packed pieces, by loops over all pairs."""
    sets = {}
    for i, x in rows:
        w = x.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    seen, left = set(), []
    for i, x in rows:
        if label[i] != i:
            continue
        b = x.encode()
        cut = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cut[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(y for y, c in zip(b, cut, strict=True) if not c).decode("utf-8", "ignore")
        if kept.strip() and item not in kept:
            left.append((i, kept))
    pieces = set()
    for i, x in left:
        ids = [*tokenizer.encode(x, add_special_tokens=False).ids, 0]
        pieces |= {(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    return left, pieces


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, item = corpus(random.Random(21))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # languages have brute-force tests of their own; here a text without any goes
    known = {r["doc_id"] for r in identify_documents(docs).where("kept").collect()}
    assert known == {r[0] for r in rows if r[1].strip()}
    left, pieces = plainly([r[:2] for r in rows if r[0] in known], item, Tokenizer.from_file(tokenizers.path("word_bpe_49k.json")))
    assert len(left) < len(known)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {tuple(r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)} == pieces
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048


def test_stages_with_odd_rows_and_clashing_names(spark, tmp_path):
    rng = random.Random(22)
    rows, item = corpus(rng)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # no id, a repeated id with two texts, a repeated row, no text
    rows += [(None, prose(rng, 50), "en", None, 1), (None, rows[0][1], None, "s0", None), (500, prose(rng, 50), "en", "s1", 3), (500, prose(rng, 70), "en", "s1", 4), rows[5], (501, None, None, None, None), (502, "", "en", "s0", 0)]
    clashing = {x: F.lit("x") for x in ("n_removed", "kept_text", "kept", "component_id", "id", "n", "hash", "score", "rank", "count", "slot", "words", "label", "own")}
    docs = spark.createDataFrame(rows, SCHEMA).withColumns(clashing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert ids.count(None) == 2, name
        assert not {501, 502} & set(ids)
        assert ids.count(500) == (2 if name == "language_id" else 1)
    smallest = min(x[1] for x in rows if x[0] == 500)
    assert [r["text"] for r in docs.where("doc_id = 500").collect()] == [smallest]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
