"""Phrase mining, ranked search and tiered packing against brute force, and on nulls, ties, repeated rows and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import collocations as mining
from tallyspark.llm import lexical_search as lexical
from tallyspark.llm import queries, tiered_packing
from tallyspark.llm.spark_util import read_table

SF = "/root/testdata/sf0.001"
TOKEN_WORDS = "the of and tion stream house river green walk table light stone".split()


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            f.update((lang, *p[i : i + k]) for k in range(1, 5) for i in range(len(p) - k + 1))
    return f, n


def plain_collocations(rows, least, share, most):
    f, n = plain_counts(rows)
    f = {x: c for x, c in f.items() if c >= least}
    longer = defaultdict(int)
    for x, c in f.items():
        for k in range(2, len(x) - 1):
            for i in range(1, len(x) - k + 1):
                longer[(x[0], *x[i : i + k])] = max(longer[(x[0], *x[i : i + k])], c)
    out = defaultdict(list)
    for x, a in f.items():
        if len(x) > 2 and 100 * longer[x] < share * a:
            score, _, l, r = min((2_000_000 * a // (f[x[: k + 1]] + f[(x[0], *x[k + 1 :])]), k, f[x[: k + 1]], f[(x[0], *x[k + 1 :])]) for k in range(1, len(x) - 1))
            out[x[0]].append((-score, -a, " ".join(x[1:]).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)}


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(3)
    words = [*"ab cd ef gh ij".split(), "É", "naïve", "𝒳y", "_x_", "(q)"]
    rows = [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(words).upper() + rng.choice([" ", " ", "\t", "  ", ". ", "\n", "\r\n", "!", ", "]) for _ in range(rng.randint(0, 300)))) for _ in range(60)]
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " \n.!"), ("en", "ab " * 5000), ("en", "same text twice here"), ("en", "same text twice here")]
    return rows


def test_collocations(spark, phrase_rows):
    frame = spark.createDataFrame([(i, lang, text, 1, "x") for i, (lang, text) in enumerate(phrase_rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(3)
    got = mining.collocations(frame, least=4, most=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == plain_collocations(phrase_rows, 4, 80, 40)
    assert mining.collocations(frame.where("false")).count() == 0


def test_collocations_in_small_shards(phrase_rows, monkeypatch):
    """Cuts inside texts and pieces, windows, gaps between buckets: all runs are counted once."""
    monkeypatch.setattr(mining, "SHARD_WORDS", 97)
    monkeypatch.setattr(mining, "BLOCK", 1 << 18)
    want, words = plain_counts(phrase_rows)
    least, buckets = 3, 1 << 20
    shards = mining.Shards(0)
    rows = [row for lang, text in phrase_rows for row in shards.add("und" if lang is None else lang, pa.array([text], pa.string()))] + list(shards.rest())
    assert len({r["shard"] for r in rows}) == len(rows) > 40
    n = Counter()
    for r in rows:
        n[r["lang"]] += r["n"]
    assert n == words
    batch = pa.RecordBatch.from_pylist(rows, mining._SHARD_TYPES)
    counted = pa.Table.from_batches(mining._counted_buckets(buckets, least)([batch])).to_pandas()
    staying = pa.concat_tables([pa.Table.from_pandas(mining._staying(least)(f)) for _, f in counted.groupby("block")])
    counted = []
    for r in rows:
        mine = staying.filter(pa.compute.equal(staying["shard"], r["shard"])).select(["shard", "base", "places"])
        counted.append(mining._counted_phrases(buckets, 4)(pa.Table.from_pylist([r], mining._SHARD_TYPES), mine))
    counted = pa.concat_tables(counted)
    got = {}
    for key in {(x["lang"], x["block"]) for x in counted.select(["lang", "block"]).to_pylist()}:
        mine = counted.filter(pa.compute.and_(pa.compute.equal(counted["lang"], key[0]), pa.compute.equal(counted["block"], key[1])))
        got |= {(x["lang"], *x["phrase"].split(" ")): x["f"] for x in mining._summed(least)(mine).to_pylist()}
    frequent = {x: c for x, c in want.items() if c >= least}
    assert got == frequent
    visited = sum(int(np.frombuffer(x, "<u4").sum()) for x in counted["counts"].to_pylist())
    assert visited < 1.1 * sum(frequent.values()), "hardly any run that isn't frequent is counted"


def test_places_with_long_gaps():
    place = np.array([0, 3, 70000, 70001, 400000, 1 << 19])
    count = np.array([1, 2, 3, 30, 4, 5])
    assert [x.tolist() for x in mining.unpacked_places(*mining.packed_places(place, count))] == [place.tolist(), count.tolist()]


def plain_search(docs, items, k=10):
    terms = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(x))
    bags = [(i, Counter(terms(x))) for i, x in docs if terms(x)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    texts = {}
    for item, text in items:
        if text is not None and (item not in texts or texts[item] is None or text.encode() < texts[item].encode()):
            texts[item] = text
        texts.setdefault(item, None)
    out = set()
    for item, text in texts.items():
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            found.append((-score, i is None, i or 0))
        out |= {(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(x for x in found if x[0] < 0)[:k], 1)}
    return out


def test_search(spark):
    rng = random.Random(9)
    words = ["Alpha", "beta", "x1", "Ünder", "日本", "e", "of", "the", *(f"w{i}" for i in range(300))]
    text = lambda n: "".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))])[0] + rng.choice([" ", "-", "\x00", ". "]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 80))) for i in range(300)]
    docs += [(None, docs[5][1]), (1000, docs[5][1]), (1000, docs[5][1]), (1001, None), (1002, ""), (1003, " .-_"), (1004, text(5000))]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)] + [(50, docs[5][1]), (51, None), (52, ""), (None, "alpha beta"), (53, "nowhere"), (54, "zz beta"), (54, "alpha"), (54, "alpha")]
    frame = spark.createDataFrame([(*r, "z", 1) for r in docs], "doc_id long, text string, item string, score int").repartition(3)
    table = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in lexical.search(frame, table).collect()]
    assert len(got) == len(set(got)) + sum(1 for r in set(got) if got.count(r) > 1)
    assert set(got) == plain_search(docs, items)
    assert lexical.search(frame.where("false"), table).count() == 0 == lexical.search(frame, table.where("false")).count()


def test_search_stops_early_and_is_exact():
    """Many documents, few of them completed; every k-th best is what adding all postings gives."""
    rng = np.random.Generator(np.random.PCG64(2))
    n_docs, n_terms = 20_000, 12
    pairs = np.unique(rng.integers(0, n_docs * n_terms, 90_000))
    doc, term = pairs // n_terms, pairs % n_terms
    impact = (rng.pareto(1.2, len(pairs)) * 100).astype(np.int64) + 1
    p = lexical.postings(doc, term, impact, n_docs, n_terms)
    full = np.bincount(doc, impact, n_docs).astype(np.int64)
    docs, scores = lexical.best(p, np.arange(n_terms), 10, 0)
    assert len(docs) < 2_000 and (scores == full[docs]).all()
    assert sorted(-scores)[:10] == sorted(-full)[:10]
    docs, scores = lexical.best(p, np.arange(n_terms), 10, int(full.max()))
    assert full.argmax() in docs and len(docs) < 50 and (scores == full[docs]).all()


@pytest.mark.parametrize("name,oracle", [("op11_collocations", mining.ORACLE), ("op12_ranked_search", lexical.ORACLE)])
def test_sql(spark, name, oracle):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(oracle)
    columns = [x[0] for x in want.description]
    got = queries.queries()[name](spark, SF).select(columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall()) != []


def encoded(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    return [[*x.ids, end] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def held(rows, docs):
    """Each id of each document is in one piece, each sequence is gapless and a power of two of at most 2048."""
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"], r["step_group"]))
    assert set(spans) == set(docs)
    for doc, found in spans.items():
        at = 0
        for start, n, crc, total in sorted(found):
            assert start == at and total == len(docs[doc])
            assert crc == zlib.crc32(np.array(docs[doc][start : start + n], "<u4").tobytes())
            at += n
        assert at == len(docs[doc])
    for found in sequences.values():
        at = 0
        for offset, n, _, _ in sorted(found):
            assert offset == at
            at += n
        assert 0 < at <= 2048 and at & (at - 1) == 0 and {x[2] for x in found} == {at} and len({x[3] for x in found}) == 1
    return sequences


def test_tiered_packing(spark):
    rng = random.Random(11)
    sizes = [0, 1, 2, 5, 2046, 2047, 2048, 2049, 9000, *(rng.randint(1, 3000) for _ in range(150)), *([40] * 60)]
    texts = [None, "", " ", *(" ".join(rng.choice(TOKEN_WORDS) for _ in range(n)) for n in sizes)]
    frame = spark.createDataFrame([(i, x, 1, "a") for i, x in enumerate(texts)], "doc_id long, text string, tier int, id string").repartition(3)
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = tiered_packing.tiered(frame, path).collect()
    docs = dict(enumerate(encoded(texts, 1)))
    held(rows, docs)
    assert tiered_packing.tiered(frame.where("false"), path).count() == 0
    null = tiered_packing.tiered(spark.createDataFrame([(None, "the"), (None, "the")], "doc_id long, text string"), path).collect()
    assert sorted(r["length"] for r in null if r["doc_id"] is None) == [len(docs[1]) + 1] * 2 or sum(r["length"] for r in null) == 4


def test_tiered_packing_of_whole_documents(spark):
    documents = read_table(spark, SF, "documents")
    rows = queries.op13_tiered_packing(spark, SF).collect()
    texts = documents.select("doc_id", "text").collect()
    docs = dict(zip((r["doc_id"] for r in texts), encoded([r["text"] for r in texts], 1), strict=True))
    sequences = held(rows, docs)
    assert sum(len(x) for x in docs.values()) == sum(sum(p[1] for p in s) for s in sequences.values()), "no padding"


def test_packer_over_blocks_cuts_few_and_balances():
    rng = random.Random(4)
    packer, rows, docs = tiered_packing.Packer(3, tiered_packing.TIERS), [], {}
    for i in range(6000):
        docs[i] = np.array(rng.choices(range(1000), k=min(int(rng.lognormvariate(5.5, 1)) + 1, 9000)))
        packer.add(i, docs[i])
        if i in (1999, 3999):
            rows += packer.rows()
    rows += packer.rows(last=True)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    sequences = held(rows, {i: x.tolist() for i, x in docs.items()})
    pieces = Counter(r["doc_id"] for r in rows)
    short = [i for i, x in docs.items() if len(x) <= 2048]
    assert sum(pieces[i] > 1 for i in short) < 0.1 * len(short), "few documents that would fit whole are cut"
    assert {s[0][2] for s in sequences.values()} >= {2048, 1024, 512, 256}
    tokens, work = Counter(), Counter()
    for s in sequences.values():
        tokens[s[0][3]] += sum(p[1] for p in s)
        work[s[0][3]] += sum(p[1] ** 2 for p in s)
    # of each block the groups are even to a window of the largest tier
    assert max(tokens.values()) - min(tokens.values()) <= 4096 and max(work.values()) < 2 * min(work.values())


def test_words_cut_into_pieces_give_the_tokenizers_ids():
    from tallyspark.llm import textops
    from tallyspark.llm.packing import WordEncoder

    encoder = WordEncoder(queries.tokenizer_path("word_bpe_49k.json"), 1)
    assert encoder.cuts and len(encoder.ends)
    rng = random.Random(6)
    parts = ["a", "B", "'", "s", "<", "|", ">", "<|endoftext|>", "<|ENDOFTEXT|>", "1", ".", "!", "é", "É", "\u0301", "×", "÷", "日", "_", " ", "\n", "\u00a0", "'ll", "'S", "İ", "\u212a", "ß", "\u200b", "½", "\x00", "\x1c", "𝒳"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", "x" * 5000, "it's <|endoftext|>x"]
    got = []
    for c in textops.chunks(pa.array(texts, pa.string()), 4096):
        ids, at = encoder.encode(c)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(c.n)]
    assert got == encoded(texts, 1)


def test_powers_and_single_pieces():
    assert tiered_packing.powers([]) == []
    assert [sum(p[2] for p in w) for w in tiered_packing.powers([(0, 0, 1000), (1, 0, 337)])] == [1024, 256, 32, 16, 8, 1]
    assert tiered_packing.pack([(0, 0, 7)]) == ([], [(0, 0, 7)])
    windows, rest = tiered_packing.pack([(0, 0, 2000), (1, 0, 100)])
    assert windows == [[(0, 0, 2000), (1, 0, 48)]] and rest == [(1, 48, 52)]
