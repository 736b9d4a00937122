"""The llm operators against brute force, and on nulls, empty and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm.chat import rendered
from tallyspark.llm import context_mixing as mixing
from tallyspark.llm.context_mixing import score_texts
from tallyspark.llm.decision_list import quality_rules
from tallyspark.llm.decontaminate import contaminated, smith_waterman
from tallyspark.llm.html_extract import blocks, extract_main_text
from tallyspark.llm.jaccard_join import jaccard_components
from tallyspark.llm.language_id import identify_documents, identify_pages
from tallyspark.llm.queries import queries
from tallyspark.llm.packing import packed, plan
from tallyspark.llm.suffix_dedup import intervals, removal_digest
from tallyspark.llm.token_counts import attribute, section_tokens

tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the of and tion stream house river green walk table light stone paper cloud north paint glass wheel".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(40, 200)) for _ in range(30)]
    passage = prose(rng, 60)
    texts = [*base, *base[:6], None, "", "   ", "one", "Two words", "ONE"]
    for x in base[:8]:
        words = x.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    texts += [prose(rng, 20) + "\n" + "ab" * 300, passage + "é" * 120 + passage]
    return [(i, x) for i, x in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns with the names the operators use inside
    return spark.createDataFrame([(i, x, "a", 1, 2.0) for i, x in rows], "doc_id long, text string, id string, n int, hash double").repartition(3)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("ngram,num", [(3, 90), (5, 80)])
def test_jaccard_components(docs, rows, ngram, num):
    sets = {}
    for i, x in rows:
        w = split_words(fold(x))
        sets[i] = {tuple(w[k : k + ngram]) for k in range(len(w) - ngram + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, ngram=ngram, num=num).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_suffix_removal(docs, rows):
    seen, want = set(), {}
    for i, x in rows:
        b = (x or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cut[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(y for y, c in zip(b, cut, strict=True) if not c)
        want[i] = (len(b), len(b) - len(kept), sum(1 for k in range(len(b)) if cut[k] and not (k and cut[k - 1])), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in removal_digest(docs).collect()} == want


def test_intervals_are_all_common_prefix_groups():
    text = "abracadabra" * 2
    sa = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0]
    for a, b in zip(sa, sa[1:], strict=False):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        lcp.append(n)
    for length, s, e in intervals(np.array(lcp), 1):
        assert min(lcp[s + 1 : e]) == length and len({text[i : i + length] for i in sa[s:e]}) == 1
        assert (s == 0 or lcp[s] < length) and (e == len(sa) or lcp[e] < length)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packed(docs, path, capacity=64).toPandas()
    want = {}
    for i, x in rows:
        ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            want[i, k // 64] = (k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.1 * got.length.sum() / 64 + 1


def test_plan_holds_the_histogram():
    counts = np.random.default_rng(3).integers(0, 50, 129)
    counts[0] = 0
    held = np.zeros(129, int)
    for lengths, repeats in plan(counts, 128):
        assert sum(lengths) <= 128
        for n in lengths:
            held[n] += repeats
    assert (held == counts).all()
    assert plan(np.zeros(129, int), 128) == []


def test_decontamination(spark, docs):
    rng = random.Random(9)
    item = prose(rng, 25) + " rareword"
    edited = item.split()
    edited[5], edited[15] = "other", "words"
    more = spark.createDataFrame([(1000, prose(rng, 50) + " " + item + " " + prose(rng, 20)), (1001, prose(rng, 10) + " " + " ".join(edited)), (1002, None), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(both, items).collect()}
    assert set(got) == {(1000, 1), (1001, 1)} and got[1000, 1] == 1 and got[1001, 1] < 1


def test_decontamination_does_not_depend_on_other_texts(spark):
    words = [f"w{i}" for i in range(15)]
    edited = [x if i not in (3, 6, 9, 12) else f"other{i}" for i, x in enumerate(words)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for n in (30, 3000):
        # the edited copy's one seed is in all texts but one, another seed of the item in one
        texts = [(i, f"start{i} {' '.join(words[:3])} end{i}") for i in range(n)]
        texts += [(n, "a b " + " ".join(words[7:10])), (n + 1, f"so {' '.join(edited)} there")]
        got = [tuple(r) for r in contaminated(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()]
        assert got == [(n + 1, 1, 0.6, 16)], n


def test_smith_waterman_matches_plain_recurrence():
    rng = np.random.default_rng(0)
    a, b = [rng.integers(5, 9, n) for n in (6, 3, 12)], [rng.integers(5, 9, n) for n in (20, 4, 9)]
    scores, _ = smith_waterman(a, b)
    for x, y, score in zip(a, b, scores, strict=True):
        h = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert score == h.max()


def test_scores(docs, rows):
    got = {r["doc_id"]: r for r in score_texts(docs).collect()}
    from collections import Counter

    tokens = {i: [*split_words(fold(x)), None] for i, x in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(t for i, x in tokens.items() if not held[i] for t in x)
    n, v = sum(c.values()), len(c)
    for i, x in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(x), sum(c[t] > 0 for t in x), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x))
        assert r["score"] < 0
    assert sum(got[i]["score"] for i in held if held[i]) > 1.1 * sum(got[i]["base_score"] for i in held if held[i])


def test_scores_of_long_words_sum_to_at_most_one(spark):
    # 70 and 72 equal symbols (a digit is three), then different ends
    words = [x + end for x, ends in (("a" * 70, "bcdefghi"), ("1" * 24, "23456789")) for end in ends]
    docs = [(i, words[i % 16]) for i in range(320)]
    scores = {docs[r["doc_id"]][1]: r["score"] for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(scores) == 16 and sum(10**x for x in scores.values()) <= 1


def symbol_words(rng, n):
    out = {bytes(rng.choices([1, 2], k=3)) * 8 + bytes(rng.choices([1, 2], k=rng.randint(0, 6))) for _ in range(n)}
    out |= {bytes(rng.choices([1, 2, 31, 3], k=rng.randint(1, 14))) for _ in range(n)}
    return sorted(x + bytes([mixing.CLOSE]) for x in {*out, b""})


def begun(words, counts, i, place, level):
    """Zeros and ones after a beginning, by distinct words and by topic, counted plainly."""
    bits = lambda w: [w[place] >> (4 - k) & 1 for k in range(5)]
    out = np.zeros((2, 1 + mixing.TOPICS))
    for w, c in zip(words, counts, strict=True):
        if len(w) > place and w[:place] == words[i][:place] and bits(w)[:level] == bits(words[i])[:level]:
            out[bits(w)[level]] += [c.sum() > 0, *c]
    return out


def test_beginnings_are_counted_exactly():
    rng = random.Random(3)
    words = symbol_words(rng, 40)
    counts = np.random.default_rng(1).integers(0, 3, (len(words), mixing.TOPICS))
    trie = mixing.Trie(b"".join(words), counts)
    nodes = set()
    for i, w in enumerate(words):
        for place in range(len(w)):
            for level in range(5):
                at = trie.start[i] + 5 * place + level
                assert (trie.counts[trie.node[at]].reshape(2, -1) == begun(words, counts, i, place, level)).all(), (w, place, level)
                assert trie.bit[at] == w[place] >> (4 - level) & 1
                nodes.add((w[:place], level, w[place] >> (5 - level)))
    assert len(nodes) == len(trie.counts)


def test_word_scores_match_a_plain_mixer():
    rng = random.Random(4)
    words = symbol_words(rng, 7)
    counts = np.random.default_rng(2).integers(0, 3, (len(words), mixing.TOPICS))
    trie = mixing.Trie(b"".join(words), counts)
    tables = np.zeros(mixing.KINDS << 22, np.float32)
    trie.add_to(tables)
    weights = np.random.default_rng(5).random((mixing.GATES, mixing.INPUTS + 1)).astype(np.float32) / 4
    got = mixing.word_log10(trie, tables, weights)

    def context(w, place, k):
        return (min(place, k), w[max(place - k, 0) : place])

    def odds(n, small):
        return np.log((n[1] + small) / (n[0] + small))

    for i, w in enumerate(words):
        for topic in range(mixing.TOPICS):
            total = 0.0
            for place in range(len(w)):
                for level in range(5):
                    x, five = [], None
                    for k in mixing.ORDERS:
                        n = np.zeros(2)
                        for v, c in zip(words, counts, strict=True):
                            for p in range(len(v)):
                                if c.sum() and context(v, p, k) == context(w, place, k) and v[p] >> (5 - level) == w[place] >> (5 - level):
                                    n[v[p] >> (4 - level) & 1] += 1
                        x.append(odds(n, 0.1))
                        five = n.sum()
                    n = begun(words, counts, i, place, level)
                    own = n[:, 1 + topic]
                    x += [odds(n[:, 0], 0.3), odds(n[:, 1:].sum(axis=1), 0.02), odds(own, 0.02), 1.0]
                    gate = 8 * min(int(np.log2(own.sum() + 1)), mixing.LEVELS - 1) + 2 * int(min(np.log2(five + 1) / 2, 3)) + (own.min() == 0)
                    p = 1 / (1 + np.exp(-np.clip(np.dot(weights[gate], x), -16, 16)))
                    total += np.log10(p if w[place] >> (4 - level) & 1 else 1 - p)
            assert got[i, topic] == pytest.approx(total, rel=1e-3), w


def test_probabilities_of_what_comes_next_sum_to_one():
    # tokens 1, 2, 3 under two topics: whatever came before, the adapted probabilities of the next one sum to one
    logp = np.log10(np.array([[0.5, 0.2], [0.3, 0.1], [0.2, 0.7]]))
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 40):
        before = rng.integers(0, 3, n)
        total = 0.0
        for last in range(3):
            token = np.append(before, last)
            total += 10 ** mixing.adapted((token + 1).astype(np.uint64), np.zeros(n + 1, np.int64), logp[token], np.array([0.4, 0.6]))[-1]
        assert total == pytest.approx(1)


def test_symbols():
    data = np.frombuffer("ab9é .x".encode(), np.uint8)
    assert mixing.symbols(data, np.array([0, 6, 0]), np.array([5, 8, 0])).to_pylist() == [bytes([0, 1, 31, 3, 9, 30, 31, 10, 9, 26]), bytes([27, 23, 26]), bytes([26])]


def test_scores_beat_the_base_on_texts_of_two_topics(spark):
    rng = random.Random(7)
    parts = [["".join(rng.choices(letters, k=rng.randint(2, 4))) for _ in range(40)] for letters in ("aeiostrn", "ouklmpbd")]
    # as in languages, a few words are half of a text
    docs = [(i, " ".join(rng.choice(parts[i % 2][:4] if rng.random() < 0.5 else parts[i % 2]) + rng.choice(["", "", parts[i % 2][5]]) for _ in range(rng.randint(40, 120)))) for i in range(400)]
    got = score_texts(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").toPandas()
    assert got.score.sum() > 0.97 * got.base_score.sum() and (got.score > got.base_score).mean() > 0.8
    assert np.allclose(got.bits_per_byte, [-s * np.log2(10) / len(docs[i][1]) for i, s in zip(got.doc_id, got.score, strict=True)])


def test_scores_of_no_rows_and_of_unlearned_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(empty).count() == 0
    rows = score_texts(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows) == [(True, 1, 0, 0), (True, 3, 0, 0)]
    assert all(r["score"] < 0 for r in rows)


def test_quality_rules(spark):
    rng = random.Random(2)
    texts = [(i, prose(rng, 80) if i % 3 else " ".join(f"{w}###" for w in prose(rng, 80).split())) for i in range(240)]
    texts += [(900, None), (901, ""), (902, "short text"), (903, ("say it once more again " * 40).strip())]
    labels = [(i, 1 if i % 3 else 0) for i in range(200)] + [(5000, None)]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(got[i]["kept"] == bool(i % 3) for i in range(200, 240))
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (900, 901, 902, 903))
    assert (got[903]["n_words"], got[903]["n_repeat_words"]) == (200, 200)
    none = quality_rules(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.where("kept <> (not base_failed)").count() == 0


def test_language(spark):
    rng = random.Random(4)
    words = {"de": "der und nicht auch schule zwischen über", "en": "the and not also school between over", "es": "el y no también escuela entre sobre señor", "fr": "le et pas aussi école entre dessus être"}
    rows = [(i, " ".join(rng.choices(words[k].split(), k=30)), k, f"s{i % 3}") for i, k in enumerate(list(words) * 20)]
    rows += [(500, rows[0][1], "fr", None), (501, None, "en", "s1"), (502, "  ", None, "s1"), (503, "₪₫₭ ꙮꙮꙮ ⸎⸎ ₪₫₭ ꙮꙮꙮ ⸎⸎" * 20, None, "s1")]
    got = {r["doc_id"]: r for r in identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["lang"] == k and got[i]["kept"] for i, _, k, _ in rows[:80])
    assert got[500]["lang"] == "de"
    assert got[501]["lang"] is None and not got[501]["kept"] and not got[502]["kept"] and not got[503]["kept"]


LANGUAGES = ["de", "en", "es", "fr"]


def fused(rows, labelled, own=False):
    """(language, posterior) of each (text, declared, suffix, levels), by plain loops; own: the rows are the labelled texts."""
    from collections import Counter

    def slots(text):
        b = fold(text).encode()
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(b) - 2)]

    counts = {x: Counter(s for text, lang in labelled if lang == x for s in slots(text)) for x in LANGUAGES}
    evidence, guess = [], []
    for i, (text, *_) in enumerate(rows):
        less = {x: Counter(slots(text)) if own and labelled[i][1] == x else Counter() for x in LANGUAGES}
        totals = {x: counts[x].total() - less[x].total() + 0.05 * 65536 for x in LANGUAGES}
        sums = np.zeros(5)
        for s in slots(text):
            p = [(counts[x][s] - less[x][s] + 0.05) / totals[x] for x in LANGUAGES]
            sums += np.log([*p, sum(p) / 8 + 0.5 / 65536])
        evidence.append(0.3 * sums)
        guess.append(int(np.argmax(sums[:4])) if (text or "").strip() else None)
    overall = [guess.count(k) for k in range(4)]
    out = []
    for i, (text, declared, suffix, levels) in enumerate(rows):
        if guess[i] is None:
            out.append((None, None))
            continue
        base = prior = np.array([(n + 1) / (sum(overall) + 4) for n in overall])
        for level, value in enumerate(levels):
            n = np.array([sum(guess[j] == k for j, r in enumerate(rows) if j != i and value is not None and r[3][level] == value) for k in range(4)])
            prior = (n + 20 * prior) / (n.sum() + 20)
        logs = np.append(np.log(prior), np.log(1e-3))
        if suffix != "unused":
            n = np.array([sum(guess[j] == k for j, r in enumerate(rows) if suffix is not None and r[2] == suffix) for k in range(4)])
            logs[:4] += np.log((n + 20 * base) / (np.array(overall) + 20) / base)
        if declared in LANGUAGES:
            logs += np.log([*(0.95 if x == declared else 0.05 / 3 for x in LANGUAGES), 0.25])
        logs += evidence[i]
        p = np.exp(logs - logs.max())
        out.append(([*LANGUAGES, "und"][int(np.argmax(p))], p.max() / p.sum()))
    return out


def test_language_of_whole_pages(spark, tmp_path):
    rng = random.Random(14)
    words = {"de": "der und nicht auch schule zwischen über", "en": "the and not also school between over", "es": "el y no también escuela entre sobre señor", "fr": "le et pas aussi école entre dessus être"}
    documents = [(i, " ".join(rng.choices(words[k].split(), k=20)), k) for i, k in enumerate(LANGUAGES * 5)]
    cases = [(rng.choice(LANGUAGES), rng.randint(1, 12), rng.choice([None, "xx", *LANGUAGES]), rng.choice(["blog.big.de", "blog.big.de", "www.big.de", "one.es", "two.fr", "a.b.com", f"h{i}.rare{i % 9}", None])) for i in range(150)]
    # declared wrongly: the text outweighs it, and where the text says nothing a hot host and its suffix do
    cases += [("de", 30, "fr", "two.fr")] + [("de", 12, None, "blog.big.de")] * 80 + [("none", 1, None, "blog.big.de"), ("none", 1, None, None)]
    pages, rows = [], []
    for i, (k, n, declared, host) in enumerate(cases):
        text = " ".join(rng.choices(words[k].split(), k=n)) if k in words else "7"
        pages.append((i, f"https://{host}/p/{i}" if host else None, f"<html{f' lang="{declared}-X"' if declared else ''}><script>the and not</script><p class=x>{text}</p></html>"))
        label = host.split(".") if host else None
        rows.append((text, declared, label[-1] if host else None, (".".join(label[-2:]), host) if host else (None, None)))
    pages.append((900, "https://one.es/", None))
    rows.append(("", None, "es", ("one.es", "one.es")))
    spark.createDataFrame(documents, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["lang"], r["posterior"]) for r in queries()["op2_language_id"](spark, str(tmp_path)).collect()}
    want = fused(rows, [x[1:] for x in documents])
    assert len(got) == len(pages)
    for (i, *_), (lang, posterior) in zip(pages, want, strict=True):
        assert got[i] == (lang, posterior and pytest.approx(posterior, rel=1e-3)), (i, rows[i] if i < 900 else None)
    assert got[150][0] == "de" and got[231][0] == "de" and got[231][1] > got[232][1]


def test_language_of_a_page_is_its_articles(spark):
    """Tags by the dozen, references and menus in another language don't tell; a page of a menu only is asked as a whole."""
    english, german = "the school between and over also not the and school", "und zwischen der schule auch nicht über der und schule"
    documents = spark.createDataFrame([(i, x * 3, k) for i, (x, k) in enumerate([(english, "en"), (german, "de"), ("el y no también escuela entre sobre señor", "es"), ("le et pas aussi école entre dessus être", "fr")] * 4)], "doc_id long, text string, lang string")
    menu = "".join(f"<nav><ul><li><a href=x>{w}</a></li></ul></nav>\n      " for w in english.split() * 3)
    spread = "".join(f"<div>\n   <p>{w}&nbsp;&amp;</p>\n\n      </div>" for w in german.split())
    pages = [(1, None, f"<html>{menu}<article>{spread}</article><footer>{english}</footer></html>"), (2, None, f"<html>{menu}</html>"), (3, None, f"<html><p>{german.replace('ü', '&uuml;')}</p></html>"), (4, None, "<p></p>"), (5, None, "<p>" + "ꙮꙮ₪₫ " * 400 + "</p>")]
    got = {r["page_id"]: (r["lang"], r["kept"]) for r in identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), documents).collect()}
    assert got == {1: ("de", True), 2: ("en", True), 3: ("de", True), 4: (None, False), 5: ("und", False)}


def test_language_without_a_rows_own_counts(spark):
    rng = random.Random(15)
    words = {"de": "der und nicht auch schule zwischen über", "en": "the and not also school between over", "es": "el y no también escuela entre sobre señor", "fr": "le et pas aussi école entre dessus être"}
    docs = [(i, " ".join(rng.choices(words[k].split(), k=rng.randint(2, 15))), k, f"s{i % 3}") for i, k in enumerate(LANGUAGES * 8)]
    docs += [(100, "żółw wąż mrówka ćma chrząszcz " * 4, "de", "s0"), (101, "", "en", "s1"), (102, docs[0][1], "fr", None), (103, docs[1][1], "xx", "s2")]
    got = {r["doc_id"]: (r["lang"], r["posterior"]) for r in identify_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    want = fused([(text, lang, "unused", (source,)) for _, text, lang, source in docs], [x[1:3] for x in docs], own=True)
    for (i, *_), (lang, posterior) in zip(docs, want, strict=True):
        assert got[i] == (lang, posterior and pytest.approx(posterior, rel=1e-3))
    kept_in = fused([(text, lang, "unused", (source,)) for _, text, lang, source in docs], [x[1:3] for x in docs])
    assert got[100][1] < 0.999 * kept_in[32][1]


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "more"), (4, 0, "user", "yes"), (4, 0, "user", "yes"), (5, None, None, None), (None, 0, "user", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r[1:]) for r in rendered(frame).collect()}
    assert set(got) == {2, 4, 5} and got[2][:2] == (3, 2) and got[4][0] == 1
    assert got[2][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[5][2] == "<|im_start|>unknown\n<|im_end|>\n"
    assert rendered(frame.limit(0)).count() == 0


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav><a>menu</a></nav><div class="site-ad">buy</div><article><h1>A &amp; B</h1><p>One <b>t</b>wo<p>three<div class="comments"><p>first!</p></div></article><div class="share7">tell</div><footer>f</footer></body></html>'
    assert [x[2] for x in blocks(page)] == ["A & B", "One two", "three"]
    rows = [(i, f"http://h.org/{i}", f"<body><div><p>Read our other stories</p></div><section><p>text number {i * 7919}</p></section></body>") for i in range(30)]
    rows += [(100, None, page), (101, "x", None), (102, "http://one.org/", "plain   text")]
    got = {r["page_id"]: r for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == f"text number {i * 7919}" for i in range(30))
    assert got[100]["text"] == "A & B One two three" and got[101]["text"] == "" and got[102]["text"] == "plain text"


def test_html_keeps_article_parts_with_telling_names():
    page = '<body><div class="social-links">tell</div><article><div class="article-header"><h1>Title</h1></div><p class="social-science">One</p><div class="ad">buy</div><div class="share7">tell</div></article></body>'
    assert [x[2] for x in blocks(page)] == ["Title", "One"]


def test_html_of_odd_pages(spark):
    long = "A sentence of the text that goes on for a while, so that nobody takes it for a label. " * 3
    inside = lambda *x: "".join(f"<p>{y}</p>" for y in x)
    cases = {
        f"<form><nav>menu</nav><article>{inside(long)}<form>send</form></article><div class=footer>f</div></form>": long,
        f"<form id=aspnet><div>{inside(long)}</div></form>": long,
        "<form><p>Name</p><p>Mail</p></form>": "",
        f"<article>{inside('Teaser')}</article><div>{inside(long, long)}</div>": f"Teaser {long} {long}",
        f"<div class=social-science>{inside('One')}</div><div class=post-header><h1>Title</h1></div><div class='social-links'>x</div><div class='site-header'>y</div>": "One Title",
        f"<article>{inside(long)}</article><article class=comment>{inside('first!')}</article><section class='comment-list'>c</section>": long,
        f"<main>{inside(long)}<div class='ad-slot'>buy</div><div class='related-posts'>more</div><ul class='comment-list'><li>c</li></ul><div class='article-header'>kept</div></main>": f"{long} kept",
    }
    rows = [(i, None, page) for i, page in enumerate(cases)]
    got = [r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == [" ".join(x.split()) for x in cases.values()]


def test_html_broadcast_and_salted_join_agree(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<body><div><p>Read our other stories</p></div><section><p>text number {i * 7919}</p></section></body>") for i in range(60)]
    rows += [(60, None, "<p>x</p>"), (61, "http://h0.org/61", None), (None, "http://h0.org/0", rows[0][2])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({x: F.lit("x") for x in ("host", "low", "salt", "node", "text", "id")})
    got = [sorted(map(tuple, extract_main_text(frame).collect()), key=str)]
    monkeypatch.setattr("tallyspark.llm.html_extract.BROADCAST_NODES", -1)
    got.append(sorted(map(tuple, extract_main_text(frame).collect()), key=str))
    assert got[0] == got[1] and len(got[0]) == 63
    assert sum("other stories" in x[2] for x in got[0]) == 0
    assert extract_main_text(frame.limit(0)).count() == 0


def test_html_copies_are_one_page(spark):
    rng = random.Random(8)

    def page(i, nonce):
        paragraphs = "".join(f"<p>{prose(rng, 12)} {i}</p>" for _ in range(5))
        return f"<body><script>{nonce}</script><div><p>Read our other stories</p></div><section><h1>title {i}</h1>{paragraphs}</section></body>"

    def texts(html):
        return " ".join(x[2] for x in blocks(html) if "section" in x[0])

    one, many = page(0, "n"), page(1, "n")
    rows = [(i, f"http://copied.org/{i}", one) for i in range(30)]
    # copies also differ in a script, which isn't among the blocks
    rows += [(i, f"http://mixed.org/{i}", many.replace(">n<", f">n{i % 7}<")) for i in range(100, 1100)]
    rows += [(i, f"http://mixed.org/{i}", page(i, "n")) for i in range(2000, 2020)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        assert got[i] == ("Read our other stories " if "copied" in url else "") + texts(html)


def test_token_sections(docs, rows):
    for rule in ("first", "majority", "split"):
        got = section_tokens(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, rule=rule).toPandas()
        assert (got.groupby("doc_id")["end_char"].max() == [len(x or "") for _, x in rows]).all()
        totals = got.groupby("doc_id")["n_tokens"].sum()
        assert np.allclose(totals, totals.round())
    tokens, crossing = attribute(np.array([2, 4, 3]), np.array([3, 9]), "split")
    assert tokens.tolist() == [1.25, 1.75] and crossing.tolist() == [1, 0]
    assert attribute(np.array([2, 4, 3]), np.array([3, 9]), "majority")[0].tolist() == [1, 2]


def test_no_rows_give_no_rows_and_clashing_names_do_not_matter(spark, docs):
    """Each operator over an empty table, and over one whose further columns are named like those used inside."""
    none = docs.where("false")
    items = spark.createDataFrame([(1, "the of and tion stream house")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    path, byte_path = queries_tokenizer("word_bpe_49k.json"), queries_tokenizer("byte_bpe_50k.tiktoken")
    named = none.withColumns({x: F.lit("x") for x in ("lang", "source", "label", "own", "declared", "suffix", "level0")})
    for got in (
        jaccard_components(none),
        removal_digest(none),
        packed(none, path),
        contaminated(none, items),
        contaminated(docs.select("doc_id", "text", "id", F.lit(1).alias("seed"), F.lit("y").alias("item")), items.where("false")),
        section_tokens(none, byte_path, tokenizers.PATTERN),
        identify_documents(named),
        identify_pages(spark.createDataFrame([], "page_id long, url string, html string, host string, declared string"), docs.withColumn("lang", F.lit("en"))),
        quality_rules(none, labels),
    ):
        assert got.count() == 0


def queries_tokenizer(name):
    return tokenizers.path(name)
