"""Token counts, phrase collocations and ranked search on small fixtures against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talus.llm import counts, phrases, search, tokens
from talus.llm.text import WordHashes
from talus.runtime import table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=counts.default_path())


def odd_texts():
    rng = random.Random(3)
    signs = list(" \n\t▁aéb.,<s>0é́　😀\r\x00") + ["the", "  ", "\n\n", "</s>", "<0x0A>", "ation"]
    return ["", " ", "  ", "\n", "a ", " a", "a\n", "▁", "x" * 50_000, "word " * 20_000, " \n" * 300] + ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]


@pytest.mark.parametrize("segment", [1 << 18, 7])
def test_token_counts_are_the_librarys(library, monkeypatch, segment):
    monkeypatch.setattr(counts, "SEGMENT", segment)
    texts = odd_texts()
    assert counts.PieceLengths(counts.default_path()).lengths(texts) == [len(x) for x in library.encode(texts)]


def test_token_counts_with_a_small_table(library, monkeypatch):
    monkeypatch.setattr(counts, "KNOWN", 50)
    monkeypatch.setattr(counts, "BATCH_BYTES", 2000)
    texts = odd_texts()[:11] + [" ".join(f"w{i}" for i in range(k)) for k in range(0, 400, 7)]
    assert counts.PieceLengths(counts.default_path()).lengths(texts) == [len(x) for x in library.encode(texts)]


def test_token_counts_of_rows(docs_of, library):
    rows = [(1, None), (2, ""), (3, "ä b"), (3, "ä b"), (None, "x\ny"), (5, "a b " * 3000)]
    got = counts.token_counts(docs_of(rows).withColumn("n_tokens", F.lit("x")), counts.default_path()).collect()
    want = collections.Counter((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in rows)
    assert collections.Counter(tuple(r) for r in got) == want
    assert counts.token_counts(docs_of([]), counts.default_path()).count() == 0


def test_token_counts_by_a_json_file(docs_of):
    path = tokens.default_path()
    texts = ["Some text, and more.", "", "<|endoftext|> x"]
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(docs_of(list(enumerate(texts))), path).collect()}
    assert got == {i: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_token_counts_on_table(spark, sf, library):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = counts.token_counts(table(spark, sf, "documents"), counts.default_path()).collect()
    assert len(got) == len(texts) and all(r.n_tokens == len(library.encode(texts[r.doc_id])) for r in got)


def phrases_by_hand(rows, least, top=2000, percent=80):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[lang or "und", tuple(w[i : i + size])] += 1
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in candidates.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def phrase_rows():
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma\x1f", "d\x0b", "épée", "x,", "new york", "in spite of the", "\t", "e.", "日本 語"]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for _ in range(150)]
    return rows + [("en", None), ("en", ""), (None, " \n,"), ("fr", "only few words"), ("en", "new york " * 500), ("de", "a b c d e " * 300)] + [("de", "tick tock")] * 40


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "f", i) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, row string, size long").repartition(3)


@pytest.mark.parametrize("chunk, mask", [(phrases.CHUNK, (1 << 64) - 1), (50, (1 << 64) - 1), (400, 0x3F)])
def test_phrases_are_those_of_plain_counting(spark, chunk, mask):
    rows = phrase_rows()
    got = {tuple(r) for r in phrases.collocations(frame_of(spark, rows), least=12, top=25, chunk_words=chunk, mask=mask).collect()}
    want = phrases_by_hand(rows, 12, 25)
    assert got == want and len(got) > 20 and {r[0] for r in got} >= {"en", "de", "und"}


def test_phrases_of_empty_tables(spark):
    assert phrases.collocations(frame_of(spark, [])).count() == 0
    assert phrases.collocations(frame_of(spark, [("en", None), (None, "a few words")])).count() == 0


def test_phrases_in_long_texts_by_segments(spark, monkeypatch):
    text = "one two, three four five\tsix " * 40
    want = [w for piece in re.split("[,]", text) for w in [*piece.split(), None]][:-1]
    for size in (1, 9, 50):
        monkeypatch.setattr(phrases, "SEGMENT", size)
        found = [None if w == phrases.END else w.decode() for part in phrases.words(text.encode()) for w in part]
        assert found == want
        held = {at + k: w for at, part, begin in phrases.sections(text.encode(), 7) for k, w in enumerate(part)}
        assert [held[i] for i in range(len(held))] == [phrases.END if w is None else w.encode() for w in want]


def test_bitmap_never_denies(spark):
    values = [(int(x),) for x in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)]
    made = phrases.bitmap(spark.createDataFrame(values, "fp long"))
    assert made.has(np.array([v[0] for v in values], np.int64).view(np.uint64)).all()
    assert made.has(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.05


def ranked_by_hand(docs, items, k=50):
    found = [(i, [w.translate(UPPER) for w in TERM.findall(t or "")]) for i, t in docs]
    found = [(i, w) for i, w in found if w]
    n_docs, n_terms = len(found), sum(len(w) for _, w in found)
    df = collections.Counter(t for _, w in found for t in set(w))
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= {w.translate(UPPER) for w in TERM.findall(text or "")}
    out = {}
    for item, terms in asked.items():
        scores = []
        for i, w in found:
            tf, m = collections.Counter(w), 50 + (50 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0))
        out[item] = [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return {(item, *x) for item, xs in out.items() for x in xs}


def search_rows():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünder", "日本", "ÉCOLE", "x_y", "a-b"]
    draw = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.02)), 404)] for _ in range(n))
    docs = [(i, draw(rng.randrange(1, 120))) for i in range(500)]
    docs += [(1000 + i, "w0 w1 same words here w300") for i in range(70)] + [(7, "w5 " * 400), (7, "w5 " * 400), (None, "w300 w301"), (None, "w300 w301"), (2000, None), (2001, ""), (2002, " ,.-"), (2003, draw(30_000))]
    items = [(k, draw(25)) for k in range(12)] + [(20, None), (21, "..."), (22, "nowhere w300"), (23, "w1"), (23, "w5"), (24, "w399 w398"), (None, "w7 w300")]
    return docs, items


@pytest.mark.parametrize("block", [2000, 3])
def test_search_ranks_as_plain_scoring_does(spark, docs_of, block):
    docs, items = search_rows()
    frame = docs_of(docs).withColumn("row", F.lit(1)).withColumn("score", F.lit("x")).repartition(4)
    got = [tuple(r) for r in search.search(frame, spark.createDataFrame(items, "item_id long, text string"), block_items=block).collect()]
    assert len(got) == len(set(got)) and set(got) == ranked_by_hand(docs, items)


def test_search_of_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs_of([]), items).count() == 0
    assert search.search(docs_of([(1, None), (2, "..")]), items).count() == 0
    assert search.search(docs_of([(1, "a")]), items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(docs_of([(1, "a b"), (2, "c")]), items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_sketches_bound_every_score():
    docs, items = search_rows()
    block = search.Block([(i, [t or ""]) for i, t in items if i is not None])
    words = [search.terms((t or "").encode()) for _, t in docs]
    block.weigh({}, len(docs), sum(map(len, words)))
    hashes = WordHashes()
    loose = 0
    for (_, text), w in zip(docs, words):
        if w:
            bound, exact = block.bounds(search.sketch(w, hashes), len(w)), block.exact(text.encode(), len(w))
            assert (bound >= exact).all()
            loose += (bound > 1.5 * exact + 1).sum()
    assert loose < 0.1 * len(docs) * len(block.ids)
