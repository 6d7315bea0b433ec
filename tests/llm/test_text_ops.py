"""Quality rules, license scan, near-duplicates and packing on small fixtures against brute force."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import bitpack, licenses, neardup, packing, quality, queries, tokens
from talus.runtime import table

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"w{i % 3000}" for i in range(30_000))


def odd_rows():
    words = [f"word{i}" for i in range(60)]
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, " ".join(words)), (6, " ".join(words)), (7, " ".join(words)),
        (8, "a b c " * 40), (9, "line x\nline x\n\nline y\n"), (10, LONG), (None, " ".join(reversed(words))), (12, "é　ü \x0b ß # $ %"), (13, "x" * 200_000),
    ]


def base_of(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = collections.Counter(windows)
    again = {j for k, x in enumerate(windows) if n[x] > 1 for j in (k, k + 1, k + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))


def test_quality_base_counts(docs_of):
    got = quality.quality(docs_of(odd_rows()).withColumn("row_key", F.lit(1)).withColumn("kept", F.lit("x"))).collect()
    assert len(got) == len(odd_rows())
    want = collections.Counter((i, *base_of(t)) for i, t in odd_rows())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want


def test_quality_on_table(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in quality.quality(table(spark, sf, "documents")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_of(docs[r.doc_id])


def test_common_lines_are_removed_and_depleted_documents_rejected(docs_of):
    rng = random.Random(1)
    body = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(60))
    common = " ".join(f"menu{i}" for i in range(100))
    rows = [(i, f"{body()}\n{common}" if i < 30 else body(), "hot") for i in range(100)]
    rows += [(500 + i, " ".join(f"own{i}x{k}" for k in range(20)) + "\n" + common.upper(), "hot") for i in range(5)] + [(900, f"{body()}\n{common}", "other")]
    got = {r.doc_id: r for r in quality.quality(docs_of(rows)).collect()}
    assert got[3].removed_words == 100 and got[3].kept and got[50].removed_words == 0 and got[50].kept
    assert got[500].removed_words == 100 and not got[500].kept and not got[500].base_failed
    assert got[900].removed_words == 0 and got[900].kept
    kept = {r.doc_id for r in quality.keep_good(docs_of(rows)).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_quality_equals_its_sql_where_documents_are_depleted(spark, tmp_path):
    rng = random.Random(6)
    body = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    menu = " ".join(f"menu{i}" for i in range(90))
    rows = [(i, f"{body(60)}\n{menu}" if i < 40 else f"{body(12)}\n {menu.upper()} \n{menu}" if i < 50 else body(70), "en", "hot", 0) for i in range(150)]
    rows += [(200 + i, f"{body(12)}\n{menu}", "en", "small", 0) for i in range(10)] + [(300 + i, f"{body(12)}\n{menu}", "en", "next", 0) for i in range(11)]
    copied = f"{body(60)}\n{menu}"  # copies of a text are one document
    rows += [(400 + i, copied, "en", "copies", 0) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op1_quality_rules"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    found = sorted(tuple(r) for r in got.select(*names).collect())
    assert found == sorted(want.fetchall())
    depleted = {r.doc_id for r in got.where("NOT kept AND NOT base_failed").collect()}
    assert depleted == {*range(40, 50), *range(300, 311)}


def test_windows_with_equal_hashes_are_told_apart(spark):
    rng = random.Random(8)
    texts = [[rng.choice("abcdef") for _ in range(rng.randrange(3, 60))] for _ in range(60)]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(texts)], "k int, words array<string>")
    for bits in (62, 60, None):  # 2 and 4 bits of hash only, so that different windows collide
        b = quality.position_bits(F.col("words")) if bits is None else F.lit(bits)
        at = quality.repeated_positions(F.col("words"), quality.window_keys(F.col("words"), b), b)
        for r in df.select("k", at.alias("at")).collect():
            windows = [tuple(texts[r.k][i : i + 3]) for i in range(len(texts[r.k]) - 2)]
            n = collections.Counter(windows)
            assert r["at"] == [i for i, w in enumerate(windows) if n[w] > 1]


def test_kept_texts_lose_their_common_lines(docs_of):
    rng = random.Random(4)
    body = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(60))
    bodies = {i: (body(), body()) for i in range(40)}
    rows = [(i, f"{a}\n  Menu 7  home\n\n{b}\nmenu {i % 10} HOME", "hot") for i, (a, b) in bodies.items()]
    rows += [(900, rows[0][1], "other"), (0, rows[0][1], "other"), (901, f"{body()}\nmenu 1 home", None), (902, body() + " \n\tx \n", "hot")]
    got = {(r.doc_id, r.source): r for r in quality.keep_good(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for i, (a, b) in bodies.items():
        assert got[i, "hot"].text == f"{a}\n\n{b}" and got[i, "hot"].n_chars == len(f"{a}\n\n{b}")
    for i, text, source in rows[40:]:
        assert got[i, source].text == text and got[i, source].n_chars == len(text)
    removed = {(r.doc_id, r.removed_words) for r in quality.quality(docs_of(rows)).collect()}
    assert {(0, 6), (0, 0), (900, 0), (39, 6)} <= removed


def test_empty_tables(docs_of):
    empty = docs_of([(1, "x")]).where("false")
    assert quality.quality(empty).count() == licenses.scan(empty).count() == neardup.near_duplicates(empty).count() == 0
    assert packing.pack(empty, tokens.default_path()).count() == 0


def contained_by_hand(text):
    """License -> the best share of a notice's shingles in any stretch of twice its scale, by plain sets."""
    cut = lambda t: WORD.findall((t or "").translate(str.maketrans(licenses.MARKS, " " * len(licenses.MARKS))).lower())
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    sh, best = grams(cut(text)), {}
    for name, notices in licenses.NOTICES.items():
        for want in (set(grams(cut(t))) for t in notices):
            size = licenses.scale(len(want)) if want else 1
            for start in range(0, max(1, len(sh)), size):
                share = len(want & set(sh[start : start + 2 * size])) / len(want) if want else 0
                if share >= licenses.CONTAINED:
                    best[name] = max(best.get(name, 0), share)
    return best


def commented(text, sign, width=68):
    import textwrap

    return "\n".join(f"{sign} {line}" for line in textwrap.wrap(text, width))


def test_license_scan_by_brute_force(docs_of):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    mit, full = licenses.NOTICES["MIT"][2:4]
    texts = [
        f"{filler(500)}\nReleased under the MIT License.\n{filler(30)}", f"{filler(333)} {mit} {filler(7)}", filler(400), None, "", "MIT License", f"{filler(20)} {mit.replace('free of charge', 'free of any charge')}",
        "LICENSED UNDER CC BY-NC 4.0", f"{filler(90)}\n{full}\n{filler(900)}", full[: len(full) // 2], commented(full, "//"), commented(licenses.NOTICES["GPL-3.0"][1], " *"), commented(licenses.NOTICES["BSD-3-Clause"][1], "#"),
        " ".join(w if rng.random() > 0.01 else "xx" for w in full.split()), f"{filler(40_000)} {licenses.NOTICES['ISC'][0]}", *(f"{filler(k)} {t} {filler(70 - k)}" for k, ts in enumerate(licenses.NOTICES.values()) for t in ts),
    ]
    rows = [*enumerate(texts), (7, texts[7]), (None, texts[1])]
    got = collections.defaultdict(dict)
    for r in licenses.scan(docs_of(rows).withColumn("license", F.lit(1))).collect():
        got[r.doc_id][r.license] = round(r.containment, 9)
    want = {i: {k: round(v, 9) for k, v in contained_by_hand(t).items()} for i, t in rows}
    assert got == {i: v for i, v in want.items() if v}
    assert all(x in got for x in (1, 8, 10, 11, 12, 14)) and not got.get(9, {}).get("ISC")
    assert licenses.scan(docs_of(rows), {}).count() == 0


def test_license_bands_meet_their_guarantee():
    for m in range(1, 200):
        size = licenses.scale(m)
        s = math.ceil(licenses.CONTAINED * m)
        assert size >= 1.25 * m and (1 - s / (2 * size + m - s)) ** licenses.bands_needed(m, size) <= licenses.MISS


def brute_components(rows, width, percent=80):
    sets, up = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed=3):
    rng = random.Random(seed)
    rows, n = [], 0
    for family in range(6):
        base = [f"t{rng.randrange(10**6)}" for _ in range(150)]
        for edits in (0, 0, 1, 2, 3, 4, 6, 8, 12, 20):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(w) if n % 3 else " ".join(w).upper()))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A  B"), (n + 4, "a b c"), (n + 5, LONG), (n + 6, LONG + " tail")]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_against_all_pairs(docs_of, width):
    rows = near_rows()
    want = brute_components(rows, width)
    got = neardup.near_duplicates(docs_of(rows).withColumn("component_id", F.lit("x")), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_large_group_of_near_copies(docs_of):
    rng = random.Random(5)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(rows), width=4).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 4).items()}


def test_repeated_and_null_ids(docs_of):
    t = " ".join(f"w{i}" for i in range(30))
    got = neardup.near_duplicates(docs_of([(1, t), (1, t), (2, t), (None, t), (3, "other words here now")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("None", "None", True)]


def with_repeats(rows, width):
    """brute_components over rows whose ids may repeat: the rows of an id are one node."""
    single = brute_components([(k, t) for k, (_, t) in enumerate(rows)], width)
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, _) in enumerate(rows):
        other = rows[single[k][1]][0]
        if i is not None and other is not None:
            x, y = find(i), find(other)
            up[max(x, y)] = min(x, y)
    return collections.Counter((i, single[k][0], find(i) if i is not None else None) for k, (i, _) in enumerate(rows))


def test_repeated_ids_in_any_order(docs_of):
    rng = random.Random(9)
    a, b, c = ([f"{x}{i}" for i in range(100)] for x in "abc")
    near = lambda w: " ".join([*w[:99], f"e{rng.randrange(10**6)}"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (5, near(c)), (5, near(a)), (7, ""), (7, near(c)), (6, "some other words of its own"), (6, None), (6, "some other words of its own"), (-4, " ".join(b))]
    for _ in range(3):
        rng.shuffle(rows)
        want = with_repeats(rows, 4)
        got = neardup.near_duplicates(docs_of(rows), width=4).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_hot_buckets_are_cut_into_strips_and_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "STRIP", 4)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(11)
    rows, n = [], 0
    for family in range(3):
        base = [f"{family}t{k}" for k in range(100)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(rows), width=4, pivots=(1,)).collect()}
    assert got == brute_components(rows, 4)


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    s = neardup.sketch([a, b, a[:1]], 150)
    assert (s != np.iinfo(np.uint64).max).all() and abs((s[0] == s[1]).mean() - 0.8) < 0.12


def test_token_ids_equal_a_fresh_tokenizers(spark, sf):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.default_path())
    enc = tokens.TextEncoder(tokens.default_path())
    texts = [r.text for r in table(spark, sf, "documents").limit(60).collect()]
    texts += ["", " ", "a  b", " a\n b", "it's  x.\n\n y ", "日本語 テキ, ok", "a　 b", "\U00020bb7 x.", "tab\tx\r\ny z . ,", "é.à, ǅ ª", "x\n"]
    texts += ["<|endoftext|> y", "x <|endoftext|> y", "x<|endoftext|>", "<|endoftext|>", "two <|endoftext|>\n <|endoftext|> of them", "<|endoftext|", "< |endoftext|>"]
    for t in texts:
        assert list(enc.ids(t)) == fresh.encode(t, add_special_tokens=False).ids
    assert enc.ids("x <|endoftext|> y").tolist().count(50256) == 1


def test_packing_and_token_files_take_the_librarys_ids(docs_of):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.default_path())
    texts = {1: "x <|endoftext|> y", 2: "plain words here.\nand a line", 3: "", 4: None, 5: "<|endoftext|>"}
    ids = {i: fresh.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    packed = {r.doc_id: r for r in packing.pack(docs_of(list(texts.items())), tokens.default_path()).collect()}
    assert {i: (r.length, r.ids_crc32) for i, r in packed.items()} == {i: (len(x) + 1, crc([*x, 0])) for i, x in ids.items()}
    filed = {r.doc_id: r for r in bitpack.round_trip(docs_of(list(texts.items())), tokens.default_path()).collect()}
    assert {i: (r.n_tokens, r.ids_crc32) for i, r in filed.items()} == {i: (len(x) + 1, crc([*x, 2])) for i, x in ids.items()}


def test_packing(docs_of):
    rows = [*((i, f"some words number {i} " * (i % 40 + 1)) for i in range(80)), (200, None), (201, ""), (201, "twice"), (202, "long text " * 3000), (None, "x")]
    enc = tokens.encoder(tokens.default_path())
    got = packing.pack(docs_of(rows).withColumn("piece", F.lit("x")), tokens.default_path(), 512).collect()
    by_seq, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    ids = np.append(enc.ids(rows[-2][1]).astype("<u4"), 0).astype("<u4")
    long = sorted(pieces[202], key=lambda r: r.piece)
    assert [r.piece for r in long] == list(range(len(long))) and all(r.length == 512 for r in long[1:]) and sum(r.length for r in long) == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in long)
    assert len(pieces[201]) == 2 and pieces[200][0].length == 1
    total = sum(r.length for r in got)
    assert len(by_seq) <= math.ceil(total / 512) + 2


def test_best_fit_rounds_place_everything():
    rng = random.Random(4)
    for _ in range(20):
        counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(30)}
        plan = sorted(packing.plan_rounds(counts, 100))
        filled = collections.defaultdict(int)
        spans = collections.defaultdict(list)
        for k, (length, rank, first, offset) in enumerate(plan):
            stop = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else counts[length]
            for n in range(stop - rank):
                spans[first + n].append((offset, length))
                filled[length] += 1
        assert filled == counts
        for parts in spans.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 100
