"""Columns named like an operator's own, and operators against plain versions of their rules."""

import bisect
import collections
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talus.llm import bitpack, embeddings, mixing, packing, quality, queries, tokens, toxicity, warc

CLASHES = ("__k", "__h", "__key", "__copy", "__gone", "__rn", "row", "k", "h", "key", "rate", "n", "row_key", "removed_lines", "share", "salt", "kept", "text_key")


def clashing(df):
    """The rows with columns of such names, each telling its row."""
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in CLASHES})


def own(row):
    return all(row[c] == c + ("null" if row.doc_id is None else str(row.doc_id)) for c in CLASHES)


def test_mixing_keeps_columns_of_any_name(docs_of):
    docs = clashing(docs_of([(i, f"text {i % 7}", "a" if i % 3 else None) for i in range(60)] + [(None, None, "b"), (None, "x", "b")]))
    out = mixing.mix(docs)
    rows = out.collect()
    assert out.columns == [*docs.columns, "copy"] and rows and all(own(r) for r in rows)
    plain = sorted((str(r.doc_id), r.copy) for r in mixing.mix(docs.drop(*CLASHES)).collect())
    assert sorted((str(r.doc_id), r.copy) for r in rows) == plain
    assert mixing.mix(docs, copy_column="__copy").columns == [c for c in docs.columns if c != "__copy"] + ["__copy"]


def test_quality_keeps_columns_of_any_name(docs_of):
    spelled = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))  # noqa: E731  (digits are alike in a line)
    body = lambda i: " ".join(f"w{spelled(i)}x{spelled(k)}" for k in range(60))
    docs = clashing(docs_of([(i, body(i) + ("\ncommon line of all pages" if i < 20 else ""), "host") for i in range(30)] + [(90, None), (None, body(91)), (7, body(7) + "\ncommon line of all pages", "host")]))
    out = quality.keep_good(docs)
    rows = out.collect()
    assert out.columns == docs.columns and all(own(r) for r in rows)
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter([*range(30), None, 7])
    assert all(r.text == body(r.doc_id) and r.n_chars == len(r.text) for r in rows if r.doc_id is not None and r.doc_id < 20)


def test_near_dedup_stage_keeps_columns_of_any_name(spark, docs_of, sf):
    t = " ".join(f"w{i}" for i in range(80))
    docs = clashing(docs_of([(1, t), (1, t), (1, "else " + t), (2, t), (3, "quite another text"), (None, t)]))
    out = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    rows = out.collect()
    assert out.columns == docs.columns and all(own(r) for r in rows) and sorted(str(r.doc_id) for r in rows) == ["1", "3", "None"]


@pytest.mark.parametrize("stage, left", [("toxicity_stage", {None: 1, 1: 2, 2: 1, 3: 1, 4: 1}), ("quality_stage", {4: 1}), ("near_dedup_stage", {None: 1, 1: 1, 2: 1, 3: 1, 4: 1}), ("packing_stage", {None: 1, 1: 2, 2: 5, 3: 1, 4: 1})])
def test_which_odd_rows_a_stage_keeps(spark, docs_of, sf, stage, left):
    docs = docs_of([(None, None), (1, ""), (1, ""), (2, "x " * 5000, None), (3, "one two three"), (4, " ".join(f"clean{i}" for i in range(70)))])
    got = collections.Counter(r.doc_id for r in getattr(corpus_pipeline, stage)(spark, docs, sf).collect())
    assert (got if stage != "packing_stage" else {k: max(1, v) for k, v in got.items()}).keys() == left.keys()
    assert all(got[k] == n for k, n in left.items() if k != 2)


def test_poisson_counts_are_the_inversion_of_the_same_numbers(spark):
    for rate in (0.2, 1.0, 3.7, 15.0):
        rows = spark.range(400).select(mixing.uniform("id", seed=5).alias("u"), mixing.poisson(mixing.uniform("id", seed=5), F.lit(rate)).alias("k")).collect()
        for r in rows:
            p = c = math.exp(-rate)
            k = 0
            while r.u >= c:
                k += 1
                p *= rate / k
                c += p
            assert r.k == k


def test_toxicity_odd_rows_with_a_fitted_model(spark, docs_of):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = [f"v{rng.randrange(300)}" for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            w[5] = w[50] = "vileword"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    odd = [(10_000, None), (10_001, ""), (10_002, "  \n"), (None, "vileword " * 3), (10_003, "vileword " * 100_000), (10_004, "clean words " * 50_000), (0, rows[0][1]), (0, rows[0][1])]
    docs = docs_of(rows + odd).withColumn("score", F.lit("x")).withColumn("positive", F.lit(1)).withColumn("t", F.lit(2))
    marks = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    assert model.positives > 10 and model.weights.max() > 0
    got = collections.defaultdict(list)
    for r in toxicity.score(docs, model).collect():
        got[r.doc_id].append(r)
    assert len(got[0]) == 3 and len({r.score for r in got[0]}) == 1 and got[0][0].predicted == 1
    assert {got[k][0].score for k in (10_000, 10_001, 10_002)} == {got[10_000][0].score} and got[10_000][0].predicted == 0
    assert got[None][0].predicted == 1 and got[10_003][0].predicted == 1 and got[10_004][0].predicted == 0
    again = toxicity.train(docs.unionByName(docs.where("doc_id = 0")), marks)  # more copies of a row change nothing
    assert np.array_equal(model.weights, again.weights)


def plain_nnpu(rows, positive, prior, members, rounds):
    """The estimator's gradient row by row and feature by feature, with the same steps."""
    n_p, n_u_all = sum(positive), len(rows) - sum(positive)
    count = lambda f, side: sum(f in r for r, p in zip(rows, positive) if p == side)
    every = sorted({int(f) for r in rows for f in r})
    known = [f for f in every if len(toxicity.speaking(np.array([float(count(f, True))]), np.array([float(count(f, False))]), n_p, n_u_all))]
    total, total_b = dict.fromkeys(known, 0.0), 0.0
    for seed in range(members):
        take = np.random.default_rng(seed).random(len(rows)) < toxicity.MEMBER_SHARE
        mine = [(r, p) for r, p, t in zip(rows, positive, take) if p or t]
        n_u = sum(not p for _, p in mine)
        w, b = dict.fromkeys(known, 0.0), -2.0
        m, v, mb, vb = dict.fromkeys(known, 0.0), dict.fromkeys(known, 0.0), 0.0, 0.0
        for step in range(1, rounds + 1):
            f = [sum(w.get(int(x), 0.0) for x in r) + b for r, _ in mine]
            cap = [min(x, toxicity.CEILING) for x in f]
            sig = [1 / (1 + math.exp(-x)) for x in cap]
            minus = [math.log1p(math.exp(x)) for x in cap]
            negative = sum(z for z, (_, p) in zip(minus, mine) if not p) / n_u - prior * sum(z for z, (_, p) in zip(minus, mine) if p) / n_p
            g = []
            for s, x, (_, p) in zip(sig, f, mine):
                if negative >= 0:
                    one = prior / n_p * ((s - 1) - s) if p else s / n_u
                else:
                    one = prior / n_p * s if p else -s / n_u
                g.append(0.0 if x > toxicity.CEILING else one)
            gb = sum(g)
            for key in known:
                gw = sum(one * sum(int(x) == key for x in r) for one, (r, _) in zip(g, mine))
                m[key], v[key] = 0.9 * m[key] + 0.1 * gw, 0.99 * v[key] + 0.01 * gw**2
                w[key] -= 0.15 * (m[key] / (1 - 0.9**step)) / (math.sqrt(v[key] / (1 - 0.99**step)) + 1e-6)
                w[key] = max(w[key] - toxicity.SHRINK, 0.0)
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            b = min(b - 0.15 * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-6), math.log(prior / (1 - prior)))
        for key in known:
            total[key] += w[key] / members
        total_b += b / members
    return total, total_b


@pytest.mark.parametrize("prior", [0.02, 0.3])
def test_non_negative_learning_is_the_plain_loop(prior):
    rng = np.random.default_rng(3)
    positive = np.array([True] * 15 + [False] * 60)
    rows = [np.array([*rng.integers(0, 12, 5), *([20, 21] if p and rng.random() < 0.8 else [])], np.uint32) for p in positive]
    weights, bias = toxicity.fit_nnpu(rows, positive, prior, members=2, rounds=40)
    want, want_bias = plain_nnpu(rows, positive.tolist(), prior, 2, 40)
    assert {20, 21} <= set(want) and set(np.flatnonzero(weights)) <= set(want)
    assert all(abs(weights[k] - w) < 1e-5 for k, w in want.items()) and abs(bias - want_bias) < 1e-6


def replayed(counts, capacity):
    """The plan's rows in order, each checked against the gaps that are open: (sequences, gaps)."""
    gaps: dict[int, int] = {}
    open_gaps: list[int] = []
    plan = packing.plan_rounds(counts, capacity)
    ends = collections.defaultdict(list)
    for length, rank, first, offset in plan:
        ends[length].append(rank)
    for length, rank, first, offset in plan:
        later = [r for r in ends[length] if r > rank]
        n = (min(later) if later else counts[length]) - rank
        at = bisect.bisect_left(open_gaps, length)
        if at < len(open_gaps):  # the smallest gap that holds it
            assert capacity - offset == open_gaps[at]
        else:
            assert offset == 0
        for s in range(first, first + n):
            gap = gaps.get(s, capacity)
            assert gap == capacity - offset >= length
            if s in gaps:
                open_gaps.pop(bisect.bisect_left(open_gaps, gap))
            gaps[s] = gap - length
            bisect.insort(open_gaps, gap - length)
    return gaps


def swept(lengths, capacity):
    """Bulk-synchronous sweeps: each document asks for its successor gap, a gap takes its first by rank, the rest ask again."""
    left, gaps, rounds, sequences = sorted(lengths, reverse=True), [], 0, 0
    while left:
        rounds += 1
        gaps.sort()
        taken, after, new = set(), [], []
        for length in left:
            at = bisect.bisect_left(gaps, length)
            if at >= len(gaps):
                if length == left[0] or not gaps:
                    sequences += 1
                    new.append(capacity - length)
                else:
                    after.append(length)
            elif at in taken:
                after.append(length)
            else:
                taken.add(at)
                new.append(gaps[at] - length)
        gaps = [g for i, g in enumerate(gaps) if i not in taken] + [g for g in new if g]
        left = after
    return sequences, rounds


@pytest.mark.parametrize("capacity", [64, 2048])
def test_every_run_takes_the_smallest_gap_that_holds_it(capacity):
    rng = random.Random(capacity)
    lengths = [min(capacity, 1 + int(rng.expovariate(6 / capacity))) for _ in range(3000)]
    gaps = replayed(collections.Counter(lengths), capacity)
    least = -(-sum(lengths) // capacity)
    assert sum(capacity - g for g in gaps.values()) == sum(lengths) and least <= len(gaps) <= least + max(2, least // 50)
    # the sweeps that the README compares with
    assert len(gaps) <= swept(lengths, capacity)[0]


def test_links_of_vectors_by_sql(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for group in range(40):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((i, (centre + rng.normal(size=24) * rng.choice([0.1, 0.27, 0.6])).astype(np.float32).tolist(), group % 5))
            i += 1
    rows += [(i, None, 1), (i + 1, [0.0] * 24, 1), (i + 2, [None] + [1.0] * 23, 1), (i + 3, [float("nan")] * 24, 1), (i + 4, rows[0][1], None), (i + 5, [], 2), (i + 6, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(f"{tmp_path}/v")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.OP10})").fetchall())
    got = sorted(tuple(r) for r in embeddings.near_duplicate_vectors(df).collect())
    assert got == want and sum(r[1] for r in want) > 50


def test_short_rows_close_files(spark, docs_of, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "") for i in range(50)], "page_id long, url string, html string").coalesce(1)
    rows = warc.round_trip(pages).collect()
    assert len(rows) == 50 and warc.ARCHIVE_ROWS < 10**6 and bitpack.FILE_DOCS < 10**6
    docs = docs_of([(i, "") for i in range(50)])
    assert sorted(r.start for r in bitpack.round_trip(docs, tokens.default_path()).collect()) == list(range(50))


def test_header_values_of_different_urls_differ():
    urls = ["http://a/​", "http://a/‌", "http://a/\xad", "http://a/\x7f", "http://a/\r\nX: y", "http://a/ü"]
    shown = [warc._header_value(u) for u in urls]
    assert len(set(shown)) == len(urls) and shown[0] == "http://a/%E2%80%8B" and shown[-1] == urls[-1] and not any("\n" in x for x in shown)
