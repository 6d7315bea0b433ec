"""Toxicity, mixing and language-model scoring."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import lm, mixing, queries, toxicity
from talus.runtime import table


def toxic_rows(n=900):
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(80)]
        bad = i % 8 == 0
        if bad:
            for x in rng.sample(["nasty", "vileword", "foulness", "grimey"], 2):
                w[rng.randrange(80)] = x
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_separates_held_out_rows(spark, docs_of):
    rows, labels = toxic_rows()
    docs, marks = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = sum(got[i].predicted == int(i % 8 == 0) for i in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.score < toxicity.THRESHOLD}


def test_toxicity_reads_no_held_out_label(spark, docs_of):
    rows, labels = toxic_rows(300)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = marks.withColumn("toxic", F.when(F.pmod(queries.id_crc(), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs_of(rows), marks), toxicity.train(docs_of(rows), flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (2, "x"), (None, "y"), (3, "z " * 50_000)]).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and all(r.predicted == 0 for r in got)
    assert toxicity.score(docs.where("false"), model).count() == 0 and toxicity.keep_clean(docs, model).columns == docs.columns


def test_risk_is_non_negative_learning():
    rng = np.random.default_rng(0)
    rows = [np.array([1, 2, 7], np.uint32)] * 20 + [np.array([3, 4], np.uint32)] * 200
    weights, bias = toxicity.fit_nnpu(rows, np.array([True] * 20 + [False] * 200), 0.1)
    assert weights[[1, 2, 7]].min() > 0 and weights[[3, 4]].max() == 0 and bias <= math.log(0.1 / 0.9) + 1e-9
    assert rng is not None


def test_poisson_inversion(spark):
    for rate in (0.0, 0.3, 1.0, 4.0, 16.0):
        n = [r[0] for r in spark.range(20_000).select(mixing.poisson(mixing.uniform("id", seed=3), F.lit(rate))).collect()]
        assert abs(np.mean(n) - rate) < 0.05 * max(1, rate) and abs(np.var(n) - rate) < 0.1 * max(1, rate)


def test_mixing_by_brute_force(spark, docs_of):
    rows = [(i, f"text {i}", "hot" if i % 3 else None if i % 9 == 0 else "cold") for i in range(3000)]
    docs = docs_of(rows)
    rates = {r.source: r.rate for r in mixing.rates(docs).collect()}
    sizes = collections.Counter(r[2] for r in rows)
    share = {s: n**0.7 for s, n in sizes.items()}
    for s, n in sizes.items():
        assert math.isclose(rates[s], 3000 * share[s] / sum(share.values()) / n, rel_tol=1e-9)
    got = collections.Counter(r.source for r in mixing.mix(docs).collect())
    for s, n in sizes.items():
        assert abs(got[s] - rates[s] * n) < 5 * math.sqrt(rates[s] * n)
    again = [(r.doc_id, r.copy) for r in mixing.mix(docs.repartition(7)).collect()]
    assert sorted(again) == sorted((r.doc_id, r.copy) for r in mixing.mix(docs).collect())


def test_mixing_target_weights_and_odd_rows(docs_of):
    docs = docs_of([*((i, "a", "x") for i in range(500)), *((i, "b", "y") for i in range(500, 1000)), (None, None, "x"), (5, "", "x"), (5, "", "x")]).withColumn("copy", F.lit("clash"))
    out = mixing.mix(docs, {"x": 3.0, "y": 1.0})
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    n = collections.Counter(r.source for r in out.collect())
    assert 2.2 < n["x"] / n["y"] < 4.0
    assert mixing.mix(docs, {"nowhere": 1.0}).count() == 0 and mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs, copy_column=None).columns == docs.columns


def test_mixing_meets_weights_whose_rates_are_large(spark, docs_of):
    docs = docs_of([(i, f"text {i}", "rare" if i % 100 == 0 else "big") for i in range(10_000)])
    weights = {"rare": 0.5, "big": 0.5}
    assert {r.source: round(r.rate, 6) for r in mixing.rates(docs, weights).collect()} == {"rare": 50.0, "big": round(5000 / 9900, 6)}
    rows = mixing.mix(docs, weights).collect()
    n = collections.Counter(r.source for r in rows)
    assert abs(n["rare"] - 5000) < 5 * math.sqrt(5000) and abs(n["big"] - 5000) < 5 * math.sqrt(5000)
    of = collections.Counter(r.doc_id for r in rows if r.source == "rare")
    copies = {(r.doc_id, r.copy) for r in rows if r.source == "rare"}
    assert copies == {(i, k) for i, c in of.items() for k in range(c)}
    for rate in (16.5, 50.0, 400.0):
        k = [r[0] for r in spark.range(5000).select(mixing.copies_of(F.col("id"), rate=F.lit(rate), seed=3)).collect()]
        assert abs(np.mean(k) - rate) < 5 * math.sqrt(rate / 5000) and abs(np.var(k) / rate - 1) < 0.12


def lm_reference(rows, held):
    words = {k: (t or "").encode().lower().split() + [None] for k, (_, t) in enumerate(rows)}
    c = collections.Counter(x for k, w in words.items() if not held(rows[k][0]) for x in w)
    n = sum(c.values())
    z = math.log10(n + 0.1 * (len(c) + 1))
    return {k: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(c[x] + 0.1) - z for x in w)) for k, w in words.items()}


def held_out():
    return F.pmod(queries.id_crc(), F.lit(10)) == 0


def test_lm_base_score_is_exact(docs_of):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "Cat", "dog,", "runs", f"n{rng.randrange(99)}"]) for _ in range(rng.randrange(60)))) for i in range(120)] + [(300, None), (301, ""), (302, "the " * 30_000), (302, "the the")]
    want = lm_reference(rows, lambda i: zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm.score(docs_of(rows).withColumn("score", F.lit("clash")), held_out(), rounds=3).collect()
    seen = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert seen == sorted((rows[k][0], a, b, n, round(s, 6)) for k, (a, b, n, s) in want.items())


def test_lm_beats_the_base_on_held_out_text(spark, sf):
    got = lm.score(table(spark, sf, "documents"), held_out()).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_score_equals_a_dense_model(docs_of, monkeypatch):
    """Each token's probability by dense softmaxes over the whole small vocabulary: the scores agree, and it sums to one."""
    monkeypatch.setattr(lm, "CELL_TYPES", 0.1)
    monkeypatch.setattr(lm, "BUCKET_TYPES", 8)
    rng = random.Random(4)
    vocab = [f"w{i}{rng.choice('abcd')}" for i in range(200)] + ["the", "of"]
    rows = [(i, " ".join(rng.choice(vocab[: 50 + i] + ["the"] * 9 + ["of"] * 5) for _ in range(rng.randrange(1, 60)))) for i in range(150)] + [(200, None), (201, "unseen words xyz")]
    held = F.pmod(queries.id_crc(), F.lit(10)) == 0
    docs = docs_of(rows)
    encoded, voc = lm.encoded_documents(docs, held)
    model, logs = lm.fit(encoded, voc, rounds=4)
    assert voc.bits >= 2 and np.abs(model.words).max() > 0 and np.abs(model.cells[1:]).max() > 0
    by_id = {r.doc_id: r for r in encoded.collect()}
    # what is known of each word: its class, its cell and its count
    known, text = {}, dict(rows)
    counts = collections.Counter(w for i, t in rows if not by_id[i].held_out for w in [*(t or "").lower().split(), None])
    for i, t in rows:
        for w, c, x in zip([*(t or "").lower().split(), None], by_id[i].classes, by_id[i].cells):
            assert known.setdefault(w, (c, x)) == (c, x)
    inner = np.exp(model.cell_logs())
    of_cell = collections.defaultdict(list)
    for w, (c, x) in known.items():
        if counts[w]:
            of_cell[c, x].append(w)

    def dense(history):
        """p of each training word, and of one unseen word for each cell, after a history of (class, cell)."""
        h = [*([(0, 0)] * 3), *history]
        (c1, x1), (c2, _), (c3, _) = h[-1], h[-2], h[-3]
        code = np.array([(c1 * lm.GROUPS + model.groups[c2]) * lm.GROUPS + model.groups[c3]])
        row = c1 if c1 <= lm.KEPT else 1 + lm.KEPT + ((c1 - 1 - lm.KEPT) << model.bits) + x1
        logits = model.by_context(code)[0] + model.words[row]
        p = np.exp(logits - logits.max())
        p /= p.sum()
        out, rest = {}, 0.0
        for c in range(lm.CLASSES):
            if c <= lm.KEPT:
                own = [w for w in of_cell.get((c, 0), [])]
                if own:
                    out[own[0]] = p[c]
                else:
                    rest += p[c]
                continue
            for x in range(1 << model.bits):
                words = of_cell.get((c, x), [])
                total = sum(counts[w] for w in words) + 0.1 * (len(words) + 1)
                share = p[c] * inner[model.groups[c1], c - 1 - lm.KEPT, x]
                for w in words:
                    out[w] = share * (counts[w] + 0.1) / total
                out[c, x] = share * 0.1 / total
        return out, rest

    got = {r.doc_id: r.score for r in lm.score(docs, held, rounds=4).collect()}
    for i in (0, 3, 7, 60, 149, 200, 201):
        history, total = [], 0.0
        for w in [*(text[i] or "").lower().split(), None]:
            p, rest = dense(history)
            assert abs(sum(p.values()) + rest - 1) < 1e-4
            total += math.log10(p[w] if counts[w] else p[known[w]])
            history.append(known[w])
        assert abs(total - got[i]) < 1e-3 * max(1, abs(total))


def test_lm_buckets_and_cells_grow_with_the_types():
    assert lm.bucket_bits(0) == 4 and lm.bucket_bits(64 << 20) == 7 and lm.bucket_bits(1 << 34) == 15


def test_lm_contexts_by_hand():
    groups = np.arange(lm.CLASSES) % lm.GROUPS
    classes, starts = np.array([5, 6, 7, 8, 0, 9, 0, 0, 3, 4]), np.array([0, 5, 7, 8])
    got = lm.contexts(classes, starts, groups)
    want, ends = [], [*starts[1:], len(classes)]
    for a, b in zip(starts, ends):
        for i in range(a, b):
            h = [classes[i - k] if i - k >= a else 0 for k in (1, 2, 3)]
            want.append((h[0] * lm.GROUPS + groups[h[1]]) * lm.GROUPS + groups[h[2]])
    assert got.tolist() == want


def test_lm_empty_tables(docs_of):
    docs = docs_of([(1, "a b")])
    assert lm.score(docs.where("false"), held_out()).count() == 0
    all_held = lm.score(docs, F.lit(True)).first()
    assert all_held.train_tokens == 0 and all_held.n_known == 0 and all_held.n_tokens == 3 and math.isfinite(all_held.score)


@pytest.mark.parametrize("name", ["op4_toxicity", "op5_mixing"])
def test_registered_query(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
