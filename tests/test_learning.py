"""Boosting, Shapley values and the Bayesian search against plain computations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from talus.operators import boosting, ml, shapley, tuning
from talus.plans import models

FEATURES = ["a", "b", "c"]


def rows_of(n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0.5)).astype(int)
    y[rng.random(n) < 0.05] ^= 1
    return x, y


def frame_of(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int").repartition(3)


def plain_boosting(x, y, edges, setting):
    """Trees grown node by node over the same candidate cuts, without histograms."""
    margin, trees = np.zeros(len(y)), []
    for _ in range(setting.trees):
        g, h = setting.objective.derivatives(margin, y)
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + setting.l2)

        def grow(mask, depth):
            best = (1e-9, None)
            if depth < setting.depth:
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        left = mask & (x[:, f] <= e)
                        right = mask & ~(x[:, f] <= e)
                        if h[left].sum() < setting.least_hessian or h[right].sum() < setting.least_hessian:
                            continue
                        gain = round(0.5 * (score(left) + score(right) - score(mask)) - setting.gamma, 9)
                        if gain > best[0]:
                            best = (gain, (f, e))
            if best[1] is None:
                margin[mask] += -g[mask].sum() / (h[mask].sum() + setting.l2) * setting.step
                return 1
            f, e = best[1]
            return grow(mask & (x[:, f] <= e), depth + 1) + grow(mask & (x[:, f] > e), depth + 1)

        trees.append(grow(np.ones(len(y), bool), 0))
    return margin, trees


@pytest.mark.parametrize("objective", [boosting.Logistic(2.0), boosting.CostSensitive(4.0)])
def test_boosting_is_plain_boosting(spark, objective):
    x, y = rows_of()
    setting = boosting.Setting(objective, trees=18, depth=3, step=0.3, gamma=0.05)
    df = frame_of(spark, x, y)
    model = boosting.train(df, "id", "y", FEATURES, [setting])[0]
    margin, leaves = plain_boosting(x, y.astype(float), model.edges, setting)
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == leaves
    got = {r.id: r.p for r in boosting.predict(df, "id", [model]).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_cost_gradient_of_the_learner_is_the_columns_one(spark):
    df = spark.createDataFrame([(p / 10, y) for p in range(1, 10) for y in (0, 1)], "p double, y int")
    g, h = ml.cost_gradient(F.col("p"), F.col("y"), 5)
    rows = df.select("p", "y", g.alias("g"), h.alias("h")).collect()
    margin, y = np.array([math.log(r.p / (1 - r.p)) for r in rows]), np.array([float(r.y) for r in rows])
    got = boosting.CostSensitive(5.0).derivatives(margin, y)
    assert np.allclose(got[0], [r.g for r in rows]) and np.allclose(got[1], [r.h for r in rows])


def test_many_models_in_the_same_passes_are_those_trained_alone(spark):
    x, y = rows_of()
    df = frame_of(spark, x, y).withColumn("fold", (F.col("id") % 3).cast("int"))
    settings = [boosting.Setting(fold=f, trees=6, depth=d, step=0.3, rows=0.8, columns=0.7) for f, d in ((0, 2), (1, 3), (None, 1))]
    together = boosting.train(df, "id", "y", FEATURES, settings, "fold")
    for s, model in zip(settings, together):
        alone = boosting.train(df, "id", "y", FEATURES, [s], "fold")[0]
        assert [(t.feature, t.cut) for t in model.trees] == [(t.feature, t.cut) for t in alone.trees]
        assert np.allclose(model.watched, alone.watched)


def test_early_stopping_keeps_the_best_number_of_trees(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(150, 3)), rng.integers(0, 2, 150)  # nothing to learn
    df = frame_of(spark, x, y).withColumn("fold", (F.col("id") % 2).cast("int"))
    model = boosting.train(df, "id", "y", FEATURES, [boosting.Setting(fold=0, trees=40, depth=4, step=0.5, patience=3)], "fold")[0]
    best = int(np.argmin(model.watched))
    assert len(model.trees) == best and len(model.watched) == best + 4
    bins = boosting.binned_values(x, model.edges)
    held = np.arange(150) % 2 == 0
    loss = lambda n: boosting.Logistic().loss(boosting.Model(model.setting, FEATURES, model.edges, model.trees[:n]).margins(bins[held]), y[held].astype(float)).mean()
    assert np.allclose([loss(n) for n in range(best + 1)], model.watched[: best + 1])


def test_out_of_fold_of_odd_rows(spark):
    x, y = rows_of(60)
    df = frame_of(spark, x, y)
    extra = spark.createDataFrame([(900, None, float("inf"), None, None), (901, 0.1, 0.2, 0.3, None), (5, 1.0, 1.0, 1.0, 1)], df.schema)
    got, models = boosting.out_of_fold(df.unionByName(extra).withColumn("fold", F.lit(9)).withColumn("margins", F.lit("x")), "id", "y", FEATURES, boosting.Setting(trees=4, depth=2), k=3)
    rows = got.collect()
    assert {r.id for r in rows} == set(range(60)) | {900, 901} and all(0 < r.p < 1 for r in rows)
    assert [r for r in rows if r.id == 900][0].fold is None and len(models) == 3
    empty = boosting.train(df.limit(0), "id", "y", FEATURES, [boosting.Setting(trees=3)])[0]
    assert all(t.feature == [-1] for t in empty.trees)
    assert [r.p for r in boosting.predict(df.limit(1), "id", [empty]).collect()] == [0.5]


def shapley_by_subsets(x, tree):
    """Shapley values by all subsets of features, the value of a subset by walking the tree."""
    n = len(x)

    def worth(known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        if f in known:
            return worth(known, tree.left[node] if x[f] <= tree.threshold[node] else tree.right[node])
        a, b = tree.cover[tree.left[node]], tree.cover[tree.right[node]]
        return (a * worth(known, tree.left[node]) + b * worth(known, tree.right[node])) / (a + b)

    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            for s in itertools.combinations(others, size):
                out[i] += math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n) * (worth({*s, i}) - worth(set(s)))
    return out, worth(set())


def random_tree(rng, depth, features):
    t = shapley.Nodes([], [], [], [], [], [])

    def grow(level, cover):
        at = len(t.feature)
        for column, v in zip((t.feature, t.threshold, t.left, t.right, t.value, t.cover), (-1, 0.0, 0, 0, float(rng.normal()), cover)):
            column.append(v)
        if level < depth and rng.random() < 0.85:
            t.feature[at], t.threshold[at] = int(rng.integers(features)), float(np.round(rng.normal(), 1))
            share = float(rng.uniform(0.1, 0.9))
            t.left[at] = grow(level + 1, cover * share)
            t.right[at] = grow(level + 1, cover * (1 - share))
        return at

    grow(0, 100.0)
    return t


def test_shapley_values_are_those_of_all_subsets():
    rng = np.random.default_rng(7)
    for _ in range(25):
        tree, x = random_tree(rng, 6, 5), np.round(rng.normal(size=(6, 5)), 1)
        got, base = shapley.shapley_values(x, shapley.leaves(tree))
        for row, values in zip(x, got):
            want, empty = shapley_by_subsets(row, tree)
            assert np.allclose(values, want) and abs(base - empty) < 1e-9


def test_shapley_of_models_adds_up_to_the_margin(spark):
    x, y = rows_of()
    df = frame_of(spark, x, y)
    own = boosting.train(df, "id", "y", FEATURES, [boosting.Setting(trees=5, depth=3, step=0.3)])[0]
    p = {r.id: r.p for r in boosting.predict(df, "id", [own]).collect()}
    for r in shapley.shapley_contributions(df, "id", FEATURES, shapley.of_boosted(own)).collect():
        assert abs(r.margin - math.log(p[r.id] / (1 - p[r.id]))) < 1e-6
        assert abs(r.base + sum(c.contribution for c in r.contributions) - r.margin) < 1e-9
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(ml.assembled(df, FEATURES).select(F.col("y").cast("double").alias("label"), "features"))
    scored = model.transform(ml.assembled(df, FEATURES)).select("id", "rawPrediction").collect()
    margins = {r.id: r.rawPrediction[1] / 2 for r in scored}
    got = shapley.shapley_contributions(df, "id", FEATURES, shapley.of_spark(model)).collect()
    scale = [r.margin / margins[r.id] for r in got if abs(margins[r.id]) > 0.1]
    assert np.allclose(scale, scale[0])


def test_posterior_is_the_closed_form():
    x, y = np.array([[0.2], [0.7]]), np.array([1.0, 3.0])
    gp = tuning.GaussianProcess(x, y, lengths=(0.5,), noise=0.0)
    k = lambda d: (1 + math.sqrt(5) * d / 0.5 + 5 * d * d / (3 * 0.25)) * math.exp(-math.sqrt(5) * d / 0.5)
    c, a, b = k(0.5), k(0.2), k(0.3)  # between the points, and from 0.4 to each
    z = (y - 2.0) / 1.0
    det = 1 - c * c
    w = np.array([a - c * b, b - c * a]) / det
    mean, spread = gp.posterior(np.array([[0.4], [0.2]]))
    assert abs(mean[0] - (2.0 + w @ z)) < 1e-9 and abs(spread[0] ** 2 - (1 - w @ [a, b])) < 1e-9
    assert abs(mean[1] - 1.0) < 1e-6 and spread[1] < 1e-4


def test_expected_improvement_is_the_integral():
    draws = np.random.default_rng(0).normal(0.3, 0.5, 2_000_000)
    assert abs(tuning.expected_improvement(np.array([0.3]), np.array([0.5]), 0.6)[0] - np.maximum(draws - 0.6, 0).mean()) < 2e-3


def test_search_beats_the_grid_in_fewer_fits():
    f = lambda s: -((s["depth"] - 6) ** 2) / 20 - (s["step"] - 0.17) ** 2 * 30 - (s["gamma"] - 1.3) ** 2 / 10
    seen = []
    found = tuning.search(lambda batch: [seen.append(len(batch)) or f(s) for s in batch], trials=20, parallel=4)
    grid = max(f({"depth": d, "step": e, "gamma": g}) for d in (3, 6, 10) for e in (0.01, 0.155, 0.3) for g in (0.0, 2.5, 5.0))
    assert len(found) == 20 and max(v for _, v in found) >= grid and len({tuple(s.values()) for s, _ in found}) == 20
    assert found == tuning.search(lambda batch: [f(s) for s in batch], trials=20, parallel=4)


def test_aucs_by_group(spark):
    rng = np.random.default_rng(2)
    rows = [(int(t), float(np.round(p, 1)), int(y)) for t, p, y in zip(rng.integers(0, 3, 300), rng.random(300), rng.integers(0, 2, 300))]
    got = {r.t: r.auc for r in tuning.aucs(spark.createDataFrame(rows, "t int, p double, y int"), "t").collect()}
    for t in range(3):
        pos, neg = ([p for g, p, y in rows if g == t and y == v] for v in (1, 0))
        assert abs(got[t] - sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))) < 1e-12


def test_tuned_gives_a_row_for_each_trial(spark):
    x, y = rows_of(120)
    rows = tuning.tuned(frame_of(spark, x, y), "id", "y", FEATURES, boosting.Setting(trees=3), trials=3, parallel=2, k=2).collect()
    assert [r.trial for r in rows] == [1, 2, 3] and all(3 <= r.depth <= 10 and 0.5 < r.auc <= 1 and 0 < r.f1 <= 1 for r in rows)


def test_the_registered_search_trains_as_many_trees_in_as_many_folds_as_the_reference(spark, monkeypatch, tmp_path):
    found = []
    monkeypatch.setattr(tuning, "tuned", lambda df, key, label, features, base, **more: found.append((base, more)))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    models.ml20b(spark, str(tmp_path))
    ((base, more),) = found
    assert (base.trees, base.patience, base.rows, base.columns) == (500, 30, 1.0, 1.0)
    assert (more["trials"], more["parallel"], more["k"]) == (20, 4, 5)


def test_a_search_of_rows_that_fit_a_task_makes_no_passes(spark, monkeypatch):
    x, y = rows_of(400)
    df, passes, plain = frame_of(spark, x, y), [], boosting._histograms
    search = lambda: [tuple(r) for r in tuning.tuned(df, "id", "y", FEATURES, boosting.Setting(trees=25, patience=3), trials=2, parallel=2, k=2).collect()]
    monkeypatch.setattr(boosting, "_histograms", lambda *a: (passes.append(1), plain(*a))[1])
    alone = search()
    assert not passes
    monkeypatch.setattr(boosting, "TASK_ROWS", 300)
    assert np.allclose(search(), alone, atol=1e-9) and len(passes) > 20


def test_both_ways_of_training_grow_the_same_trees(spark, monkeypatch):
    x, y = rows_of(500, 3)
    x[:, 2] = x[:, 0] * 2  # splits by a and c gain the same
    df = frame_of(spark, x, y).withColumn("fold", (F.col("id") % 4).cast("int")).withColumn("y", F.when(F.col("id") % 9 > 0, F.col("y")))
    df = df.unionByName(df.where("id < 40"))
    settings = [boosting.Setting(boosting.CostSensitive(3.0), None, 7, 6, 0.2, rows=0.7), boosting.Setting(boosting.Logistic(), 1, 40, 7, 0.6, 0.1, patience=2, columns=0.7), boosting.Setting(fold=2, trees=5, depth=1)]
    alone, held = boosting.train(df, "id", "y", FEATURES, settings, "fold"), boosting.held_out(df, "id", "y", FEATURES, settings, "fold").collect()
    scored = [r for r in boosting.predict(df, "id", alone, ("y",), "fold").collect() if r.y is not None]
    assert sorted((r.model, r.y, r.p) for r in scored) == sorted(map(tuple, held)) and {r.model for r in held} == {1, 2}
    monkeypatch.setattr(boosting, "TASK_ROWS", 300)
    passed = boosting.train(df, "id", "y", FEATURES, settings, "fold")
    for a, b in zip(alone, passed):
        assert [(t.feature, t.cut, t.left) for t in a.trees] == [(t.feature, t.cut, t.left) for t in b.trees] and len(a.trees) > 0
        assert np.allclose(a.watched, b.watched) and np.allclose(sum((t.cover for t in a.trees), []), sum((t.cover for t in b.trees), []))
    assert np.allclose(sorted(map(tuple, boosting.held_out(df, "id", "y", FEATURES, settings, "fold").collect())), sorted(map(tuple, held)))
