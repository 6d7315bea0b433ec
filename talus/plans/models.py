"""Scoring, evaluation and learning queries."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from talus.functions import risk
from talus.operators import boosting, evaluate, graph, ml, shapley, tuning
from talus.operators.events import folds
from talus.plans import world as w
from talus.plans.catalog import query
from talus.runtime import stage, table

SWEEP = f"WITH {w.SCORED}, t AS (SELECT unnest(range(10,91)) AS t), c AS (SELECT t/100 AS threshold, count(*) FILTER (p*100>=t-1e-9 AND y=1) AS tp, count(*) FILTER (p*100>=t-1e-9 AND y=0) AS fp, count(*) FILTER (p*100<t-1e-9 AND y=1) AS fn, count(*) FILTER (p*100<t-1e-9 AND y=0) AS tn FROM scored, t GROUP BY 1), r AS (SELECT *, coalesce(2*tp/nullif(2*tp+fp+fn,0),0) AS f1, coalesce(fp/nullif(fp+tn,0),0) AS fpr FROM c)"


def _table(s, d):
    sc = w.scored(s, d)
    noise = F.pmod(F.col("doc_id") * 61, F.lit(97)) / 97
    return sc.select(F.col("doc_id").alias("user_id"), F.col("y").alias("label"), (F.col("p") + F.col("y") * 0.4).alias("min_retention_minutes"), (F.col("q") * 10).alias("unique_ip_count"), noise.alias("night_tx_ratio"), (F.col("q") * 1000).alias("total_twd_volume"), F.pmod("doc_id", F.lit(5)).cast("double").alias("min_hops_to_blacklist"))


FEATURES = ["min_retention_minutes", "unique_ip_count", "night_tx_ratio", "total_twd_volume", "min_hops_to_blacklist"]


#: The second learner: the reference's depth, step, and shares of rows and columns.
SECOND = boosting.Setting(boosting.Logistic(), trees=60, depth=5, step=0.05, rows=0.8, columns=0.8, patience=10)


def _partly(s, d):
    """The table with the labels of a fifth of its rows hidden: those are to be scored."""
    return _table(s, d).withColumn("label", F.when(F.pmod("user_id", F.lit(5)) > 0, F.col("label")))


@query("ml1_out_of_fold")
def ml1(s, d):
    return ml.out_of_fold(_partly(s, d), "user_id", "label", FEATURES, k=5, trees=3, depth=3)


@query("ml1_second_learner")
def ml1b(s, d):
    """Histogram boosting with early stopping on each fold, rows and columns sampled."""
    return boosting.out_of_fold(_partly(s, d), "user_id", "label", FEATURES, SECOND)[0]


@query("ml1_blended_learners")
def ml1c(s, d):
    """The two learners' out-of-fold scores, and the weight of the second at which their blend has the best F1."""
    a = stage(ml.out_of_fold(_partly(s, d), "user_id", "label", FEATURES, k=5, trees=3, depth=3), "ml1-first").where("y IS NOT NULL")
    b = stage(boosting.out_of_fold(_partly(s, d), "user_id", "label", FEATURES, SECOND)[0], "ml1-second").where("y IS NOT NULL")
    both = a.select("user_id", "y", F.col("p").alias("p2")).join(b.select("user_id", F.col("p").alias("p1")), "user_id")
    return evaluate.blend(both.select("y", "p1", "p2"), list(range(50, 101, 5)), 500, 9400, 100).select("weight", "threshold", F.round("f1", 6).alias("f1"))


@query("ml2_fold_aware_cv")
def ml2(s, d):
    """Documents of one source and residue are neighbours; hops and listed neighbours come from each fold's own seeds."""
    docs = table(s, d, "documents").select("doc_id", F.concat_ws("/", "source", F.pmod("doc_id", F.lit(7)).cast("string")).alias("k"))
    edges = graph.symmetric(graph.shared_key_edges(docs, "k", "doc_id", cap=50))
    plain = [f for f in FEATURES if f != "min_hops_to_blacklist"]
    return ml.fold_aware(_partly(s, d), "user_id", "label", plain, edges, k=5, trees=3, depth=3)


@query("ml3_weight_grid")
def ml3(s, d):
    return ml.weight_grid(_table(s, d), "user_id", "label", FEATURES, [1, 3, 5, 10, 20, 30], k=3, trees=3, depth=3)


@query("ml4_composite", f"WITH {w.SCORED} SELECT doc_id, round(0.40*p+0.35*q+0.25*y,6) AS composite FROM scored")
def ml4(s, d):
    return w.scored(s, d).select("doc_id", F.round(evaluate.composite(F.col("p"), F.col("q"), F.col("y")), 6).alias("composite"))


@query("ml5_threshold_sweep", f"{SWEEP} SELECT threshold, tp, fp, fn, tn, round(f1,6) AS f1, round(fpr,6) AS fpr FROM r")
def ml5(s, d):
    return evaluate.sweep(w.scored(s, d), 1000, 9000, 100).select("threshold", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"), F.round("fpr", 6).alias("fpr"))


@query("ml6_conservative_threshold", f"{SWEEP} SELECT threshold, round(f1,6) AS f1, round(fpr,6) AS fpr FROM r ORDER BY fpr<0.25 DESC, CASE WHEN fpr<0.25 THEN -f1 ELSE fpr END, threshold LIMIT 1")
def ml6(s, d):
    return evaluate.conservative(evaluate.sweep(w.scored(s, d), 1000, 9000, 100), 0.25).select("threshold", F.round("f1", 6).alias("f1"), F.round("fpr", 6).alias("fpr"))


@query("ml7_roc_auc", f"WITH {w.SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0 AS r FROM scored), a AS (SELECT sum(r) FILTER (y=1) AS s, count(*) FILTER (y=1) AS p, count(*) FILTER (y=0) AS n FROM r) SELECT round((s-p*(p+1)/2)/(p*n),9) AS auc FROM a")
def ml7(s, d):
    return evaluate.roc_auc(w.scored(s, d)).select(F.round("auc", 9).alias("auc"))


@query("ml8_pr_curve", f"WITH {w.SCORED}, c AS (SELECT p, count(*) FILTER (y=1) AS a, count(*) FILTER (y=0) AS b FROM scored GROUP BY 1), x AS (SELECT p, sum(a) OVER (ORDER BY p DESC) AS tp, sum(b) OVER (ORDER BY p DESC) AS fp, sum(a) OVER () AS t FROM c) SELECT p AS threshold, round(tp/(tp+fp),6) AS precision, round(tp/t,6) AS recall FROM x")
def ml8(s, d):
    return evaluate.pr_curve(w.scored(s, d)).select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("ml8_average_precision", f"WITH {w.SCORED}, c AS (SELECT p, count(*) FILTER (y=1) AS a, count(*) FILTER (y=0) AS b FROM scored GROUP BY 1), x AS (SELECT a, sum(a) OVER (ORDER BY p DESC) AS tp, sum(b) OVER (ORDER BY p DESC) AS fp, sum(a) OVER () AS t FROM c) SELECT round(sum(tp/(tp+fp)*a/t),9) AS average_precision FROM x")
def ml8b(s, d):
    return evaluate.average_precision(w.scored(s, d)).select(F.round("average_precision", 9).alias("average_precision"))


@query("ml9_blend_search", f"WITH {w.SCORED}, w AS (SELECT unnest(range(50,101,5)) AS w), m AS (SELECT w, y, p*(w/100)+q*(1-w/100) AS p FROM scored, w), t AS (SELECT unnest(range(500,9500,100)) AS t), c AS (SELECT w, t/10000 AS threshold, count(*) FILTER (floor((p*10000-500)/100+1e-9)>=(t-500)/100 AND y=1) AS tp, count(*) FILTER (floor((p*10000-500)/100+1e-9)>=(t-500)/100 AND y=0) AS fp, count(*) FILTER (y=1) AS pos FROM m, t GROUP BY 1,2), f AS (SELECT w, threshold, 2*tp/(tp+fp+pos) AS f1 FROM c) SELECT w/100 AS weight, threshold, round(f1,6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY w ORDER BY round(f1,12) DESC, threshold)=1")
def ml9(s, d):
    return evaluate.blend(w.scored(s, d).select("y", F.col("p").alias("p1"), F.col("q").alias("p2")), list(range(50, 101, 5)), 500, 9400, 100).select("weight", "threshold", F.round("f1", 6).alias("f1"))


@query("ml10_fbeta_sweep", f"{SWEEP} SELECT threshold, round(coalesce(6*tp/nullif(6*tp+5*fn+fp,0),0),6) AS fbeta FROM r")
def ml10(s, d):
    return evaluate.sweep(w.scored(s, d), 1000, 9000, 100, beta2=5.0).select("threshold", F.round("f1", 6).alias("fbeta"))


@query("ml11_cost_gradient", f"WITH {w.SCORED} SELECT doc_id, round(CASE WHEN y=1 THEN 5 ELSE 1 END*(p-(y*0.99+0.005)),6) AS g, round(CASE WHEN y=1 THEN 5 ELSE 1 END*p*(1-p),6) AS h FROM scored")
def ml11(s, d):
    g, h = ml.cost_gradient(F.col("p"), F.col("y"), 5)
    return w.scored(s, d).select("doc_id", F.round(g, 6).alias("g"), F.round(h, 6).alias("h"))


@query("ml11_cost_sensitive_training")
def ml11b(s, d):
    """Out-of-fold scores of trees grown on the cost gradient."""
    return boosting.out_of_fold(_partly(s, d), "user_id", "label", FEATURES, boosting.Setting(boosting.CostSensitive(5.0), trees=60, depth=5, step=0.05, patience=10))[0]


@query("ml12_isotonic_calibration", f"""
WITH {w.SCORED}, g AS (SELECT p, sum(y) AS s, count(*) AS n, row_number() OVER (ORDER BY p) AS i FROM scored GROUP BY p),
c AS (SELECT i, p, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn FROM g),
m AS (SELECT a.i AS j, b.i AS k, (b.cs-coalesce(z.cs,0))/(b.cn-coalesce(z.cn,0)) AS mean FROM c a JOIN c b ON b.i>=a.i LEFT JOIN c z ON z.i=a.i-1),
l AS (SELECT j, k, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS least FROM m),
f AS (SELECT k AS i, max(least) AS fit FROM l GROUP BY k)
SELECT round(avg((scored.p-y)*(scored.p-y)),6) AS before, round(avg((fit-y)*(fit-y)),6) AS after FROM scored JOIN c ON c.p=scored.p JOIN f USING(i)""")
def ml12(s, d):
    """The isotonic fit is, at each score, the greatest over starts before it of the least mean over ends behind it, as the SQL says."""
    c = ml.calibrate(w.scored(s, d))
    return c.agg(F.round(ml.brier(c, "p"), 6).alias("before"), F.round(ml.brier(c, "calibrated"), 6).alias("after"))


def _draw(k: int) -> str:
    return f"(('0x'||substr(md5(user_id||'/combined/{k}/7'),1,8))::BIGINT / 4294967296.0::DOUBLE)"


def _clip(name: str, x: str) -> str:
    low, high = risk.BOUNDS[name]
    return f"round(greatest({low}::DOUBLE, least({high}::DOUBLE, {x})), 6) AS {name}"


PERTURBED = f"""
WITH {w.SCORED}, t AS (
  SELECT doc_id AS user_id, y AS label, p + y*0.4::DOUBLE AS r, q*10 AS i, ((doc_id*61)%97)/97.0::DOUBLE AS night, q*1000 AS v, (doc_id%5)::DOUBLE AS h
  FROM scored)
SELECT user_id, label, {_clip('min_retention_minutes', f"r + 20 + {_draw(1)}*160*0.5")}, {_clip('unique_ip_count', "greatest(1.0, i*0.5)")},
  {_clip('night_tx_ratio', f"night + sqrt(-2*ln({_draw(8)} + 1e-12))*cos(6.283185307179586*{_draw(9)})*0.1*0.5")},
  {_clip('total_twd_volume', f"v*(1-(0.05+{_draw(2)}*0.45*0.5))")}, {_clip('min_hops_to_blacklist', f"h + ceil({_draw(3)}*3*0.5)")}
FROM t"""


@query("ml13_perturbations", PERTURBED)
def ml13(s, d):
    out = ml.perturbed(_table(s, d), "combined", 0.5)
    return out.select("user_id", "label", *[F.round(c, 6).alias(c) for c in FEATURES])


@query("ml14_robustness")
def ml14(s, d):
    return ml.robustness(_table(s, d), "label", FEATURES)


@query("ml15_importance_share")
def ml15(s, d):
    return ml.importance(_table(s, d), "label", FEATURES, trees=3)


@query("ml16_contributions", "SELECT c_custkey, CAST(1 AS INT) AS rank, CASE WHEN abs(c_acctbal)>=500 THEN 'balance' ELSE 'fixed' END AS feature, round(greatest(abs(c_acctbal),500)/(abs(c_acctbal)+500)*100,4) AS share FROM customer")
def ml16(s, d):
    pair = lambda n, v: F.struct(F.lit(n).alias("feature"), v.cast("double").alias("contribution"))
    c = table(s, d, "customer").select("c_custkey", F.array(pair("balance", F.col("c_acctbal")), pair("fixed", F.lit(-500.0))).alias("contributions"))
    return ml.ranked_contributions(c, "c_custkey", 1).select("c_custkey", "rank", "feature", F.round("share", 4).alias("share"))


@query("ml16_tree_contributions")
def ml16b(s, d):
    """The attributions of a fitted model of Spark ML: exact Shapley values."""
    t = _table(s, d)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=42).fit(ml.assembled(t, FEATURES).select(F.col("label").cast("double").alias("label"), "features"))
    return ml.ranked_contributions(ml.tree_contributions(t, "user_id", model, FEATURES), "user_id", 8)


@query("ml16_shapley")
def ml16d(s, d):
    """The attributions of the second learner: exact Shapley values of its trees."""
    t = _table(s, d)
    model = boosting.train(t, "user_id", "label", FEATURES, [boosting.Setting(trees=20, depth=5, step=0.1)])[0]
    return ml.ranked_contributions(shapley.shapley_contributions(t, "user_id", FEATURES, shapley.of_boosted(model)), "user_id", 8)


#: balance <= 0: -1; else nation <= 12: 0.5, else 2. Of 100 customers 20 go left, of the other 80 then 60.
GIVEN = shapley.Nodes([0, -1, 1, -1, -1], [0.0, 0.0, 12.0, 0.0, 0.0], [1, 0, 3, 0, 0], [2, 0, 4, 0, 0], [0.0, -1.0, 0.0, 0.5, 2.0], [100.0, 20.0, 80.0, 60.0, 20.0])


@query("ml16_shapley_of_given_tree", """
WITH w AS (SELECT c_custkey, 0.5 AS none, CASE WHEN c_acctbal<=0 THEN -1.0 ELSE 0.875 END AS b, -0.2+0.8*CASE WHEN c_nationkey<=12 THEN 0.5 ELSE 2.0 END AS n,
 CASE WHEN c_acctbal<=0 THEN -1.0 WHEN c_nationkey<=12 THEN 0.5 ELSE 2.0 END AS both_ FROM customer)
SELECT c_custkey, CAST(round(both_,6) AS DOUBLE) AS margin, CAST(round((b-none+both_-n)/2,6) AS DOUBLE) AS balance, CAST(round((n-none+both_-b)/2,6) AS DOUBLE) AS nation FROM w""")
def ml16e(s, d):
    """Shapley values of a tree that is given, so that SQL can say them: half the sum of what a feature adds alone and after the other."""
    c = shapley.shapley_contributions(table(s, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], shapley.leaves(GIVEN))
    of = lambda i: F.round(F.col("contributions")[i]["contribution"], 6)
    return c.select("c_custkey", F.round("margin", 6).alias("margin"), of(0).alias("balance"), of(1).alias("nation"))


@query("ml16_linear_contributions")
def ml16c(s, d):
    return ml.linear_contributions(_table(s, d), "user_id", "label", FEATURES, 3)


@query("ml17_registry_gate", f"WITH {w.SCORED} SELECT doc_id, CASE WHEN p>=0.9 THEN 'approve' WHEN p>=0.8 THEN 'pending' ELSE 'skip' END AS gate FROM scored")
def ml17(s, d):
    return w.scored(s, d).select("doc_id", evaluate.gate(F.col("p")).alias("gate"))


@query("ml18_implied_confusion", f"""{SWEEP}, m AS (SELECT threshold, coalesce(tp/nullif(tp+fp,0),0) AS p, coalesce(tp/nullif(tp+fn,0),0) AS r FROM r),
i AS (SELECT threshold, CAST(floor(r*1640) AS BIGINT) AS tp, p FROM m)
SELECT threshold, tp, CAST(coalesce(floor(tp/nullif(p,0)-tp),0) AS BIGINT) AS fp, 1640-tp AS fn FROM i""")
def ml18(s, d):
    """What the rates at each threshold would mean for 1,640 positives."""
    swept = evaluate.sweep(w.scored(s, d), 1000, 9000, 100)
    return swept.select("threshold", *[v.cast("long").alias(k) for k, v in evaluate.implied_confusion(F.col("precision"), F.col("recall"), F.lit(1640)).items()])


@query("ml19_class_weights", "SELECT toxic, count(*) AS n, (SELECT count(*) FILTER (toxic=0) // nullif(count(*) FILTER (toxic=1),0) // 5 FROM labels) AS vote_weight FROM labels GROUP BY 1")
def ml19(s, d):
    l = table(s, d, "labels")
    r = l.agg(F.floor(F.floor(F.try_divide(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1))) / 5).alias("vote_weight"))
    return l.groupBy("toxic").agg(F.count("*").alias("n")).join(F.broadcast(r))  # one row


@query("ml20_hyperparameters")
def ml20(s, d):
    return ml.tuned(_table(s, d), "label", FEATURES, trees=3)


@query("ml20_bayesian_search")
def ml20b(s, d):
    """Twenty trials in rounds of four, each in five folds, with the reference's trees, patience and ranges."""
    return tuning.tuned(_table(s, d), "user_id", "label", FEATURES, boosting.Setting(trees=500, patience=30), trials=20, parallel=4, k=5)


@query("ml21_retrain_gate", "SELECT count(*) FILTER (quality=0) AS false_positives, count(*) FILTER (quality=0)>=50 AS retrain FROM labels")
def ml21(s, d):
    return ml.retrain_due(table(s, d, "labels").select(F.when(F.col("quality") == 0, "FALSE_POSITIVE").otherwise("CONFIRMED").alias("verdict")))


@query("ml_stratified_balance", "SELECT toxic, count(*) AS n FROM labels GROUP BY 1")
def stratified(s, d):
    return folds(table(s, d, "labels"), "doc_id", "toxic", 5).where("fold BETWEEN 0 AND 4").groupBy("toxic").agg(F.count("*").alias("n"))
