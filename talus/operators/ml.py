"""Training, calibration and robustness on Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.risk import clipped
from talus.operators import evaluate, graph, shapley
from talus.operators.events import folds
from talus.runtime import stage


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    cast = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f_{c}") for c in features])
    return VectorAssembler(inputCols=[f"__f_{c}" for c in features], outputCol="features").transform(cast).drop(*[f"__f_{c}" for c in features])


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive, four decimals."""
    return df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).withColumn("scale_pos_weight", F.round(F.try_divide(F.col("neg"), F.col("pos")), 4))


def weighted(df: DataFrame, label: str, weight: float) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(1.0))


def out_of_fold(df: DataFrame, key: str, label: str, features: list[str], k: int = 5, weight: float = 1.0, trees: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """(key, fold, y, p): each labelled row scored by the model that didn't see its fold.

    Rows without a label are scored by the mean of all folds' models; their fold and y are null.
    """
    dealt = folds(df.where(F.col(label).isNotNull()), key, label, k, seed).unionByName(df.where(F.col(label).isNull()).withColumn("fold", F.lit(None).cast("int")))
    ready = stage(weighted(assembled(dealt, features), label, weight).select(key, "fold", F.col(label).cast("double").alias("label"), "features", "weight"), "ml-folds")
    out = None
    for f in range(k):
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(ready.where(F.col("fold") != f))
        one = model.transform(ready.where((F.col("fold") == f) | F.col("fold").isNull())).select(key, "fold", F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key, "fold", "y").agg(F.avg("p").alias("p"))


def fold_graph_features(nodes: DataFrame, key: str, label: str, edges: DataFrame, k: int, max_hops: int = 3) -> DataFrame:
    """(for_fold, key, hops, listed): what the graph says of every node when a fold's labels are hidden.

    The seeds of a fold are the positives of the other folds (nodes has key, label and fold; a row
    without a label is never a seed). listed counts distinct neighbours that are seeds; hops is
    the distance to the nearest seed but oneself: a seed next to another one has 1, any other
    seed max_hops + 1, as a node that no seed reaches.
    """
    marks = nodes.where(F.col(label) == 1).select(F.col(key).alias("node"), F.col("fold").alias("own"))
    seeds = stage(marks.withColumn("for_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("own <> for_fold").select("for_fold", "node"), "fold-seeds")
    hops = graph.distances(edges, seeds, max_hops, keys=("for_fold",), written=True)
    listed = edges.join(seeds.withColumnRenamed("node", "dst"), "dst").groupBy("for_fold", F.col("src").alias("node")).agg(F.count_distinct("dst").alias("listed"))
    every = nodes.select(F.col(key).alias("node"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("for_fold"))
    joined = every.join(hops, ["for_fold", "node"], "left").join(listed, ["for_fold", "node"], "left")
    n = F.coalesce("listed", F.lit(0))
    far = F.when((F.col("hops") == 0) & (n > 0), 1).when(F.col("hops") == 0, max_hops + 1).otherwise(F.coalesce("hops", F.lit(max_hops + 1)))
    return joined.select("for_fold", F.col("node").alias(key), far.alias("hops"), n.alias("listed"))


def fold_aware(df: DataFrame, key: str, label: str, features: list[str], edges: DataFrame, k: int = 5, trees: int = 10, depth: int = 3, seed: int = 42, max_hops: int = 3) -> DataFrame:
    """out_of_fold with graph features of each fold's own seeds, so that no row's label reaches its own score.

    Rows without a label are scored by the mean of the folds' models, each with its fold's graph features.
    """
    dealt = folds(df.where(F.col(label).isNotNull()), key, label, k, seed).unionByName(df.where(F.col(label).isNull()).withColumn("fold", F.lit(None).cast("int")))
    dealt = stage(dealt, "fold-rows")
    edges = stage(edges.select("src", "dst"), "fold-edges")
    of_graph = fold_graph_features(dealt, key, label, edges, k, max_hops)
    ready = assembled(dealt.join(of_graph, key), [*features, "hops", "listed"]).select(key, "fold", "for_fold", F.col(label).cast("double").alias("label"), "features")
    ready = stage(ready, "ml-folds")
    out = None
    for f in range(k):
        rows = ready.where(F.col("for_fold") == f)
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(rows.where(F.col("fold") != f))
        one = model.transform(rows.where((F.col("fold") == f) | F.col("fold").isNull())).select(key, "fold", F.col("label").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key, "fold", "y").agg(F.avg("p").alias("p"))


def importance(df: DataFrame, label: str, features: list[str], trees: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(assembled(df, features).select(F.col(label).cast("double").alias("label"), "features"))
    rows = [(name, float(g)) for name, g in zip(features, model.featureImportances.toArray())]
    return evaluate.importance_share(df.sparkSession.createDataFrame(rows, "feature string, gain double"))


def weight_grid(df: DataFrame, key: str, label: str, features: list[str], weights: list[float], k: int = 3, **kw) -> DataFrame:
    """Composite score of each positive weight, by out-of-fold rows."""
    out = None
    for w in weights:
        scored = stage(out_of_fold(df, key, label, features, k, w, seed=0, **kw).select("p", "y"), "ml-grid")
        b, auc = evaluate.best(evaluate.sweep(scored, 500, 9400, 100)), evaluate.roc_auc(scored)
        row = b.select("f1", "accuracy", "threshold").join(F.broadcast(auc)).select(F.lit(float(w)).alias("weight"), "threshold", "f1", "accuracy", "auc")  # one row each
        row = row.withColumn("composite", evaluate.composite(F.col("auc"), F.col("f1"), F.col("accuracy")))
        out = row if out is None else out.unionByName(row)
    return out


def calibrate(scored: DataFrame) -> DataFrame:
    """(id, p, y) with calibrated: an isotonic fit of y on p."""
    data = scored.select("*", F.col("y").cast("double").alias("label"), F.col("p").alias("features"))
    model = IsotonicRegression(featuresCol="features", labelCol="label", predictionCol="calibrated").fit(data)
    return model.transform(data).drop("label", "features")


def brier(df: DataFrame, p: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col("y"), 2))


def perturbed(df: DataFrame, attack: str, strength: float, seed: int = 7) -> DataFrame:
    """Features as an attacker of that strength would leave them, within their bounds; the same on any partitioning."""
    digits = lambda k: F.substring(F.md5(F.concat_ws("/", F.col("user_id").cast("string"), F.lit(f"{attack}/{k}/{seed}")).cast("binary")), 1, 8)
    u = lambda k: F.conv(digits(k), 16, 10).cast("double") / float(1 << 32)
    gauss = F.sqrt(-2 * F.log(u(8) + 1e-12)) * F.cos(6.283185307179586 * u(9))
    changes = {
        "retention": {"min_retention_minutes": F.col("min_retention_minutes") + 20 + u(1) * 160 * strength},
        "ip": {"unique_ip_count": F.greatest(F.lit(1.0), F.col("unique_ip_count") * (1 - strength))},
        "volume": {"total_twd_volume": F.col("total_twd_volume") * (1 - (0.05 + u(2) * 0.45 * strength))},
        "hops": {"min_hops_to_blacklist": F.col("min_hops_to_blacklist") + F.ceil(u(3) * 3 * strength)},
        "noise": {"night_tx_ratio": F.col("night_tx_ratio") + gauss * 0.1 * strength},
    }
    picked = [attack] if attack != "combined" else list(changes)
    made = {c: e for a in picked for c, e in changes[a].items() if c in df.columns}
    return clipped(df.withColumns(made))


ATTACKS, STRENGTHS = ("retention", "ip", "volume", "hops", "combined"), (0.2, 0.5, 0.8)


def decay_grade(decay: Column) -> Column:
    return F.when(decay < 0.05, "A").when(decay < 0.15, "B").when(decay < 0.30, "C").otherwise("D")


def robustness(df: DataFrame, label: str, features: list[str], threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """Recall under each attack and strength against the recall without."""
    spark = df.sparkSession
    train = assembled(df, features).select(F.col(label).cast("double").alias("label"), "features")
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=seed).fit(train)

    def recall(rows: DataFrame) -> DataFrame:
        p = model.transform(assembled(rows, features)).select(F.col(label).alias("y"), vector_to_array("probability")[1].alias("p"))
        return p.agg(evaluate.safe(F.count_if((F.col("p") >= threshold) & (F.col("y") == 1)), F.count_if(F.col("y") == 1)).alias("recall"))

    base = recall(df).first()["recall"]
    out = None
    for attack in ATTACKS:
        for strength in STRENGTHS:
            one = recall(perturbed(df, attack, strength)).select(F.lit(attack).alias("attack"), F.lit(strength).alias("strength"), "recall")
            out = one if out is None else out.unionByName(one)
    decay = F.lit(float(base)) - F.col("recall")
    return out.withColumn("decay", decay).withColumn("grade", decay_grade(decay)) if base is not None else spark.createDataFrame([], "attack string, strength double, recall double, decay double, grade string")


def linear_contributions(df: DataFrame, key: str, label: str, features: list[str], n: int = 8) -> DataFrame:
    """The n greatest contributions of each row by a linear model: feature, value, share and direction."""
    ready = assembled(df, features)
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(ready).transform(ready)
    model = LogisticRegression(featuresCol="z", labelCol="label", regParam=0.01, maxIter=20).fit(scaled.withColumn("label", F.col(label).cast("double")))
    coefficients = [float(c) for c in model.coefficients]
    z = vector_to_array("z")
    each = [F.struct(F.lit(name).alias("feature"), (z[i] * c).alias("contribution")) for i, (name, c) in enumerate(zip(features, coefficients))]
    return ranked_contributions(scaled.select(key, F.array(*each).alias("contributions")), key, n)


def tree_contributions(df: DataFrame, key: str, model: GBTClassificationModel, features: list[str]) -> DataFrame:
    """(key, margin, base, contributions): the boosted trees' margin, and the Shapley value that each feature adds to base."""
    return shapley.shapley_contributions(df, key, features, shapley.of_spark(model))


def ranked_contributions(df: DataFrame, key: str, n: int = 8) -> DataFrame:
    """Of an array of (feature, contribution), the n greatest by amount: rank, share in percent, direction."""
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + F.abs(x["contribution"]))
    keyed = F.transform("contributions", lambda x: F.struct((-F.abs(x["contribution"])).alias("o"), x["feature"].alias("feature"), x["contribution"].alias("contribution")))
    top = df.select(key, total.alias("total"), F.posexplode(F.slice(F.array_sort(keyed), 1, n)).alias("pos", "c"))
    share = F.coalesce(F.try_divide(F.abs("c.contribution"), F.nullif("total", F.lit(0.0))), F.lit(0.0)) * 100
    return top.select(key, (F.col("pos") + 1).alias("rank"), "c.feature", "c.contribution", share.alias("share"), F.when(F.col("c.contribution") > 0, "up").otherwise("down").alias("direction"))


def cost_gradient(p: Column, y: Column, cost: float, smoothing: float = 0.01) -> tuple[Column, Column]:
    """First and second derivative of the cost-weighted loss at probability p, with a smoothed target."""
    target = y * (1 - smoothing) + 0.5 * smoothing
    weight = F.when(y == 1, F.lit(float(cost))).otherwise(1.0)
    return weight * (p - target), weight * p * (1 - p)


def retrain_due(feedback: DataFrame, limit: int = 50) -> DataFrame:
    return feedback.agg(F.count_if(F.col("verdict") == "FALSE_POSITIVE").alias("false_positives")).withColumn("retrain", F.col("false_positives") >= limit)


def tuned(
    df: DataFrame, label: str, features: list[str], depths: tuple[int, ...] = (3, 5, 8), steps: tuple[float, ...] = (0.05, 0.3), gains: tuple[float, ...] = (0.0, 0.01), folds_: int = 3, trees: int = 10, seed: int = 42
) -> DataFrame:
    """Mean AUC of each setting of depth, step size and least gain of a split, by cross-validation."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    ready = stage(assembled(df, features).select(F.col(label).cast("double").alias("label"), "features"), "ml-tuning")
    gbt = GBTClassifier(maxIter=trees, seed=seed)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.stepSize, list(steps)).addGrid(gbt.minInfoGain, list(gains)).build()
    found = CrossValidator(estimator=gbt, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds_, parallelism=4, seed=seed).fit(ready)
    rows = [(int(g[gbt.maxDepth]), float(g[gbt.stepSize]), float(g[gbt.minInfoGain]), float(m)) for g, m in zip(grid, found.avgMetrics)]
    return df.sparkSession.createDataFrame(rows, "max_depth int, step_size double, min_gain double, auc double")
