"""Metrics of scored rows (p, y) as aggregates: no row leaves the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.ranks import running_sums


def safe(x: Column, y: Column) -> Column:
    """x / y, 0 where y is 0."""
    return F.coalesce(F.try_divide(x.cast("double"), F.nullif(y.cast("double"), F.lit(0.0))), F.lit(0.0))


def rates(cells: DataFrame, beta2: float = 1.0) -> DataFrame:
    """Precision, recall, F, FPR and accuracy of rows with tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns({
        "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe((1 + beta2) * tp, (1 + beta2) * tp + beta2 * fn + fp), "fpr": safe(fp, fp + tn), "accuracy": safe(tp + tn, tp + fp + fn + tn),
    })


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    cells = df.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    return rates(cells)


def sweep(scored: DataFrame, low: int, high: int, step: int, beta2: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion and rates at thresholds low, low+step, ..., high (in ten-thousandths), for each value of the columns `by`.

    Scores are counted once by the highest threshold that they reach, and the few threshold
    rows are summed from above; rows are not repeated per threshold.
    """
    n = (high - low) // step
    reached = F.floor((F.col("p") * 10000 - low) / step + 1e-9)
    bucket = F.greatest(F.lit(-1), F.least(F.lit(n), reached)).cast("int")
    counts = scored.groupBy(*by, bucket.alias("b")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    steps = F.explode(F.sequence(F.lit(-1), F.lit(n))).alias("b")
    grid = counts.select(*by).distinct().select(*by, steps) if by else scored.sparkSession.range(1).select(steps)
    full = grid.join(counts, [*by, "b"], "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(*by).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    cells = full.select(*by, "b", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(whole).alias("__p"), F.sum("neg").over(whole).alias("__n")).where("b >= 0")
    cells = cells.select(*by, ((F.col("b") * step + low) / 10000).alias("threshold"), "tp", "fp", (F.col("__p") - F.col("tp")).alias("fn"), (F.col("__n") - F.col("fp")).alias("tn"))
    return rates(cells, beta2)


def best(swept: DataFrame, by: str = "f1") -> DataFrame:
    """The row with the greatest value; the smallest threshold wins ties."""
    return swept.orderBy(F.desc(by), F.asc("threshold")).limit(1)


def conservative(swept: DataFrame, max_fpr: float = 0.05) -> DataFrame:
    """The best F1 below the FPR limit, else the least FPR."""
    low = F.col("fpr") < max_fpr
    return swept.orderBy(F.desc(low), F.when(low, -F.col("f1")).otherwise(F.col("fpr")), F.asc("threshold")).limit(1)


def by_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score: what AUC and curves are sums of."""
    return scored.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """The rank statistic: pairs in order plus half the ties, over all pairs; null without both classes."""
    c = running_sums(by_score(scored), [F.col("p")], {"below": "neg"}, inclusive=False)
    s = c.agg(F.sum(F.col("pos") * F.col("below") + F.col("pos") * F.col("neg") * 0.5).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(F.try_divide(F.col("u"), F.nullif((F.col("p") * F.col("n")).cast("double"), F.lit(0.0))).alias("auc"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score as the threshold."""
    c = running_sums(by_score(scored), [F.desc("p")], {"tp": "pos", "fp": "neg"})
    c = c.join(F.broadcast(c.agg(F.sum("pos").alias("all"))))  # one row
    return c.select(F.col("p").alias("threshold"), "pos", safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe(F.col("tp"), F.col("all")).alias("recall"), F.col("all").alias("positives"))


def average_precision(scored: DataFrame) -> DataFrame:
    c = pr_curve(scored)
    return c.agg(F.sum(F.col("precision") * F.col("pos") / F.col("positives")).alias("average_precision"))


def composite(auc: Column, f1: Column, accuracy: Column) -> Column:
    return 0.40 * auc + 0.35 * f1 + 0.25 * accuracy


def blend(scored: DataFrame, weights: list[int], low: int, high: int, step: int) -> DataFrame:
    """The best threshold of each blend w*p1 + (1-w)*p2, w in hundredths: one scan, a count for each (weight, threshold)."""
    w = F.col("w") / 100
    each = scored.select("y", "p1", "p2", F.explode(F.array(*[F.lit(x) for x in weights])).alias("w"))
    swept = sweep(each.select("y", "w", (F.col("p1") * w + F.col("p2") * (1 - w)).alias("p")), low, high, step, by=("w",))
    first = Window.partitionBy("w").orderBy(F.desc(F.round("f1", 12)), F.asc("threshold"))
    best_ = swept.withColumn("__rn", F.row_number().over(first)).where("__rn = 1")
    return best_.select((F.col("w") / 100).alias("weight"), "threshold", "f1", "accuracy")


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """Counts in equal bins; the last one holds its upper edge, values outside are left out."""
    bucket = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return df.where((value >= low) & (value <= high)).groupBy(*by, bucket.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def fold_summary(folds: DataFrame, value: str) -> DataFrame:
    return folds.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.5)).alias("median"))


def gate(f1: Column) -> Column:
    return F.when(f1 >= 0.90, "approve").when(f1 >= 0.80, "pending").otherwise("skip")


def implied_confusion(precision: Column, recall: Column, positives: Column) -> dict[str, Column]:
    """tp, fp, fn that published rates imply."""
    tp = F.floor(recall * positives)
    fp = F.coalesce(F.floor(F.try_divide(tp.cast("double"), F.nullif(precision, F.lit(0.0))) - tp), F.lit(0))
    return {"tp": tp, "fp": fp, "fn": positives - tp}


def importance_share(gains: DataFrame) -> DataFrame:
    total = F.sum("gain").over(Window.partitionBy())
    return gains.select("feature", "gain", safe(F.col("gain"), total).alias("share"))
