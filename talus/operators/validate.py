"""Checks of submissions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def submission_problems(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """(problem, severity, n): one row per kind of problem found."""
    missing = [c for c in ("user_id", "status") if c not in submitted.columns]
    if missing:
        return submitted.sparkSession.createDataFrame([(f"missing column {c}", "error", 1) for c in missing], "problem string, severity string, n long")
    checks = [
        ("duplicate id", "error", submitted.groupBy("user_id").count().where("count > 1")),
        ("status outside 0 and 1", "error", submitted.where("status IS NULL OR status NOT IN (0, 1)")),
        ("missing id", "error", expected.select("user_id").distinct().join(submitted, "user_id", "left_anti")),
        ("extra id", "warning", submitted.select("user_id").distinct().join(expected, "user_id", "left_anti")),
    ]
    out = None
    for name, severity, rows in checks:
        one = rows.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("problem"), F.lit(severity).alias("severity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def tables_present(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(name, present) by whether Spark can open the table's folder or file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{n}.parquet")
        rows.append((n, bool(p.getFileSystem(conf).exists(p))))
    return spark.createDataFrame(rows, "name string, present boolean")


def flag_rate(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(flag) == 1).alias("flagged")).withColumn("rate", F.coalesce(F.try_divide(F.col("flagged"), F.col("total")), F.lit(0.0)))


def id_difference(expected: DataFrame, got: DataFrame) -> DataFrame:
    a, b = expected.select("user_id").distinct(), got.select("user_id").distinct()
    return a.join(b, "user_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "user_id", "left_anti").withColumn("side", F.lit("extra")))


def errors(scored: DataFrame, threshold: float) -> DataFrame:
    """The false positives and false negatives of (id, p, y)."""
    hit = F.col("p") >= threshold
    kind = F.when(hit & (F.col("y") == 0), "FP").when(~hit & (F.col("y") == 1), "FN")
    return scored.withColumn("kind", kind).where("kind IS NOT NULL")
