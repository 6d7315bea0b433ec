"""Sinks: partitioned and size-bounded Parquet, CSV for training and submission, keyed puts, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.functions.clean import encode_values


def partitioned(df: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*columns).parquet(path)


def bounded_parts(df: DataFrame, path: str, rows: int = 500_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def dual(df: DataFrame, path: str) -> str:
    """Parquet and CSV side by side; gives the schema as JSON, which is also written as text."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    schema = df.schema.json()
    df.sparkSession.range(1).select(F.lit(schema).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    return schema


def training_csv(df: DataFrame, path: str, label: str, features: list[str]) -> None:
    """Headerless, label first."""
    df.select(label, *features).write.mode("overwrite").csv(path, header=False)


def submission(df: DataFrame, path: str, columns: tuple[str, ...] = ("user_id", "status")) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def action_queue(df: DataFrame, path: str) -> None:
    """Automatic actions by priority, as JSON lines."""
    df.where("auto_executable").orderBy("execution_priority", "user_id").write.mode("overwrite").json(path)


def put_rows(df: DataFrame, put: Callable[[dict[str, str]], None]) -> DataFrame:
    """Send every row, as texts, to a keyed store; gives (ok, n) counts. An error of a row is counted, not raised.

    put is pickled to the executors and must be safe to repeat: a lost task sends its rows again.
    """
    encoded = encode_values(df)
    names = encoded.columns

    def run(batches: Iterable) -> Iterable:
        import pyarrow as pa

        good = bad = 0
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    put(row)
                    good += 1
                except Exception:  # noqa: BLE001
                    bad += 1
        yield pa.RecordBatch.from_pydict({"ok": [True, False], "n": pa.array([good, bad], pa.int64())})

    return encoded.select(*names).mapInArrow(run, "ok boolean, n long").groupBy("ok").agg(F.sum("n").alias("n"))


def create_table_as(spark, name: str, path: str, query: str, fmt: str = "parquet") -> str:
    """A catalog table over `path` from a query, by CREATE TABLE AS SELECT; a table of that name is replaced. Gives the name."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING {fmt} OPTIONS (compression 'snappy') LOCATION '{path}' AS {query}")
    return name


def with_fallback(df: DataFrame, path: str, fallback: str) -> str:
    """Write Parquet to path; where that place can't be written, CSV to the fallback. Gives the place written.

    Only the place is tried: a query that fails raises and isn't run again.
    """
    if can_write(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
        return path
    df.write.mode("overwrite").option("header", True).csv(fallback)
    return fallback


def can_write(spark, path: str) -> bool:
    """Whether a folder beside the path can be made and deleted, by whatever file system it names."""
    from py4j.protocol import Py4JJavaError

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    try:
        probe = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-probe-{uuid.uuid4().hex}")
        system = probe.getFileSystem(conf)
        return bool(system.mkdirs(probe) and system.delete(probe, True))
    except Py4JJavaError:
        return False


def mark_done(spark, path: str, stage_name: str, detail: str = "") -> None:
    """Add a finished stage to a state table; a write that fails leaves the table as it was."""
    spark.range(1).select(F.lit(stage_name).alias("stage"), F.lit(detail).alias("detail")).coalesce(1).write.mode("append").json(path)


def done_stages(spark, path: str) -> DataFrame:
    return spark.read.schema("stage string, detail string").json(path).groupBy("stage").agg(F.max("detail").alias("detail"))
