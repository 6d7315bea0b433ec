"""Session helpers: sessions, the shared folder, and staged (lineage-cutting) tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


SHUFFLE = "spark.sql.shuffle.partitions"

#: Rows that one task should sort or keep as its state, as far as their keys can be dealt.
TASK_ROWS = 500_000


def session(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine's results rely on (UTC, AQE)."""
    builder = SparkSession.builder.master(master).appName("talus")
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: the session's number of shuffle partitions, or more where a task would get over TASK_ROWS."""
    return max(int(spark.conf.get(SHUFFLE)), -(-rows // TASK_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    A local session without that setting gets a temporary folder of its own (the driver and
    the executors are one process there); on a cluster the setting is required.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="talus-")
    context.setCheckpointDir(made)
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/talus/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", *partition_by: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The result's lineage is the written table, so a lost executor costs a re-read and not a
    re-run of what came before.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by new_path, by whatever file system it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """Like stage, with the path, for tables that are dropped before the session ends."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
