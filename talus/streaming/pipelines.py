"""Structured Streaming pipelines: file triggers, keyed upserts, windows, sessions and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talus.operators.events import latest
from talus.runtime import drop_path, new_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    """New files of a folder as they come, a bounded number at a time."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def drained(query) -> None:
    """Wait until a running query has taken up all that its source has, then stop it."""
    query.processAllAvailable()
    query.stop()


def run_to_table(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over what is there and give the written rows."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:  # each batch replaces what the sink shows
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upsert_latest(stream: DataFrame, key: str, *order: str, path: str | None = None, checkpoint: str | None = None, buckets: int = 16) -> DataFrame:
    """Keep the latest row per key over all batches, in a table below path that later calls take up again.

    The table is dealt into buckets by a hash of the key. A batch merges and writes only the
    buckets that it touches, as bucket=b/batch=n; the newest batch of a bucket holds it whole, so
    a batch that runs again writes the same. Which batches there are is read from storage, so a
    stopped job goes on where its checkpoint and its table say. A bucket's batches but its last two
    are deleted when the run is over: no batch needs them again, and a frame that an earlier run
    gave can be read until the run after the next.
    """
    spark = stream.sparkSession
    base, checkpoint = path or new_path(spark, "latest"), checkpoint or new_path(spark, "latest-checkpoint")
    schema = stream.schema

    def newest(before: int | None = None) -> list[str]:
        """The folders of the buckets' newest batches: as many as there are buckets."""
        found: dict[int, int] = {}
        for bucket, number in _batches_of(spark, base):
            if before is None or number < before:
                found[bucket] = max(number, found.get(bucket, -1))
        return [f"{base}/bucket={b}/batch={n}" for b, n in sorted(found.items())]

    def merge(batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
        rows = batch.withColumn("bucket", part)
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # `buckets` values at most
        old = [p for p in newest(number) if int(p.split("bucket=")[1].split("/")[0]) in touched]
        if old:
            rows = rows.unionByName(spark.read.schema(schema).parquet(*old).withColumn("bucket", part))
        out = latest(rows, key, *order).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(base)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    by_bucket: dict[int, list[int]] = {}
    for bucket, number in _batches_of(spark, base):
        by_bucket.setdefault(bucket, []).append(number)
    for bucket, numbers in by_bucket.items():
        for number in sorted(numbers)[:-2]:
            drop_path(spark, f"{base}/bucket={bucket}/batch={number}")
    paths = newest()
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _batches_of(spark: SparkSession, base: str) -> list[tuple[int, int]]:
    """The (bucket, batch) folders below base that hold files."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for folder in system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/bucket=*/batch=*")) or []:
        bucket, batch = folder.getPath().toString().rsplit("/", 2)[1:]
        out.append((int(bucket.removeprefix("bucket=")), int(batch.removeprefix("batch="))))
    return out


def tumbling(stream: DataFrame, ts: str, width: str, delay: str, *by: str) -> DataFrame:
    w = F.window(F.col(ts), width)
    return stream.withWatermark(ts, delay).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sliding(stream: DataFrame, ts: str, width: str, slide: str, delay: str, *by: str) -> DataFrame:
    w = F.window(F.col(ts), width, slide)
    return stream.withWatermark(ts, delay).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(stream: DataFrame, ts: str, gap: str, delay: str, key: str) -> DataFrame:
    w = F.session_window(F.col(ts), gap)
    return stream.withWatermark(ts, delay).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")


# The states of an incident and the actions that lead from one to the next.
TRANSITIONS = {("OPEN", "review"): "UNDER_REVIEW", ("UNDER_REVIEW", "confirm"): "CONFIRMED", ("UNDER_REVIEW", "dismiss"): "FALSE_POSITIVE", ("OPEN", "dismiss"): "FALSE_POSITIVE"}


def incident_states(actions: DataFrame, key: str = "incident_id", order: str = "seq", action: str = "action") -> DataFrame:
    """The state after each action of an incident, and whether the action was taken (409 where not).

    Works on a stream of (incident_id, seq, action); the state is kept per incident.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "OPEN"
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for seq, what in zip(rows[order], rows[action]):
            after = TRANSITIONS.get((now, what))
            out.append((k[0], int(seq), what, after or now, 200 if after else 409))
            now = after or now
        state.update((now,))
        yield pd.DataFrame(out, columns=["incident_id", "seq", "action", "state", "code"])

    return actions.groupBy(key).applyInPandasWithState(step, "incident_id long, seq long, action string, state string, code int", "state string", "append", GroupStateTimeout.NoTimeout)


def error_alert(df: DataFrame, failed, limit: float = 0.20) -> DataFrame:
    """total, failed, rate and whether the rate calls for an alert."""
    rate = F.coalesce(F.try_divide(F.col("failed"), F.col("total")), F.lit(0.0))
    return df.agg(F.count("*").alias("total"), F.count_if(failed).alias("failed")).withColumn("rate", rate).withColumn("alert", rate >= limit)


def within_ttl(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """Rows that haven't expired at as_of, to the microsecond."""
    return df.where(F.unix_micros(F.col(ts).cast("timestamp")) + F.lit(days * 86_400_000_000) > F.unix_micros(as_of))


def paced(calls: DataFrame, key: str, ts: str, *ties: str, least: float = 1.1) -> DataFrame:
    """calls with wait: the seconds that a call waits so that at least `least` lie between it and the key's call before."""
    from talus.operators.events import gaps

    return gaps(calls, key, ts, *ties).withColumn("wait", F.coalesce(F.greatest(F.lit(0.0), F.lit(least) - F.col("gap_seconds")), F.lit(0.0))).drop("gap_seconds")


def backoff(attempt: Column, base: float = 1.0, cap: float = 30.0, share: float = 0.0) -> Column:
    """Exponential waits up to the cap, lengthened by a share (0 to 1) of themselves."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt)) * (1 + share)
