"""Ordered delivery with retries and dead letters, and metrics of a running stream."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from talus.runtime import new_path


class Delivery:
    """First-in, first-out delivery per group, from a stream into a table, with a dead-letter table.

    `succeeds` says of a message at its attempt (column `attempt`, from 1) whether it could be
    handled. A message that fails is tried again in the next batch and holds back its group's
    later messages until it is delivered or has failed `attempts` times; then it goes to the dead
    letters and the group goes on. What waits is a table of its own with the attempts so far.
    Once the source has no more, a message takes up to TRIES attempts in one step, so the steps
    that follow don't grow with the failures of a group.

    Batch n reads what batch n - 1 left and writes delivered/batch=n, dead/batch=n and
    pending/batch=n anew, so a batch that runs again leaves the same rows once. An order (seq)
    must be unique within its group; a null group is one of its own.
    """

    #: Attempts at a message in one step, when no more batches come.
    TRIES = 8

    def __init__(self, stream: DataFrame, group: str, seq: str, succeeds: Callable[[Column], Column], attempts: int = 2, path: str | None = None):
        self.stream, self.group, self.seq, self.succeeds, self.attempts = stream, group, seq, succeeds, attempts
        self.spark = stream.sparkSession
        self.base = path or new_path(self.spark, "delivery")
        self.columns = stream.columns

    def _read(self, table: str, *batches: int) -> DataFrame | None:
        paths = [f"{self.base}/{table}/batch={n}" for n in batches]
        schema = self.stream.withColumn("attempts", F.lit(0)).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def _batches(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.base}/pending/batch=*")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getName().removeprefix("batch=")) for f in found)

    def _tried(self, waiting: DataFrame, tries: int) -> DataFrame:
        """What waits, with the attempt it gets to (`tries` more at most, until one succeeds) and whether that is ok."""
        tried = waiting.withColumns({"attempt": F.col("attempts"), "ok": F.lit(False)})
        for _ in range(tries):
            tried = tried.withColumn("__open", ~F.col("ok") & (F.col("attempt") < self.attempts))
            tried = tried.withColumn("attempt", F.col("attempt") + F.col("__open").cast("int"))
            tried = tried.withColumn("ok", F.when(F.col("__open"), F.coalesce(self.succeeds(F.col("attempt")), F.lit(False))).otherwise(F.col("ok")))
        return tried.drop("__open")

    def _step(self, rows: DataFrame, number: int, tries: int = 1) -> None:
        """Up to `tries` attempts at what waits, in order; number names what is written."""
        before = [n for n in self._batches() if n < number]
        fresh = rows.select(*self.columns, F.lit(0).alias("attempts"))
        waiting = self._read("pending", before[-1]).unionByName(fresh) if before else fresh
        tried = self._tried(waiting, tries)
        ended = F.when(F.col("ok"), "delivered").otherwise("dead")
        if tries >= self.attempts:  # each message comes to its end, and none holds back others
            dealt = tried.select(*self.columns, F.col("attempt").cast("int").alias("attempts"), ended.alias("place"))
        else:
            dealt = self._held_back(tried, ended)
        dealt.persist()
        try:
            for table in ("delivered", "dead", "pending"):  # pending last: it marks the batch as done
                dealt.where(F.col("place") == table).drop("place").write.mode("overwrite").parquet(f"{self.base}/{table}/batch={number}")
        finally:
            dealt.unpersist()

    def _held_back(self, tried: DataFrame, ended: Column) -> DataFrame:
        # the first failure that is not the last one allowed stops its group here
        stops = ~F.col("ok") & (F.col("attempt") < self.attempts)
        first = tried.where(stops).groupBy(self.group).agg(F.min(self.seq).alias("stop"))
        a, b = tried.withColumn("__ended", ended).alias("a"), first.alias("b")
        joined = a.join(b, F.col(f"a.`{self.group}`").eqNullSafe(F.col(f"b.`{self.group}`")), "left")
        order, stop = F.col(f"a.`{self.seq}`"), F.col("b.stop")
        place = F.when(stop.isNull() | (order < stop), F.col("a.__ended")).otherwise("pending")
        used = F.when(stop.isNull() | (order <= stop), F.col("a.attempt")).otherwise(F.col("a.attempts"))
        return joined.select(*[F.col(f"a.`{c}`") for c in self.columns], used.cast("int").alias("attempts"), place.alias("place"))

    def run(self, checkpoint: str | None = None) -> "Delivery":
        """Take up what the source has, then go on until nothing waits."""
        checkpoint = checkpoint or new_path(self.spark, "delivery-checkpoint")
        # room for the attempts after a batch: they are named by the numbers behind it
        self.stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, n: self._step(rows, n << 20)).start().awaitTermination()
        while (done := self._batches()) and not self._read("pending", done[-1]).isEmpty():
            self._step(self._read("pending", done[-1]).limit(0), done[-1] + 1, min(self.attempts, self.TRIES))
        return self

    def table(self, name: str) -> DataFrame:
        """delivered, dead or pending, with attempts; delivered with position, the place within its group."""
        done = self._batches()
        if not done:
            return self.spark.createDataFrame([], self.stream.withColumn("attempts", F.lit(0)).schema)
        if name == "pending":
            return self._read(name, done[-1])
        rows = self._read(name, *done)
        if name == "delivered":
            batch = F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long")
            order = Window.partitionBy(self.group).orderBy("__batch", self.seq)
            rows = rows.withColumn("__batch", batch).withColumn("position", F.row_number().over(order)).drop("__batch")
        return rows


class Rates(StreamingQueryListener):
    """Keeps what each batch of one query observed under `name`, and calls `alert` where the rate of failures is high."""

    def __init__(self, name: str, limit: float, alert: Callable[[dict], None]):
        self.name, self.limit, self.alert = name, limit, alert
        self.rows: list[tuple] = []
        self.ended = threading.Event()
        self.query: str | None = None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None or not seen.total:
            return
        rate = seen.failed / seen.total
        row = (int(event.progress.batchId), int(seen.total), int(seen.failed), rate, rate >= self.limit)
        if row[0] not in {r[0] for r in self.rows}:  # a batch that ran again counts once
            self.rows.append(row)
            if row[-1]:
                self.alert({"batch": row[0], "total": row[1], "failed": row[2], "rate": rate})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) == self.query:
            self.ended.set()


def monitored(stream: DataFrame, failed: Column, sink: Callable[[DataFrame], object], limit: float = 0.20, alert: Callable[[dict], None] = lambda _: None, name: str = "rates") -> DataFrame:
    """Run the stream into sink (which starts a query on it) and give (batch, total, failed, rate, alert) for each batch.

    The counts are observed while the rows pass, without a second read; batches without rows give
    no row. An alert is raised while the stream goes on, as soon as its batch is done.
    """
    spark = stream.sparkSession
    rates = Rates(name, limit, alert)
    spark.streams.addListener(rates)
    try:
        query = sink(stream.observe(name, F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed")))
        rates.query = str(query.id)
        query.awaitTermination()
        rates.ended.wait(60)
    finally:
        spark.streams.removeListener(rates)
    return spark.createDataFrame(sorted(rates.rows), "batch long, total long, failed long, rate double, alert boolean")
