"""A keyed store as a Spark sink and source: each key once, whatever tasks are repeated.

format("talus_keyed"), option path (a folder that the driver and the executors share) and key.
A task writes its rows into files of its own attempt, dealt out by a hash of the key; a file is
seen only once the commit of its write names it, so a task that failed, ran twice or lost its
executor leaves nothing behind. A commit is one small file with the write's number; committing a
batch again replaces its own file. Of rows with one key the last write wins, in a write the
greatest (order, row) if option order is given.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a file at most.
FILE_ROWS = 1_000_000


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class _Files:
    """What the batch and the streaming writer share."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.key = options["path"].rstrip("/"), options["key"]
        if self.key not in schema.names:
            raise ValueError(f"no column {self.key}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One task attempt's files; they count only if a commit names them."""
        system, base = _open(self.path)
        context = TaskContext.get()
        name = f"{context.partitionId() if context else 0}-{context.attemptNumber() if context else 0}-{uuid.uuid4().hex}"
        files: list[str] = []
        total = held = 0
        writer = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None or held >= FILE_ROWS:
                    if writer is not None:
                        writer.close()
                    system.create_dir(f"{base}/data", recursive=True)
                    files.append(f"data/{name}-{len(files)}.parquet")
                    writer, held = pq.ParquetWriter(f"{base}/{files[-1]}", batch.schema, filesystem=system, compression="zstd"), 0
                writer.write_batch(batch)
                held += batch.num_rows
                total += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(files, total)

    def publish(self, messages: list, number: str) -> None:
        """Name the files of a write in one file, moved into place at once."""
        system, base = _open(self.path)
        system.create_dir(f"{base}/commits", recursive=True)
        found = [m for m in messages if m is not None]
        body = json.dumps({"files": [f for m in found for f in m.files], "rows": sum(m.rows for m in found)}).encode()
        temporary = f"{base}/commits/.{number}-{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            out.write(body)
        system.move(temporary, f"{base}/commits/{number}.json")

    def discard(self, messages: list) -> None:
        system, base = _open(self.path)
        for message in messages:
            for f in message.files if message is not None else []:
                system.delete_file(f"{base}/{f}")


class _Batch(DataSourceArrowWriter, _Files):
    def __init__(self, options: dict, schema: StructType):
        _Files.__init__(self, options, schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _Files.write(self, iterator)

    def commit(self, messages: list) -> None:
        system, base = _open(self.path)
        selector = fs.FileSelector(f"{base}/commits", allow_not_found=True)
        numbers = [int(os.path.basename(f.path).split("-")[1].split(".")[0]) for f in system.get_file_info(selector) if os.path.basename(f.path).startswith("batch-")]
        self.publish(messages, f"batch-{max(numbers, default=0) + 1:012d}")

    def abort(self, messages: list) -> None:
        self.discard(messages)


class _Stream(DataSourceStreamArrowWriter, _Files):
    def __init__(self, options: dict, schema: StructType):
        _Files.__init__(self, options, schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _Files.write(self, iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.publish(messages, f"stream-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.discard(messages)


class KeyedSink(DataSource):
    """format("talus_keyed"): options path and key."""

    @classmethod
    def name(cls) -> str:
        return "talus_keyed"

    def writer(self, schema: StructType, overwrite: bool) -> _Batch:
        if overwrite:
            raise ValueError("a keyed store is only added to")
        return _Batch(dict(self.options), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Stream:  # noqa: N802
        return _Stream(dict(self.options), schema)


def commits(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(number, files) of the writes that were committed, in order: batches first, then a stream's."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/commits/*.json")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for found in system.globStatus(at) or []:
        text = spark.read.text(found.getPath().toString(), wholetext=True).first()[0]
        out.append((found.getPath().getName().removesuffix(".json"), json.loads(text)["files"]))
    return sorted(out)


def read_keyed(spark: SparkSession, path: str, key: str, schema: StructType | str, order: str | None = None) -> DataFrame:
    """Each key's row of the last write that has it."""
    path, done = path.rstrip("/"), commits(spark, path)
    parts = [(i, f) for i, (_, files) in enumerate(done) for f in files]
    if not parts:
        return spark.createDataFrame([], schema)
    # the write of a file, by its name: as many rows as files
    number = spark.createDataFrame([(f.split("/")[-1], i) for i, f in parts], "__file string, __write int")
    rows = spark.read.schema(schema).parquet(*[f"{path}/{f}" for _, f in parts]).withColumn("__file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    latest = Window.partitionBy(key).orderBy(F.desc("__write"), *([F.desc(order)] if order else []))
    ranked = rows.join(number, "__file").withColumn("__rn", F.row_number().over(latest)).where("__rn = 1")
    return ranked.drop("__file", "__write", "__rn")
