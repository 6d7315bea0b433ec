"""Discovery of new partitions: a manifest of the folders seen, compared with a listing of the file system.

Folders are listed level by level by Hadoop's file systems; only those that the manifest lacks
are read. Columns that new folders bring are merged into the schema on record, columns that are
gone from new folders stay in it and are logged, and so are folders that are gone.
"""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "run long, kind string, name string, detail string"


@dataclass
class Crawl:
    """What one run found: rows of the new folders, the schema on record, and the log (kind, name, detail)."""

    rows: DataFrame
    schema: T.StructType
    log: list[tuple[str, str, str]]


def leaf_folders(spark: SparkSession, root: str, suffix: str = ".parquet", excluded: tuple[str, ...] = ()) -> list[str]:
    """Folders below root, as paths relative to it, that hold a file with the suffix which no pattern excludes."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: list[str] = []
    open_ = [("", top)]
    while open_:
        name, path = open_.pop()
        if not system.exists(path):
            continue
        holds = False
        for child in system.listStatus(path):
            part = child.getPath().getName()
            if part[0] in "._" and "=" not in part:
                continue
            inner = f"{name}/{part}" if name else part
            if child.isDirectory():
                open_.append((inner, child.getPath()))
            elif part.endswith(suffix) and not any(fnmatch.fnmatch(inner, p) for p in excluded):
                holds = True
        if holds:
            out.append(name)
    return sorted(out)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run, kind, name, detail): the folders, columns and events that were recorded."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def _merged(known: T.StructType, found: T.StructType) -> tuple[T.StructType, list[tuple[str, str, str]]]:
    """known with found's new columns added, and what is to be logged."""
    log: list[tuple[str, str, str]] = []
    fields = {f.name: f for f in known.fields}
    for f in found.fields:
        if f.name not in fields:
            fields[f.name] = f
            log.append(("column", f.name, f.dataType.simpleString()))
        elif fields[f.name].dataType != f.dataType:
            log.append(("conflict", f.name, f"{fields[f.name].dataType.simpleString()} on record, {f.dataType.simpleString()} found"))
    names = {f.name for f in found.fields}
    log += [("absent", f.name, "not in the new folders") for f in known.fields if f.name not in names]
    return T.StructType(list(fields.values())), log


def crawl(spark: SparkSession, root: str, state: str, excluded: tuple[str, ...] = ("*.csv", "*/_schema.json")) -> Crawl:
    """Read the folders below root that the manifest at `state` lacks, and record them.

    The manifest is appended to in one write after the folders were opened, so a run that fails
    before it finds the same folders again. A column whose type differs from the one on record is
    logged and read as the one on record where Spark can. Rows of an empty run have the schema on
    record.
    """
    seen = manifest(spark, state)
    past = seen.collect()  # a row for each folder and column, not for each file or row
    run = max((r.run for r in past), default=0) + 1
    known: set[str] = set()
    schema = T.StructType([])
    for r in sorted(past, key=lambda r: r.run):
        if r.kind == "folder":
            known.add(r.name)
        elif r.kind == "gone":
            known.discard(r.name)
        elif r.kind == "schema":
            schema = T.StructType.fromJson(json.loads(r.detail))
    there = leaf_folders(spark, root, excluded=excluded)
    fresh = [f for f in there if f not in known]
    log: list[tuple[str, str, str]] = [("folder", f, "") for f in fresh] + [("gone", f, "") for f in sorted(known - set(there))]
    if fresh:
        paths = [f"{root}/{f}" if f else root for f in fresh]
        found = spark.read.option("basePath", root).option("mergeSchema", True).parquet(*paths)
        schema, said = _merged(schema, found.schema) if schema.fields else (found.schema, [("column", f.name, f.dataType.simpleString()) for f in found.schema.fields])
        log += said
        rows = found.select(*[(F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
    else:
        rows = spark.createDataFrame([], schema)
    if log:
        log.append(("schema", root, schema.json()))
        spark.createDataFrame([(run, *row) for row in log], SCHEMA).coalesce(1).write.mode("append").parquet(state)
    return Crawl(rows, schema, log)
