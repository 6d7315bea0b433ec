"""The corpus pipeline: STAGES run in order, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import mixing, neardup, packing, quality, tokens, toxicity
from talus.llm.text import packed
from talus.runtime import stage, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts have the score of no words and stay; repeated rows are judged one by
    one; a null id trains nothing; long texts are read whole; an empty table stays empty; all
    columns are kept, also such as are named like the operator's own.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule or are depleted go; the others lose their host's common lines.

    Null, empty and short texts fail; repeated rows stay or go together; a null source is a host
    of its own, a null id a value; long texts are read whole; an empty table stays empty; all
    columns are kept.
    """
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 or more) stays: the smallest id.

    Texts without words and rows without an id link with nothing and stay; of rows that repeat
    an id one stays, the first by the hash of its text; long texts are read whole; an empty
    table stays empty; all columns are kept.
    """
    groups = neardup.near_duplicates(docs)
    gone = groups.where("NOT kept").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = stage(groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "pipeline-repeated")
    if again.isEmpty():
        return rest
    # rows that repeat an id are one group: the first by the text's hash stays, found by partial sums
    repeated = rest.join(again, "doc_id", "left_semi").select(packed(docs).alias("row"))
    one = repeated.groupBy("row.doc_id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    kept = one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to their source's rate and shuffled.

    A null source is one of its own; null ids and texts count as values; repeated rows are
    repeated alike; long texts are moved whole; an empty table stays empty; all columns are kept.
    """
    return mixing.mix(docs, copy_column=None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences: the last stage, with columns of its own.

    Null and empty texts are one end id; repeated rows are packed one by one; a null id stays
    null; only texts longer than a sequence are cut; an empty table gives no pieces; other
    columns are ignored.
    """
    return packing.pack(docs, tokens.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Learned scores and byte-pair encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
