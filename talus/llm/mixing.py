"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.text import packed
from talus.runtime import stage

#: Steps of the inversion; the rate of one draw is at most MAX_RATE, whose tail beyond the steps is below 1e-15.
STEPS, MAX_RATE = 64, 16.0


def uniform(*of, seed: int) -> Column:
    """A number in (0, 1) that the columns and the seed fix."""
    h = F.xxhash64(*of, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))
    return (h.cast("double") + 0.5) / float(1 << 52)


def poisson(u: Column, rate: Column) -> Column:
    """The number k with P(N < k) <= u < P(N <= k) for N of Poisson(rate), rate up to MAX_RATE."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def step(acc, i):
        p = acc["p"] * rate / i
        return F.when(u < acc["c"], acc).otherwise(F.struct((acc["k"] + 1).alias("k"), p.alias("p"), (acc["c"] + p).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["k"]


def copies_of(*of: Column, rate: Column, seed: int) -> Column:
    """A number of Poisson(rate), of any rate: the sum of ceil(rate / MAX_RATE) independent draws of equal rates."""
    draws = F.greatest(F.lit(1), F.ceil(rate / MAX_RATE).cast("int"))
    part = rate / draws
    first = poisson(uniform(*of, seed=seed), part)
    more = F.aggregate(F.sequence(F.lit(2), draws), F.lit(0), lambda n, j: n + poisson(uniform(*of, j, seed=seed), part))
    return F.when(draws > 1, first + more).otherwise(first)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7) -> DataFrame:
    """(source, n, rate): how often a row of a source is repeated on average.

    weights maps sources to shares of the output (a source that is absent gets none); without
    them a source's share is its number of rows to the power `temperature`. The output has as
    many rows as the input on average, however large the rates (none if no source has a share).
    A null source is a source of its own.
    """
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    shares = stage(counts.withColumn("share", share), "mix-sources")
    total = shares.agg(F.sum("n").alias("rows"), F.sum("share").alias("shares")).first()
    per_share = F.lit(float(total.rows / total.shares if total.shares else 0.0))
    return shares.select("source", "n", (F.col("share") * per_share / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, seed: int = 7, copy_column: str | None = "copy") -> DataFrame:
    """Every row of docs as often as its Poisson count says, shuffled over all partitions.

    All columns of docs stay; copy_column, if given, numbers a row's copies from 0 (and
    replaces a column of that name). Counts depend on the id, the text and the seed only, so a
    re-run task gives the same rows. Repeated rows are repeated alike. Null ids and texts count
    as values; texts, however long, are moved whole; an empty table gives an empty one.
    """
    columns = docs.columns
    rows = docs.select(packed(docs).alias("row"))
    d, r = rows.alias("d"), rates(docs, weights, temperature).alias("r")
    doc_id, text, source = (F.col(f"d.row.{c}") for c in ("doc_id", "text", "source"))
    k = copies_of(doc_id, F.xxhash64(text), rate=F.col("r.rate"), seed=seed)
    joined = d.join(r, source.cast("string").eqNullSafe(F.col("r.source")))
    counted = joined.select("d.row", k.alias("k"), F.xxhash64(doc_id, text, F.lit(seed)).alias("h")).where("k > 0")
    copies = counted.select("row", "h", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("copy"))
    shuffled = copies.withColumn("key", F.xxhash64("h", "copy", F.lit(seed + 1))).repartition("key").sortWithinPartitions("key")
    kept = [F.col(f"row.`{c}`").alias(c) for c in columns if c != copy_column]
    return shuffled.select(*kept, *([F.col("copy").alias(copy_column)] if copy_column else []))
