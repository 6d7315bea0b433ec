"""Ordered-stream operators: next event after, gaps, latest row per key, running state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.ranks import row_numbers
from talus.runtime import stage


def next_after(events: DataFrame, key: str, ts: str, is_start: Column, is_end: Column) -> DataFrame:
    """Each start row with next_end: the earliest end of the same key strictly later, else null.

    One sort per key in descending time; at equal times starts sort before ends, so that an end
    at the start's own time isn't in the frame. The frame only grows, so the cost is linear.
    """
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.when(is_end, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
    return events.where(is_start | is_end).withColumn("next_end", F.min(F.when(is_end, F.col(ts))).over(w)).where(is_start)


def next_after_split(events: DataFrame, key: str, ts: str, is_start: Column, is_end: Column) -> DataFrame:
    """next_after where a key may hold a large share of all rows: its rows are spread over range partitions.

    Rows are ordered by key and descending time over all partitions and written out. A partition
    carries the least end of each key that it holds; what earlier partitions carry for the key
    is the bound that its rows start from. Ends of earlier partitions at a row's own time are
    none, as starts sort before ends at equal times.
    """
    rows = events.where(is_start | is_end).withColumn("__end", F.when(is_end, F.col(ts))).withColumn("__flag", F.when(is_end, 1).otherwise(0))
    order = [F.col(ts).desc(), F.col("__flag")]
    ranged = stage(rows.repartitionByRange(F.col(key), *order).withColumn("__pid", F.spark_partition_id()), "next-after")
    local = Window.partitionBy("__pid", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.withColumn("__near", F.min("__end").over(local))
    before = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("__pid", key).agg(F.min("__end").alias("__m")).select("__pid", key, F.min("__m").over(before).alias("__carry"))
    out = here.join(carried, ["__pid", key]).withColumn("next_end", F.coalesce("__near", "__carry"))
    return out.where("__flag = 0").select(*[F.col(f"`{c}`") for c in events.columns], "next_end")


def gaps(events: DataFrame, key: str, ts: str, *ties: str) -> DataFrame:
    """gap_seconds to the key's row before, null for its first."""
    w = Window.partitionBy(key).orderBy(ts, *ties)
    return events.withColumn("gap_seconds", (_micros(F.col(ts)) - _micros(F.lag(ts).over(w))) / 1e6)


def gaps_split(events: DataFrame, key: str, ts: str, *ties: str) -> DataFrame:
    """gaps where a key may hold a large share of all rows: its rows are spread over range partitions.

    The first row of a key in a partition looks back to the last time that the partition before it
    holds of the key, which is the greatest there. Rows without a time come first, as in gaps.
    """
    ranged = stage(events.repartitionByRange(F.col(key), F.col(ts), *ties).withColumn("__pid", F.spark_partition_id()), "gaps")
    local = Window.partitionBy("__pid", key).orderBy(ts, *ties)
    here = ranged.withColumns({"__near": F.lag(ts).over(local), "__rn": F.row_number().over(local)})
    before = Window.partitionBy(key).orderBy("__pid")
    ends = ranged.groupBy("__pid", key).agg(F.max(ts).alias("__m")).select("__pid", F.col(key).alias("__key"), F.lag("__m").over(before).alias("__carry"))
    a, b = here.alias("a"), ends.alias("b")
    joined = a.join(b, (F.col("a.__pid") == F.col("b.__pid")) & F.col(f"a.`{key}`").eqNullSafe(F.col("b.__key")))
    last = F.when(F.col("__rn") == 1, F.col("b.__carry")).otherwise(F.col("__near"))
    return joined.select(*[F.col(f"a.`{c}`") for c in events.columns], ((_micros(F.col(f"a.`{ts}`")) - _micros(last)) / 1e6).alias("gap_seconds"))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


#: Rows of one key up to which they are sorted in one task.
HOT_ROWS = 1_000_000


def has_hot_key(events: DataFrame, key: str, limit: int | None = None) -> bool:
    """Whether a key has more rows than a task should sort; a count by key, combined before it is shuffled."""
    most = events.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return most > (HOT_ROWS if limit is None else limit)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The key's last row by the order columns; the last of them breaks ties."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def zscore(df: DataFrame, group: str, value: str, name: str = "zscore") -> DataFrame:
    """(value - mean) / sample deviation within the group; null for a group of one or without spread.

    Group statistics are aggregated first and joined back, so that a hot group isn't sorted.
    """
    stats = df.groupBy(group).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    joined = df.join(stats, group, "left")
    return joined.withColumn(name, F.try_divide(F.col(value) - F.col("__m"), F.nullif("__s", F.lit(0.0)))).drop("__m", "__s")


def is_night(ts: Column, last_hour: int = 6) -> Column:
    """22 to 23 or 0 up to last_hour inclusive."""
    return (F.hour(ts) >= 22) | (F.hour(ts) <= last_hour)


def shuffle_key(key: str, seed: int) -> Column:
    """An order that only the key and the seed fix: the MD5 of "seed/key", which other engines compute alike."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """A stratified fold number: rows of a label dealt out in hashed order."""
    ranked = row_numbers(df.withColumn("__h", shuffle_key(key, seed)), [F.col("__h"), F.col(key)], [label], "__rn")
    return ranked.withColumn("fold", F.pmod(F.col("__rn") - 1, F.lit(k)).cast("int")).drop("__h", "__rn")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows that come first in hashed order; the same rows on any partitioning."""
    return df.orderBy(shuffle_key(key, seed), key).limit(n)
