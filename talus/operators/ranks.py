"""Ranks and running sums over all rows without a one-task window.

Rows are range-partitioned by the order and written out, so partition numbers stay what they
are; each partition is summed on its own, and the few sums before a partition are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.runtime import stage


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], group: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """df with a running sum for each entry name -> column, in the order, within the group if one is given.

    Rows that are equal in the order fall into one partition and are summed in any order among
    themselves; order by a unique column for a fixed result.
    """
    group = group or []
    keys = [F.col(c) for c in group]
    ranged = stage(df.repartitionByRange(*keys, *order).withColumn("__pid", F.spark_partition_id()), "ranked")
    per = ranged.groupBy("__pid", *group).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("__pid", *group, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    local = Window.partitionBy("__pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    here = ranged.withColumns({f"__l_{n}": F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in sums.items()})
    a, b = here.alias("a"), offsets.alias("b")
    on = F.col("a.__pid") == F.col("b.__pid")
    for c in group:
        on = on & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return a.join(b, on).select(*[F.col(f"a.`{c}`") for c in df.columns], *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])


def row_numbers(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with its row number from 1 in the order, within the group if one is given."""
    one = df.withColumn("__one", F.lit(1))
    return running_sums(one, order, {name: "__one"}, group).drop("__one")
