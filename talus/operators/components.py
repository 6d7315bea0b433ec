"""Connected components by repeated contraction: hook to the smallest neighbour, jump, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.runtime import stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that is not the smallest of its component.

    component is the smallest id that the node reaches. Callers take a node that is absent as
    its own component. Every round hooks each node to its smallest smaller neighbour, flattens
    the resulting forest by pointer jumping and contracts the edges; at least half of the nodes
    that still have edges vanish in a round. All state lives in written tables.
    Null ends and self-loops are ignored; repeated edges count once.
    """
    a, b = F.least(src, dst), F.greatest(src, dst)
    links = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    graph = stage(links.select(a.alias("a"), b.alias("b")).distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while not graph.isEmpty():
        parent = stage(graph.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "cc-hook")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = stage(
                parent.join(up, "root", "left").select(
                    "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")
                ),
                "cc-jump",
            )
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        maps.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        ends = graph.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")
        )
        graph = stage(
            ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "cc-edges",
        )
    if not maps:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[-1]
    for earlier in reversed(maps[:-1]):
        above = found.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = earlier.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(found)
    return found.select("node", F.col("root").alias("component"))
