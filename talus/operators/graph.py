"""Transaction graphs: edges, degrees, multi-source distances, neighbour counts, assembled hop features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions.risk import hop_risk_level, weighted_label
from talus.operators.components import connected_components
from talus.runtime import stage

#: Edges of one node that a task of a frontier join gets, about.
HOT_EDGES = 100_000
#: Memberships of a block of users, and of listed ones, that are compared in one task; pairs that it holds at once, about.
BLOCK, PAIRS = 1_000_000, 4_000_000


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions, distinct, without self-loops and null ends."""
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    e = e.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return e.union(e.select("dst", "src")).distinct()


def shared_key_edges(members: DataFrame, key: str, user: str = "user_id", cap: int | None = None) -> DataFrame:
    """Edges (src < dst) between users that share a key value.

    With a cap, the cap smallest users of a key take part, so the pairs of a key are bounded.
    Without one the pairs go through the join; use bipartite() where a key may be hot, and
    key_members() with its searches where only distances and counts are asked for.
    """
    m = members.select(F.col(key).alias("k"), F.col(user).alias("u")).where("k IS NOT NULL AND u IS NOT NULL").distinct()
    if cap is None:
        return m.alias("a").join(m.alias("b"), "k").where("a.u < b.u").select(F.col("a.u").alias("src"), F.col("b.u").alias("dst")).distinct()
    # ranks up to the cap are cut within each task before the shuffle: no key's users ever meet in one row
    first = m.withColumn("__rn", F.row_number().over(Window.partitionBy("k").orderBy("u"))).where(F.col("__rn") <= cap)
    groups = first.groupBy("k").agg(F.sort_array(F.collect_list("u")).alias("us")).where(F.size("us") > 1)
    left = groups.select("us", F.explode("us").alias("src"))
    return left.select("src", F.explode("us").alias("dst")).where("src < dst").distinct()


def node_of(text: Column) -> Column:
    """A negative node id for a text: minus the first 15 hex digits of its SHA-256."""
    return -F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def bipartite(members: DataFrame, key: str, user: str = "user_id") -> DataFrame:
    """Edges between users (positive) and the nodes of their key values (negative)."""
    m = members.where(F.col(key).isNotNull() & F.col(user).isNotNull())
    return m.select(F.col(user).cast("long").alias("src"), node_of(F.col(key).cast("string")).alias("dst")).distinct()


def without_nodes(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Edges of which neither end is in excluded (node)."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(excluded.select(F.col("node").alias(end)).distinct(), end, "left_anti")
    return out.select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    """How often a node is an end of an edge."""
    one = lambda c: edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n"))
    return one("src").union(one("dst")).groupBy("node").agg(F.sum("n").alias("degree"))


def degree_tier(degree: Column, warm: int = 1000, hot: int = 10000) -> Column:
    return F.when(degree > hot, "super").when(degree > warm, "warn").otherwise("normal")


def salted(edges: DataFrame, hot: DataFrame, salts: int = 16) -> DataFrame:
    """A salt per edge: hashed for edges at a hot node (node), else 0; with a column salts in hot, each node has its own number."""
    n = F.col("salts") if "salts" in hot.columns else F.lit(salts)
    marked = edges.join(hot.select(F.col("node").alias("src"), n.cast("long").alias("__n")).distinct(), "src", "left")
    salt = F.when(F.col("__n").isNotNull(), F.pmod(F.xxhash64("src", "dst"), F.col("__n"))).otherwise(0)
    return marked.select(*edges.columns, salt.cast("int").alias("salt"))


def hot_nodes(edges: DataFrame, limit: int) -> DataFrame:
    """(node, salts): nodes at the start of more than `limit` edges, and how many parts of that size they have."""
    n = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > limit).select("node", F.ceil(F.col("n") / limit).cast("int").alias("salts"))


class Hops:
    """Written edges, salted at hot nodes, for frontier joins: no task gets more than about `limit` edges of one node."""

    def __init__(self, edges: DataFrame, limit: int = HOT_EDGES, written: bool = False):
        edges = edges.select("src", "dst") if written else stage(edges.select("src", "dst"), "edges")
        self.hot = stage(hot_nodes(edges, limit), "hot-nodes")
        self.any = not self.hot.isEmpty()
        self.edges = stage(salted(edges, self.hot), "salted-edges") if self.any else edges

    def step(self, frontier: DataFrame, ids: list[str]) -> DataFrame:
        """(ids): the distinct ends of the frontier's edges; a hot node of the frontier is repeated for its salts."""
        edges = self.edges.withColumnRenamed("src", "node")
        on = ["node"]
        if self.any:
            salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
            frontier = frontier.join(self.hot, "node", "left").select(*frontier.columns, salts.alias("salt"))
            on = ["node", "salt"]
        return frontier.join(edges, on).select(*ids[:-1], F.col("dst").alias("node")).distinct()

    def starts(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("node")).distinct()


def distances(edges: DataFrame, seeds: DataFrame, max_hops: int = 3, keep_isolated_seeds: bool = True, keys: tuple[str, ...] = (), written: bool = False, hot_edges: int = HOT_EDGES) -> DataFrame:
    """(keys..., node, hops): the least number of hops from any seed (node), up to max_hops, whatever that is.

    edges are symmetric. Each hop joins the frontier to the edges, drops what has a distance
    already and is written out, so no hop re-runs the ones before. keys (a fold, say) keep
    searches apart. Seeds without edges have distance 0 only if keep_isolated_seeds. Edges that
    are a written table already (written) are read from there, others are written out first. Nodes
    with more than hot_edges edges are dealt out by salts, and only their frontier rows repeated.
    """
    hops = Hops(edges, hot_edges, written)
    ids = [*keys, "node"]
    start = seeds.select(*ids).distinct()
    if not keep_isolated_seeds:
        start = start.join(hops.starts(), "node", "left_semi").select(*ids)
    frontier = stage(start.withColumn("hops", F.lit(0)), "hops")
    seen = frontier
    for hop in range(1, max_hops + 1):
        step = hops.step(frontier.select(*ids), ids)
        frontier = stage(step.join(seen.select(*ids), ids, "left_anti").withColumn("hops", F.lit(hop)), "hops")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def key_members(members: DataFrame, key: str, user: str = "user_id") -> DataFrame:
    """(k, node), written: the distinct users of each key value that two users share at least, by a number for the value."""
    rows = members.select(F.col(key).alias("value"), F.col(user).cast("long").alias("node")).where("value IS NOT NULL AND node IS NOT NULL")
    rows = stage(rows.distinct(), "members")
    # numbered once and written, so that every reader sees the same numbers
    shared = stage(rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value", F.monotonically_increasing_id().alias("k")), "keys")
    return stage(rows.join(shared, "value").select("k", "node"), "key-members")


def key_distances(members: DataFrame, seeds: DataFrame, max_hops: int = 3) -> DataFrame:
    """distances() over the edges between users that share a key, without the edges: from users to keys and back.

    members as key_members gives them; seeds without an edge are left out.
    """
    nodes = members.select("node").distinct()
    frontier = stage(nodes.join(seeds.select("node").distinct(), "node", "left_semi").withColumn("hops", F.lit(0)), "hops")
    seen, used = frontier, None
    for hop in range(1, max_hops + 1):
        keys = members.join(frontier.select("node"), "node", "left_semi").select("k").distinct()
        keys = stage(keys.join(used, "k", "left_anti") if used is not None else keys, "hop-keys")
        used = keys if used is None else used.unionByName(keys)
        step = members.join(keys, "k", "left_semi").select("node").distinct()
        frontier = stage(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)), "hops")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _distinct_listed(left: pa.Table, right: pa.Table) -> pa.Table:
    """(node, n): for each user of left the distinct users of right, but itself, that it shares a key with; both are (k, node)."""
    by_key = np.argsort(right["k"].to_numpy(), kind="stable")
    keys, (listed, of) = right["k"].to_numpy()[by_key], np.unique(right["node"].to_numpy()[by_key], return_inverse=True)
    by_node = np.argsort(left["node"].to_numpy(), kind="stable")
    k, users = left["k"].to_numpy()[by_node], left["node"].to_numpy()[by_node]
    low = np.searchsorted(keys, k, "left")
    many = np.searchsorted(keys, k, "right") - low
    low, many, users = low[many > 0], many[many > 0], users[many > 0]
    nodes, first = np.unique(users, return_index=True)
    upto = np.concatenate([[0], np.cumsum(many)])
    ends = np.append(first, len(users))  # rows of user i: ends[i] up to ends[i + 1]
    n, i = np.zeros(len(nodes), np.int64), 0
    while i < len(nodes):  # whole users, PAIRS pairs at once; a user has no more pairs than right has rows
        j = max(i + 1, int(np.searchsorted(upto[ends], upto[ends[i]] + PAIRS, "right")) - 1)
        a, b = ends[i], ends[j]
        at = np.arange(upto[b] - upto[a]) + np.repeat(low[a:b] - (upto[a:b] - upto[a]), many[a:b])
        user = np.repeat(np.searchsorted(nodes, users[a:b]), many[a:b])
        other = of[at]
        apart = listed[other] != nodes[user]
        pairs = np.unique((user[apart] - i) * len(listed) + other[apart])
        n[i:j] = np.bincount(pairs // max(1, len(listed)), minlength=j - i)
        i = j
    return pa.table({"node": pa.array(nodes[n > 0], pa.int64()), "n": pa.array(n[n > 0], pa.int64())})


def key_neighbour_counts(members: DataFrame, seeds: DataFrame, block: int = BLOCK) -> DataFrame:
    """neighbour_counts() over the edges between users that share a key, without the edges.

    Blocks of users meet blocks of listed users, each pair of blocks in a task that sees their
    memberships: what is moved are memberships, not pairs, and a task holds two blocks. The pairs
    of a user lie in one task for each block of listed users, so the counts add up.
    """
    listed = stage(members.join(seeds.select("node").distinct(), "node", "left_semi"), "listed-members")
    near = stage(members.join(listed.select("k").distinct(), "k", "left_semi").select("k", "node"), "near-members")
    rows, columns = (max(1, -(-t.count() // block)) for t in (near, listed))
    of = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = near.select("k", "node", of(rows).alias("i"), every(columns).alias("j"))
    right = listed.select("k", "node", of(columns).alias("j"), every(rows).alias("i"))
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_distinct_listed, "node long, n long")
    return met.groupBy("node").agg(F.sum("n").alias("n"))


def distances_unrolled(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distances up to three hops as one plan: each hop is distinct and anti-joined to the earlier ones."""
    hop = seeds.select("node").distinct()
    seen, parts = hop, [hop.withColumn("hops", F.lit(0))]
    for k in (1, 2, 3):
        hop = hop.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.union(hop)
        parts.append(hop.withColumn("hops", F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("node").agg(F.min("hops").alias("hops"))


def distances_recursive(edges: DataFrame, seeds: DataFrame, max_hops: int = 3) -> DataFrame:
    """Distances by a recursive query over walks; for sparse graphs and few hops only.

    The edges are written out first: the recursion reads them again for every hop.
    """
    spark = edges.sparkSession
    stage(edges.select("src", "dst"), "edges").createOrReplaceTempView("__talus_edges")
    seeds.select("node").distinct().createOrReplaceTempView("__talus_seeds")
    return spark.sql(f"""
        WITH RECURSIVE walk(node, hops) AS (
          SELECT node, 0 FROM __talus_seeds
          UNION ALL
          SELECT e.dst, w.hops + 1 FROM walk w JOIN __talus_edges e ON e.src = w.node WHERE w.hops < {int(max_hops)}
        ) SELECT node, CAST(min(hops) AS INT) AS hops FROM walk GROUP BY node""")


def components(edges: DataFrame, written: bool = False) -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest node. The edges are written out once, unless they are (written)."""
    edges = edges if written else stage(edges.select("src", "dst"), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(connected_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def seeded_components(edges: DataFrame, seeds: DataFrame, written: bool = False) -> DataFrame:
    """Nodes with in_network: whether their component holds a seed."""
    c = stage(components(edges, written), "components")
    hit = c.join(seeds.select("node").distinct(), "node", "left_semi").select("component", F.lit(True).alias("__hit")).distinct()
    return c.join(hit, "component", "left").select("node", "component", F.coalesce("__hit", F.lit(False)).alias("in_network"))


def neighbour_counts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct listed neighbours of each node that has one."""
    listed = seeds.select(F.col("node").alias("dst")).distinct()
    return edges.join(listed, "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("n"))


def smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("smallest"))


def relation_counts(relations: DataFrame, groups: DataFrame, seeds: DataFrame) -> DataFrame:
    """Listed neighbours counted with repeats: one per relation row and listed other end, and per
    shared group the group's listed users but oneself.

    relations (src, dst) are directed rows, repeats included; groups are (key, user_id) rows.
    """
    listed = seeds.select("node").distinct()
    both = relations.select("src", "dst").union(relations.select("dst", "src")).where("src IS NOT NULL AND dst IS NOT NULL")
    direct = both.join(listed.withColumnRenamed("node", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    members = groups.where("key IS NOT NULL AND user_id IS NOT NULL").select("key", "user_id").distinct()
    marked = members.join(listed.select(F.col("node").alias("user_id"), F.lit(1).alias("l")), "user_id", "left").withColumn("l", F.coalesce("l", F.lit(0)))
    per_key = marked.groupBy("key").agg(F.sum("l").alias("listed")).where("listed > 0")
    shared = marked.join(per_key, "key").groupBy(F.col("user_id").alias("node")).agg(F.sum(F.col("listed") - F.col("l")).alias("n"))
    return direct.union(shared).groupBy("node").agg(F.sum("n").alias("n")).where("n > 0")


def hop_features(edges: DataFrame, seeds: DataFrame, ip_features: DataFrame, max_hops: int = 3, network: str = "component") -> DataFrame:
    """The ten hop features per user: users with an edge and all seeds; key nodes (negative) are left out.

    network: "component" flags users whose component holds a seed, "neighbour" those next to one.
    """
    edges = stage(edges, "edges")
    nodes = edges.select(F.col("src").alias("node")).where("node > 0").union(seeds.select("node")).distinct()
    hops = distances(edges, seeds, max_hops, written=True)
    near = neighbour_counts(edges, seeds)
    flags = seeded_components(edges, seeds, written=True).select("node", "in_network") if network == "component" else near.select("node", F.lit(True).alias("in_network"))
    joined = nodes.join(hops, "node", "left").join(near, "node", "left").join(flags, "node", "left").join(ip_features.withColumnRenamed("user_id", "node"), "node", "left")
    distance, shared = F.coalesce("hops", F.lit(max_hops + 1)), F.coalesce("ip_shared_user_count", F.lit(0))
    fast = F.coalesce("has_high_speed_risk", F.lit(False))
    return joined.select(
        F.col("node").alias("user_id"), distance.cast("int").alias("min_hops_to_blacklist"), (distance == 1).alias("is_direct_neighbor"),
        F.coalesce("n", F.lit(0)).cast("long").alias("blacklist_neighbor_count"), F.coalesce("in_network", distance == 0).alias("in_blacklist_network"),
        shared.cast("long").alias("ip_shared_user_count"), fast.alias("has_high_speed_risk"), hop_risk_level(distance).alias("hop_risk_level"),
        weighted_label(distance, shared, fast).alias("weighted_risk_label"),
    )


def ring_sample(hops: DataFrame, counts: DataFrame, per_ring: int = 30, low: float = 80, high: float = 400) -> DataFrame:
    """For a plot: the per_ring best connected nodes of rings 0 to 2, with a size scaled within the ring."""
    from talus.operators.events import top_per_group

    near = hops.where("hops <= 2").join(counts, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    top = top_per_group(near, "hops", per_ring, F.desc("n"), F.asc("node"))
    stats = top.groupBy("hops").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    share = F.coalesce(F.try_divide(F.col("n") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0))), F.lit(0.0))
    return top.join(stats, "hops").select("node", "hops", "n", "rank", (low + share * (high - low)).alias("size"))
