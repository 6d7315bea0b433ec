"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import risk
from talus.operators import features, graph
from talus.plans import world as w
from talus.plans.catalog import query
from talus.runtime import table

DIST = f"WITH RECURSIVE {w.EDGES}, {w.SEEDS}, {w.WALK}"
REACH = f"WITH RECURSIVE {w.EDGES}, {w.SEEDS}, reach(node,r) AS (SELECT DISTINCT src, src FROM edges UNION SELECT e.dst, reach.r FROM reach JOIN edges e ON e.src=reach.node WHERE e.dst>reach.r), comp AS (SELECT node, min(r) AS component FROM reach GROUP BY 1)"


@query("g1_build_edges", f"WITH {w.EDGES} SELECT src, dst FROM edges")
def g1(s, d):
    return w.edges(s, d)


@query("g2_multi_source_bfs", f"{DIST} SELECT node, hops FROM dist")
def g2(s, d):
    return graph.distances(w.edges(s, d), w.seeds(s, d))


@query("g2r_recursive_bfs", f"{DIST} SELECT node, hops FROM dist")
def g2r(s, d):
    return graph.distances_recursive(w.edges(s, d), w.seeds(s, d))


@query("g2u_unrolled_bfs", f"{DIST} SELECT node, hops FROM dist")
def g2u(s, d):
    return graph.distances_unrolled(w.edges(s, d), w.seeds(s, d))


@query("g3_connected_components", f"{REACH} SELECT node, component, component IN (SELECT component FROM comp JOIN seeds USING(node)) AS in_network FROM comp")
def g3(s, d):
    return graph.seeded_components(w.edges(s, d), w.seeds(s, d))


@query("g4_smallest_neighbour", f"WITH {w.EDGES} SELECT src AS node, min(dst) AS smallest FROM edges GROUP BY 1")
def g4(s, d):
    return graph.smallest_neighbour(w.edges(s, d))


@query("g5_ip_node_ids", f"WITH {w.EV} SELECT DISTINCT source_ip, -CAST('0x'||substr(sha256(source_ip),1,15) AS BIGINT) AS node FROM ev")
def g5(s, d):
    return w.events(s, d).select("source_ip").distinct().select("source_ip", graph.node_of(F.col("source_ip")).alias("node"))


@query("g6_degree_tiers", f"WITH {w.EDGES}, g AS (SELECT src AS node, 2*count(*) AS degree FROM edges GROUP BY 1) SELECT CASE WHEN degree>40 THEN 'super' WHEN degree>10 THEN 'warn' ELSE 'normal' END AS tier, count(*) AS n FROM g GROUP BY 1")
def g6(s, d):
    return graph.degrees(w.edges(s, d)).groupBy(graph.degree_tier(F.col("degree"), 10, 40).alias("tier")).agg(F.count("*").alias("n"))


@query("g7_edge_salting", f"WITH {w.EDGES}, hot AS (SELECT src AS node FROM edges GROUP BY 1 HAVING count(*)>15) SELECT src IN (SELECT node FROM hot) AS hot, count(*) AS edges FROM edges GROUP BY 1")
def g7(s, d):
    e = w.edges(s, d)
    hot = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where("n > 15").select("node")
    salted = graph.salted(e, hot).join(hot.select(F.col("node").alias("src"), F.lit(True).alias("h")), "src", "left")
    good = F.col("salt").between(0, 15) & (F.col("h").isNotNull() | (F.col("salt") == 0))
    return salted.where(good).groupBy(F.col("h").isNotNull().alias("hot")).agg(F.count("*").alias("edges"))


@query("g8_excluded_nodes", f"WITH {w.EDGES}, x AS (SELECT src AS node FROM edges GROUP BY 1 HAVING count(*)>15) SELECT src, dst FROM edges WHERE src NOT IN (SELECT node FROM x) AND dst NOT IN (SELECT node FROM x)")
def g8(s, d):
    e = w.edges(s, d)
    return graph.without_nodes(e, e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where("n > 15").select("node"))


IPF = "ipf AS (SELECT user_id, max(u) AS ip_shared_user_count, max(CAST(fast AS INT))=1 AS has_high_speed_risk FROM (SELECT o_custkey+1 AS user_id, o_custkey%6 AS u, o_totalprice<50000 AS fast FROM orders) GROUP BY 1)"


def _ip(s, d):
    o = table(s, d, "orders").select((F.col("o_custkey") + 1).alias("user_id"), F.pmod("o_custkey", F.lit(6)).alias("u"), (F.col("o_totalprice") < 50000).alias("fast"))
    return o.groupBy("user_id").agg(F.max("u").alias("ip_shared_user_count"), F.bool_or("fast").alias("has_high_speed_risk"))


@query("g9_hop_features", f"""{REACH}, {w.WALK}, {IPF}, nb AS (SELECT src AS node, count(DISTINCT dst) AS n FROM edges JOIN seeds ON dst=seeds.node GROUP BY 1), nodes AS (SELECT src AS node FROM edges WHERE src>0 UNION SELECT node FROM seeds),
hit AS (SELECT DISTINCT component FROM comp JOIN seeds USING(node)), j AS (SELECT nodes.node AS user_id, coalesce(hops,4) AS h, coalesce(n,0) AS n, CASE WHEN comp.node IS NULL THEN coalesce(hops,4)=0 ELSE comp.component IN (SELECT component FROM hit) END AS net, coalesce(ip_shared_user_count,0) AS ip, coalesce(has_high_speed_risk,false) AS f FROM nodes LEFT JOIN dist USING(node) LEFT JOIN nb USING(node) LEFT JOIN comp USING(node) LEFT JOIN ipf ON ipf.user_id=nodes.node)
SELECT user_id, CAST(h AS INT) AS min_hops_to_blacklist, h=1 AS is_direct_neighbor, n AS blacklist_neighbor_count, net AS in_blacklist_network, ip AS ip_shared_user_count, f AS has_high_speed_risk, CASE h WHEN 0 THEN 'blacklist' WHEN 1 THEN 'direct' WHEN 2 THEN 'indirect_2' WHEN 3 THEN 'indirect_3' ELSE 'isolated' END AS hop_risk_level,
CASE WHEN h<=2 AND ip>3 AND f THEN 'HIGH_WEIGHTED' WHEN h=0 THEN 'BLACKLIST' WHEN h=1 THEN 'HIGH' WHEN h IN (2,3) THEN 'MEDIUM' ELSE 'LOW' END AS weighted_risk_label FROM j""")
def g9(s, d):
    return graph.hop_features(w.edges(s, d), w.seeds(s, d), _ip(s, d))


@query("g10_local_hop_feature", f"{DIST}, nb AS (SELECT src AS node, count(DISTINCT dst) AS n FROM edges JOIN seeds ON dst=seeds.node GROUP BY 1), j AS (SELECT DISTINCT src AS user_id, coalesce(hops,4) AS h, coalesce(n,0) AS n FROM edges LEFT JOIN dist ON src=dist.node LEFT JOIN nb ON src=nb.node) SELECT user_id, h AS min_hops_to_blacklist, h=1 AS is_direct_neighbor, n AS blacklist_neighbor_count, h<=3 AS in_blacklist_network, CASE h WHEN 0 THEN 'blacklist' WHEN 1 THEN 'direct' WHEN 2 THEN 'indirect_2' WHEN 3 THEN 'indirect_3' ELSE 'isolated' END AS hop_risk_level FROM j")
def g10(s, d):
    return features.graph_hops(w.edges(s, d), w.seeds(s, d)).orderBy("min_hops_to_blacklist", "user_id")


RELN = f"""b AS (SELECT src, dst FROM relations UNION ALL SELECT dst, src FROM relations), dn AS (SELECT src AS node, count(*) AS n FROM b WHERE dst IN (SELECT node FROM eseeds) GROUP BY 1),
grp AS (SELECT DISTINCT source_ip AS k, user_id FROM twd UNION SELECT DISTINCT 'c/'||source_ip, user_id FROM crypto), gn AS (SELECT a.user_id AS node, count(*) AS n FROM grp a JOIN grp b ON a.k=b.k AND a.user_id<>b.user_id WHERE b.user_id IN (SELECT node FROM eseeds) GROUP BY 1),
reln AS (SELECT node, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM dn UNION ALL SELECT * FROM gn) GROUP BY 1)"""


@query("g11_multiset_neighbours", f"{w.EVENTS}, {w.RELATIONS}, {w.ESEEDS}, {RELN} SELECT node, n FROM reln")
def g11(s, d):
    t, c = w.twd(s, d), w.crypto(s, d)
    groups = t.select(F.col("source_ip").alias("key"), "user_id").union(c.select(F.concat(F.lit("c/"), F.col("source_ip")).alias("key"), "user_id"))
    return graph.relation_counts(w.relations(s, d), groups, w.event_seeds(s, d))


@query("g12_fold_aware_seeds", f"WITH RECURSIVE {w.EDGES}, {w.SEEDS}, fs AS (SELECT f AS fold, node FROM seeds, (SELECT unnest(range(3)) AS f) WHERE node%3<>f), walk(fold,node,hops) AS (SELECT fold, node, 0 FROM fs UNION SELECT w.fold, e.dst, w.hops+1 FROM walk w JOIN edges e ON e.src=w.node WHERE w.hops<2) SELECT CAST(fold AS INT) AS fold, node, CAST(min(hops) AS INT) AS hops FROM walk GROUP BY 1,2")
def g12(s, d):
    fs = w.seeds(s, d).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("node % 3 <> fold")
    return graph.distances(w.edges(s, d), fs, 2, keys=("fold",))


@query("g13_ring_sample", f"{DIST}, nb AS (SELECT src AS node, count(DISTINCT dst) AS n FROM edges JOIN seeds ON dst=seeds.node GROUP BY 1), r AS (SELECT dist.node, hops, coalesce(n,0) AS n, row_number() OVER (PARTITION BY hops ORDER BY coalesce(n,0) DESC, dist.node) AS rank FROM dist LEFT JOIN nb USING(node) WHERE hops<=2), t AS (SELECT *, min(n) OVER (PARTITION BY hops) AS lo, max(n) OVER (PARTITION BY hops) AS hi FROM r WHERE rank<=30) SELECT node, hops, n, CAST(rank AS INT) AS rank, round(80+coalesce((n-lo)/nullif(hi-lo,0),0)*320,4) AS size FROM t")
def g13(s, d):
    e, x = w.edges(s, d), w.seeds(s, d)
    return graph.ring_sample(graph.distances(e, x), graph.neighbour_counts(e, x)).withColumn("size", F.round("size", 4))
