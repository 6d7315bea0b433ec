"""Joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talus.functions import clean
from talus.operators import evaluate, events, features, graph, validate
from talus.plans import world as w
from talus.plans.catalog import query
from talus.runtime import stage, table

M = lambda c: F.col(c).cast("decimal(18,2)")


@query("j1_left_join_chain", f"""{w.EVENTS}, a AS (SELECT user_id, count(*) AS n_twd FROM twd GROUP BY 1), b AS (SELECT user_id, count(*) AS n_crypto FROM crypto WHERE kind=1 GROUP BY 1)
SELECT user_id, kyc_level, coalesce(n_twd,0) AS n_twd, coalesce(n_crypto,0) AS n_crypto FROM users LEFT JOIN a USING(user_id) LEFT JOIN b USING(user_id)""")
def j1(s, d):
    a = w.twd(s, d).groupBy("user_id").agg(F.count("*").alias("n_twd"))
    b = w.crypto(s, d).where("kind = 1").groupBy("user_id").agg(F.count("*").alias("n_crypto"))
    u = w.users(s, d).select("user_id", clean.kyc_level(F.col("level1_finished_at"), F.col("level2_finished_at")).alias("kyc_level"))
    return u.join(a, "user_id", "left").join(b, "user_id", "left").fillna(0, ["n_twd", "n_crypto"])


@query("j2_inner_join_ip_counts", f"""{w.EVENTS}, m AS (SELECT DISTINCT user_id, source_ip FROM twd), c AS (SELECT source_ip, count(*) AS users FROM m GROUP BY 1) SELECT user_id, source_ip, users FROM m JOIN c USING(source_ip)""")
def j2(s, d):
    m = w.twd(s, d).select("user_id", "source_ip").distinct()
    return m.join(m.groupBy("source_ip").agg(F.count("*").alias("users")), "source_ip").select("user_id", "source_ip", "users")


@query("j3_next_event_after", f"""{w.EVENTS} SELECT d.event_id, d.user_id, d.created_at, min(c.created_at) AS next_end FROM twd d LEFT JOIN crypto c ON c.user_id=d.user_id AND c.kind=1 AND c.created_at>d.created_at WHERE d.kind=0 GROUP BY 1,2,3""")
def j3(s, d):
    both = w.twd(s, d).where("kind = 0").select("event_id", "user_id", "created_at", F.lit(True).alias("dep")).union(w.crypto(s, d).where("kind = 1").select("event_id", "user_id", "created_at", F.lit(False)))
    return events.next_after(both, "user_id", "created_at", F.col("dep"), ~F.col("dep")).select("event_id", "user_id", "created_at", "next_end")


@query("j3_next_event_after_hot_keys", f"""{w.EVENTS} SELECT d.event_id, min(c.created_at) AS next_end FROM twd d LEFT JOIN crypto c ON c.user_id=d.user_id AND c.kind=1 AND c.created_at>d.created_at WHERE d.kind=0 GROUP BY 1""")
def j3s(s, d):
    both = w.twd(s, d).where("kind = 0").select("event_id", "user_id", "created_at", F.lit(True).alias("dep")).union(w.crypto(s, d).where("kind = 1").select("event_id", "user_id", "created_at", F.lit(False)))
    return events.next_after_split(both, "user_id", "created_at", F.col("dep"), ~F.col("dep")).select("event_id", "next_end")


@query("j4_shared_key_self_join", f"WITH {w.WEEKS} SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM weeks a JOIN weeks b USING(k) WHERE a.user_id<b.user_id")
def j4(s, d):
    return graph.shared_key_edges(w.shared_weeks(s, d), "k")


@query("j5_capped_clique", f"WITH {w.EV}, m AS (SELECT DISTINCT source_ip AS k, user_id AS u FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY u) AS n FROM m), c AS (SELECT * FROM r WHERE n<=50) SELECT DISTINCT a.u AS src, b.u AS dst FROM c a JOIN c b USING(k) WHERE a.u<b.u")
def j5(s, d):
    return graph.shared_key_edges(w.events(s, d), "source_ip", cap=50)


@query("j5_capped_clique_50", f"WITH {w.EV}, m AS (SELECT DISTINCT source_ip AS k, user_id AS u FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY u) AS n FROM m), c AS (SELECT * FROM r WHERE n<=50) SELECT DISTINCT a.u AS src, b.u AS dst FROM c a JOIN c b USING(k) WHERE a.u<b.u")
def j5full(s, d):
    return graph.shared_key_edges(w.events(s, d), "source_ip", cap=50)


@query("j6_ip_hour_cooccurrence", f"WITH {w.EV}, m AS (SELECT DISTINCT source_ip||'/'||strftime(date_trunc('hour',created_at),'%Y-%m-%d %H') AS k, user_id AS u FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY u) AS n FROM m), c AS (SELECT * FROM r WHERE n<=20) SELECT DISTINCT a.u AS src, b.u AS dst FROM c a JOIN c b USING(k) WHERE a.u<b.u")
def j6(s, d):
    k = F.concat_ws("/", "source_ip", F.date_format(F.date_trunc("hour", "created_at"), "yyyy-MM-dd HH"))
    return graph.shared_key_edges(w.events(s, d).withColumn("k", k), "k", cap=20)


@query("j7_anti_join_excluded", f"WITH {w.EDGES}, {w.SEEDS} SELECT src, dst FROM edges WHERE src NOT IN (SELECT node FROM seeds) AND dst NOT IN (SELECT node FROM seeds)")
def j7(s, d):
    return graph.without_nodes(w.edges(s, d), w.seeds(s, d)).select("src", "dst")


@query("j8_anti_join_visited", f"WITH {w.EDGES}, {w.SEEDS}, nb AS (SELECT DISTINCT dst AS node FROM edges JOIN seeds ON src=node) SELECT node FROM nb WHERE node NOT IN (SELECT node FROM seeds)")
def j8(s, d):
    seeds = w.seeds(s, d)
    return w.edges(s, d).join(seeds, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(seeds, "node", "left_anti")


@query("j9_not_in", f"{w.EVENTS} SELECT user_id FROM users WHERE user_id NOT IN (SELECT user_id FROM crypto WHERE kind=1 AND amount>90)")
def j9(s, d):
    w.users(s, d).createOrReplaceTempView("t_users")
    w.crypto(s, d).createOrReplaceTempView("t_crypto")
    return s.sql("SELECT user_id FROM t_users u WHERE NOT EXISTS (SELECT 1 FROM t_crypto c WHERE c.user_id = u.user_id AND c.kind = 1 AND c.amount > 90)")


@query("j10_exists", f"WITH {w.EDGES}, {w.SEEDS} SELECT DISTINCT src FROM edges e WHERE EXISTS (SELECT 1 FROM seeds WHERE node=e.dst)")
def j10(s, d):
    return w.edges(s, d).join(w.seeds(s, d).withColumnRenamed("node", "dst"), "dst", "left_semi").select("src").distinct()


@query("j11_membership", f"{w.EVENTS}, ids AS (SELECT DISTINCT user_id FROM crypto WHERE amount>80) SELECT user_id, user_id IN (SELECT user_id FROM ids) AS listed FROM users")
def j11(s, d):
    ids = w.crypto(s, d).where("amount > 80").select("user_id", F.lit(True).alias("x")).distinct()
    return w.users(s, d).select("user_id").join(ids, "user_id", "left").select("user_id", F.col("x").isNotNull().alias("listed"))


@query("j12_frontier_expansion", f"WITH {w.EDGES}, {w.SEEDS} SELECT DISTINCT dst AS node FROM edges JOIN seeds ON src=node")
def j12(s, d):
    return w.edges(s, d).join(w.seeds(s, d), F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()


@query("j13_salt_expansion", f"WITH {w.SEEDS} SELECT node, CAST(s AS INT) AS salt FROM seeds, (SELECT unnest(range(16)) AS s)")
def j13(s, d):
    return w.seeds(s, d).select("node", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))


@query("j14_left_join_marks", f"WITH {w.EDGES}, {w.SEEDS} SELECT DISTINCT src AS node, n.node IS NOT NULL AS listed FROM edges LEFT JOIN seeds n ON src=n.node")
def j14(s, d):
    return w.edges(s, d).select(F.col("src").alias("node")).distinct().join(w.seeds(s, d).withColumn("x", F.lit(1)), "node", "left").select("node", F.col("x").isNotNull().alias("listed"))


@query("j15_group_zscore", "SELECT c_custkey, round((c_acctbal-avg(c_acctbal) OVER (PARTITION BY c_mktsegment))/nullif(stddev_samp(c_acctbal) OVER (PARTITION BY c_mktsegment),0),6) AS z FROM customer")
def j15(s, d):
    return events.zscore(table(s, d, "customer"), "c_mktsegment", "c_acctbal", "z").select("c_custkey", F.round("z", 6).alias("z"))


@query("j16_label_attach", f"{w.EVENTS}, ids AS (SELECT user_id, CAST(user_id%5=0 AS INT) AS status FROM users WHERE user_id%2=0 UNION ALL SELECT user_id, NULL FROM users WHERE user_id%2=1), f AS (SELECT user_id, count(*) AS n FROM twd WHERE kind=1 GROUP BY 1) SELECT user_id, status, coalesce(n,0) AS n FROM ids LEFT JOIN f USING(user_id)")
def j16(s, d):
    u = w.users(s, d)
    train = u.where("user_id % 2 = 0").select("user_id", (F.col("user_id") % 5 == 0).cast("int").alias("status"))
    f = w.twd(s, d).where("kind = 1").groupBy("user_id").agg(F.count("*").alias("n"))
    return features.pipeline_label_table(train, u.where("user_id % 2 = 1").select("user_id"), f)


@query("j17_prediction_truth", f"WITH {w.SCORED} SELECT s.doc_id, s.p, l.toxic FROM scored s JOIN labels l USING(doc_id)")
def j17(s, d):
    return w.scored(s, d).select("doc_id", "p").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id")


@query("j18_component_join", f"WITH RECURSIVE {w.EDGES}, reach(node,r) AS (SELECT DISTINCT src, src FROM edges UNION SELECT e.dst, reach.r FROM reach JOIN edges e ON e.src=reach.node WHERE e.dst>reach.r), c AS (SELECT node, min(r) AS c FROM reach GROUP BY 1) SELECT a.c AS component, count(*) AS edges FROM edges JOIN c a ON src=a.node JOIN c b ON dst=b.node WHERE a.c=b.c GROUP BY 1")
def j18(s, d):
    e = stage(w.edges(s, d), "edges")
    c = stage(graph.components(e, written=True), "components")
    a, b = c.toDF("src", "a"), c.toDF("dst", "b")
    return e.join(a, "src").join(b, "dst").where("a = b").groupBy(F.col("a").alias("component")).agg(F.count("*").alias("edges"))


@query("a1_group_aggregates", f"{w.EVENTS} SELECT user_id, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, round(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)/count(*),6) AS mean, min(amount) AS low, max(amount) AS high FROM twd GROUP BY 1")
def a1(s, d):
    total = F.sum(M("amount")).cast("double")
    return w.twd(s, d).groupBy("user_id").agg(F.count("*").alias("n"), total.alias("total"), F.round(total / F.count("*"), 6).alias("mean"), F.min("amount").alias("low"), F.max("amount").alias("high"))


@query("a2_conditional", f"{w.EVENTS} SELECT user_id, count(*) FILTER (kind=0) AS deposits, CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (kind=0),0) AS DOUBLE) AS deposited FROM twd GROUP BY 1")
def a2(s, d):
    return w.twd(s, d).groupBy("user_id").agg(F.count_if(F.col("kind") == 0).alias("deposits"), F.coalesce(F.sum(F.when(F.col("kind") == 0, M("amount"))), F.lit(0)).cast("double").alias("deposited"))


@query("a3_filtered_size", f"{w.EVENTS}, b AS (SELECT user_id, 'twd' AS t, kind FROM twd UNION ALL SELECT user_id, 'crypto', kind FROM crypto) SELECT user_id, count(*) FILTER (t='twd' AND kind=0) AS twd_deposit_count, count(*) FILTER (t='twd' AND kind=1) AS twd_withdraw_count, count(*) FILTER (t='crypto' AND kind=0) AS crypto_deposit_count, count(*) FILTER (t='crypto' AND kind=1) AS crypto_withdraw_count FROM b GROUP BY 1")
def a3(s, d):
    return features.counts_by_kind(w.twd(s, d), w.crypto(s, d))


@query("a4_distinct_count", f"{w.EVENTS} SELECT user_id, count(DISTINCT source_ip) AS ips FROM twd GROUP BY 1")
def a4(s, d):
    return w.twd(s, d).groupBy("user_id").agg(F.count_distinct("source_ip").alias("ips"))


@query("a5_users_per_ip", f"{w.EVENTS} SELECT source_ip, count(DISTINCT user_id) AS users FROM twd GROUP BY 1")
def a5(s, d):
    return w.twd(s, d).groupBy("source_ip").agg(F.count_distinct("user_id").alias("users"))


@query("a6_two_level", f"{w.EVENTS}, c AS (SELECT source_ip, count(DISTINCT user_id) AS u FROM twd GROUP BY 1) SELECT user_id, max(u) AS shared FROM twd JOIN c USING(source_ip) GROUP BY 1")
def a6(s, d):
    t = w.twd(s, d)
    return t.join(t.groupBy("source_ip").agg(F.count_distinct("user_id").alias("u")), "source_ip").groupBy("user_id").agg(F.max("u").alias("shared"))


@query("a7_night_ratio", f"{w.EVENTS} SELECT user_id, round(avg(CAST(hour(created_at)>=22 OR hour(created_at)<=6 AS INT)),6) AS night_tx_ratio FROM twd GROUP BY 1")
def a7(s, d):
    return features.night_ratio(w.twd(s, d)).withColumn("night_tx_ratio", F.round("night_tx_ratio", 6))


@query("a8_count_ratio", f"{w.EVENTS} SELECT user_id, round(count(*) FILTER (hour(created_at)>=22 OR hour(created_at)<=5)/count(*),6) AS r FROM twd GROUP BY 1")
def a8(s, d):
    return w.twd(s, d).groupBy("user_id").agg(F.round(clean.over(F.count_if(events.is_night(F.col("created_at"), 5)), F.count("*")), 6).alias("r"))


@query("a9_stddev_by_group", "SELECT c_mktsegment, round(avg(c_acctbal),4) AS mean, round(stddev_samp(c_acctbal),4) AS std FROM customer GROUP BY 1")
def a9(s, d):
    return table(s, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev_samp("c_acctbal"), 4).alias("std"))


@query("a10_collect_set", f"{w.EVENTS}, m AS (SELECT DISTINCT source_ip, user_id FROM twd) SELECT source_ip, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS users FROM m GROUP BY 1")
def a10(s, d):
    ids = F.transform(F.sort_array(F.collect_set("user_id")), lambda x: x.cast("string"))
    return w.twd(s, d).groupBy("source_ip").agg(F.array_join(ids, ",").alias("users"))


@query("a11_class_balance", "SELECT count(*) FILTER (toxic=1) AS pos, count(*) FILTER (toxic=0) AS neg, round(count(*) FILTER (toxic=0)/count(*) FILTER (toxic=1),4) AS scale_pos_weight FROM labels")
def a11(s, d):
    from talus.operators.ml import positive_weight

    return positive_weight(table(s, d, "labels"), "toxic")


@query("a12_degree", f"WITH {w.EDGES}, b AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT node, count(*) AS degree FROM b GROUP BY 1")
def a12(s, d):
    return graph.degrees(w.edges(s, d))


@query("a13_distinct_rows", f"{w.EVENTS} SELECT DISTINCT user_id, source_ip FROM twd")
def a13(s, d):
    return w.twd(s, d).dropDuplicates(["user_id", "source_ip"]).select("user_id", "source_ip")


@query("a14_value_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a14(s, d):
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderstatus")


@query("a15_describe", "SELECT count(c_acctbal) AS n, round(avg(c_acctbal),4) AS mean, round(stddev_samp(c_acctbal),4) AS std, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer")
def a15(s, d):
    c = F.col("c_acctbal")
    return table(s, d, "customer").agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))


@query("a16_percent_of_total", "SELECT event_type, count(*) AS n, round(count(*)*100.0/sum(count(*)) OVER (),2) AS pct FROM events GROUP BY 1")
def a16(s, d):
    n = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


@query("a17_min_per_node", f"WITH RECURSIVE {w.EDGES}, {w.SEEDS}, {w.WALK} SELECT hops, count(*) AS n FROM dist GROUP BY 1")
def a17(s, d):
    return graph.distances(w.edges(s, d), w.seeds(s, d)).groupBy("hops").agg(F.count("*").alias("n"))


@query("a18_confusion", f"WITH {w.SCORED}, c AS (SELECT count(*) FILTER (p>=0.5 AND y=1) AS tp, count(*) FILTER (p>=0.5 AND y=0) AS fp, count(*) FILTER (p<0.5 AND y=1) AS fn, count(*) FILTER (p<0.5 AND y=0) AS tn FROM scored) SELECT tp, fp, fn, tn, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(2*tp/(2*tp+fn+fp),6) AS f1, round(fp/(fp+tn),6) AS fpr, round((tp+tn)/(tp+fp+fn+tn),6) AS accuracy FROM c")
def a18(s, d):
    c = evaluate.confusion(w.scored(s, d), F.col("p") >= 0.5, F.col("y") == 1)
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "fpr", "accuracy")])


@query("a19_fold_summary", f"WITH {w.SCORED}, f AS (SELECT doc_id%5 AS fold, avg(p) AS v FROM scored GROUP BY 1) SELECT round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, round(quantile_cont(v,0.5),6) AS median FROM f")
def a19(s, d):
    f = w.scored(s, d).groupBy(F.pmod("doc_id", F.lit(5)).alias("fold")).agg(F.avg("p").alias("v"))
    return evaluate.fold_summary(f, "v").select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "median")])


@query("a20_coverage", f"{w.EVENTS} SELECT round(avg(CAST(user_id IN (SELECT user_id FROM crypto WHERE amount>95) AS INT)),6) AS coverage FROM users")
def a20(s, d):
    hit = w.crypto(s, d).where("amount > 95").select("user_id", F.lit(1).alias("x")).distinct()
    return w.users(s, d).join(hit, "user_id", "left").agg(F.round(F.avg(F.coalesce("x", F.lit(0))), 6).alias("coverage"))


@query("a21_first_after_sort", f"{w.EVENTS} SELECT user_id, arg_min(source_ip, struct_pack(a:=created_at,b:=event_id)) AS first_ip FROM twd GROUP BY 1")
def a21(s, d):
    return w.twd(s, d).groupBy("user_id").agg(F.min_by("source_ip", F.struct("created_at", "event_id")).alias("first_ip"))


@query("a22_histogram", f"WITH {w.SCORED} SELECT y, CAST(least(floor(p*30)+1,30) AS INT) AS bin, count(*) AS n FROM scored WHERE p BETWEEN 0 AND 1 GROUP BY 1,2")
def a22(s, d):
    return evaluate.histogram(w.scored(s, d), F.col("p"), 0.0, 1.0, 30, "y")


@query("a23_weighted_count", f"WITH {w.SCORED} SELECT round(count(*) FILTER (p>=0.65)*0.003+count(*) FILTER (p<0.65)*0.00025,6) AS cost FROM scored")
def a23(s, d):
    return w.scored(s, d).agg(F.round(F.sum(F.when(F.col("p") >= 0.65, F.lit(0.003)).otherwise(F.lit(0.00025))), 6).alias("cost"))


@query("w1_lag_gap", f"{w.EVENTS} SELECT event_id, user_id, epoch_us(created_at)-epoch_us(lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, event_id)) AS gap_us FROM twd")
def w1(s, d):
    return events.gaps(w.twd(s, d), "user_id", "created_at", "event_id").select("event_id", "user_id", F.round(F.col("gap_seconds") * 1e6).cast("long").alias("gap_us"))


@query("w1_lag_gap_split", f"{w.EVENTS} SELECT event_id, user_id, epoch_us(created_at)-epoch_us(lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, event_id)) AS gap_us FROM twd")
def w1split(s, d):
    """The same gaps with the rows of a key spread over range partitions."""
    return events.gaps_split(w.twd(s, d), "user_id", "created_at", "event_id").select("event_id", "user_id", F.round(F.col("gap_seconds") * 1e6).cast("long").alias("gap_us"))


@query("w2_empty_window", "SELECT o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM orders GROUP BY 1")
def w2(s, d):
    return table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))


@query("w3_latest_per_key", f"WITH {w.EV} SELECT user_id, event_id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC)=1")
def w3(s, d):
    return events.latest(w.events(s, d), "user_id", "created_at", "event_id").select("user_id", "event_id", "event_type")


@query("w4_partition_stats", "SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey),4) AS mean, round(stddev_samp(c_acctbal) OVER (PARTITION BY c_nationkey),4) AS std FROM customer")
def w4(s, d):
    p = Window.partitionBy("c_nationkey")
    return table(s, d, "customer").select("c_custkey", F.round(F.avg("c_acctbal").over(p), 4).alias("mean"), F.round(F.stddev_samp("c_acctbal").over(p), 4).alias("std"))


@query("w5_top_n_per_row", "SELECT user_id, event_id, CAST(r AS INT) AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r<=3")
def w5(s, d):
    return events.top_per_group(table(s, d, "events"), "user_id", 3, F.desc("value"), F.asc("event_id")).select("user_id", "event_id", "rank")


@query("w6_running_best", f"WITH {w.SCORED}, t AS (SELECT unnest(range(5,95)) AS t), c AS (SELECT t/100 AS threshold, count(*) FILTER (p*100>=t-1e-9 AND y=1) AS tp, count(*) FILTER (p*100>=t-1e-9 AND y=0) AS fp, count(*) FILTER (p*100<t-1e-9 AND y=1) AS fn FROM scored, t GROUP BY 1), f AS (SELECT threshold, 2*tp/(2*tp+fp+fn) AS f1 FROM c) SELECT threshold, round(f1,6) AS f1 FROM f ORDER BY round(f1,12) DESC, threshold LIMIT 1")
def w6(s, d):
    return evaluate.best(evaluate.sweep(w.scored(s, d), 500, 9400, 100)).select("threshold", F.round("f1", 6).alias("f1"))


@query("w7_next_event_frame", f"{w.EVENTS} SELECT event_id, (SELECT min(x.created_at) FROM twd x WHERE x.user_id=t.user_id AND x.kind=1 AND x.created_at>t.created_at) AS next_withdrawal FROM twd t WHERE kind=0")
def w7(s, d):
    t = w.twd(s, d)
    return events.next_after(t, "user_id", "created_at", F.col("kind") == 0, F.col("kind") == 1).select("event_id", F.col("next_end").alias("next_withdrawal"))


@query("t1_order_by_case", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def t1(s, d):
    n = table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.orderBy(F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3))


@query("t2_top_degree", f"WITH {w.EDGES} SELECT src AS node, 2*count(*) AS degree FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def t2(s, d):
    return graph.degrees(w.edges(s, d)).orderBy(F.desc("degree"), "node").limit(20)


@query("t3_nlargest", f"WITH {w.SCORED} (SELECT doc_id, p, 'high' AS side FROM scored ORDER BY p DESC, doc_id LIMIT 50) UNION ALL (SELECT doc_id, p, 'low' FROM scored ORDER BY p, doc_id LIMIT 50)")
def t3(s, d):
    x = w.scored(s, d).select("doc_id", "p")
    return x.orderBy(F.desc("p"), "doc_id").limit(50).withColumn("side", F.lit("high")).union(x.orderBy("p", "doc_id").limit(50).withColumn("side", F.lit("low")))


@query("t4_top_per_ring", f"WITH RECURSIVE {w.EDGES}, {w.SEEDS}, {w.WALK}, n AS (SELECT src AS node, count(DISTINCT dst) AS n FROM edges JOIN seeds ON dst=seeds.node GROUP BY 1), r AS (SELECT dist.node, hops, coalesce(n,0) AS n, CAST(row_number() OVER (PARTITION BY hops ORDER BY coalesce(n,0) DESC, dist.node) AS INT) AS rank FROM dist LEFT JOIN n USING(node) WHERE hops<=2) SELECT node, hops, n, rank FROM r WHERE rank<=30")
def t4(s, d):
    e, x = w.edges(s, d), w.seeds(s, d)
    return graph.ring_sample(graph.distances(e, x), graph.neighbour_counts(e, x)).select("node", "hops", "n", "rank")


@query("t5_sorts", f"WITH {w.SCORED} SELECT doc_id, p FROM scored")
def t5(s, d):
    return w.scored(s, d).select("doc_id", "p").orderBy(F.desc("p"), "doc_id")


@query("t6_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def t6(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("t7_seeded_sample", "SELECT doc_id FROM labels ORDER BY md5('42/'||doc_id), doc_id LIMIT 100")
def t7(s, d):
    return events.seeded_sample(table(s, d, "labels"), "doc_id", 100).select("doc_id")


@query("t8_stratified_folds", "SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5('42/'||doc_id), doc_id) - 1) % 5 AS INT) AS fold FROM labels")
def t8(s, d):
    return events.folds(table(s, d, "labels"), "doc_id", "toxic", 5).select("doc_id", "toxic", "fold")


@query("u1_union_all", f"{w.EVENTS} SELECT user_id, amount, 'twd' AS t FROM twd UNION ALL SELECT user_id, amount, 'crypto' FROM crypto UNION ALL SELECT user_id, amount, 'swap' FROM swaps")
def u1(s, d):
    tag = lambda df, t: df.select("user_id", "amount", F.lit(t).alias("t"))
    return tag(w.twd(s, d), "twd").unionByName(tag(w.crypto(s, d), "crypto")).unionByName(tag(w.swaps(s, d), "swap"), allowMissingColumns=True)


@query("u2_union_distinct", f"WITH {w.EDGES}, {w.SEEDS} SELECT src AS node FROM edges UNION SELECT node FROM seeds")
def u2(s, d):
    return w.edges(s, d).select(F.col("src").alias("node")).union(w.seeds(s, d)).distinct()


@query("u3_difference", f"{w.EVENTS}, e AS (SELECT user_id FROM users WHERE user_id%3<>0), g AS (SELECT user_id FROM users WHERE user_id%2=0) SELECT user_id, 'missing' AS side FROM e WHERE user_id NOT IN (SELECT user_id FROM g) UNION ALL SELECT user_id, 'extra' FROM g WHERE user_id NOT IN (SELECT user_id FROM e)")
def u3(s, d):
    u = w.users(s, d).select("user_id")
    return validate.id_difference(u.where("user_id % 3 <> 0"), u.where("user_id % 2 = 0"))


@query("u4_intersection", f"{w.EVENTS} SELECT user_id FROM twd WHERE amount>90 INTERSECT SELECT user_id FROM crypto WHERE amount>90")
def u4(s, d):
    return w.twd(s, d).where("amount > 90").select("user_id").intersect(w.crypto(s, d).where("amount > 90").select("user_id"))


@query("u5_distinct_ids", f"{w.EVENTS} SELECT user_id FROM twd UNION SELECT user_id FROM crypto")
def u5(s, d):
    return w.twd(s, d).select("user_id").union(w.crypto(s, d).select("user_id")).distinct()
