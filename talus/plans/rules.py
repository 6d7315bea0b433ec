"""Projections, casts, rules and scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import clean, risk
from talus.operators import events, evaluate, validate
from talus.plans import world as w
from talus.plans.catalog import query
from talus.runtime import table

HOPS = "h AS (SELECT c_custkey AS id, c_custkey%6 AS hops, c_nationkey%8 AS ip, c_acctbal<0 AS fast, c_acctbal AS bal FROM customer)"


def _hops(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.pmod("c_custkey", F.lit(6)).alias("hops"), F.pmod("c_nationkey", F.lit(8)).alias("ip"), (F.col("c_acctbal") < 0).alias("fast"), F.col("c_acctbal").alias("bal"))


@query("pf1_scale_amounts", "SELECT o_orderkey, CAST(CAST(o_custkey*100000000+7 AS DECIMAL(28,8))*CAST(0.00000001 AS DECIMAL(9,8)) AS DOUBLE) AS amount FROM orders")
def pf1(s, d):
    return clean.scale_amounts(table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") * 100000000 + 7).alias("amount")))


@query("pf2_exact_scaling", "SELECT o_orderkey, CASE WHEN o_orderkey%5=0 THEN NULL ELSE CAST(CAST(o_orderkey*123456789 AS DECIMAL(28,8))*CAST(0.00000001 AS DECIMAL(9,8)) AS DOUBLE) END AS v FROM orders")
def pf2(s, d):
    t = F.when(F.col("o_orderkey") % 5 == 0, F.element_at(F.array(F.lit("None"), F.lit(""), F.lit("NaN"), F.lit("null")), (F.col("o_orderkey") % 4 + 1).cast("int"))).otherwise((F.col("o_orderkey") * 123456789).cast("string"))
    return table(s, d, "orders").select("o_orderkey", clean.scaled(t).alias("v"))


@query("pf3_datetimes", "SELECT o_orderkey, CASE WHEN o_orderkey%7=0 THEN NULL ELSE epoch_us(o_orderdate)//1000000 END AS seconds FROM orders")
def pf3(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey") % 7
    t = F.when(k == 0, "not a date").when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", F.unix_timestamp(clean.datetime_of(t)).alias("seconds"))


@query("pf4_enforce_schema", "SELECT c_custkey AS user_id, CAST(NULL AS INTEGER) AS status, c_acctbal>0 AS ok FROM customer")
def pf4(s, d):
    from pyspark.sql.types import StructType

    c = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.when(F.col("c_acctbal") > 0, " Yes ").otherwise("n").alias("ok"), F.lit(1).alias("extra"))
    return clean.enforce(c, StructType.fromDDL("user_id bigint, status int, ok boolean"))


@query("pf5_truth", "SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS v FROM customer")
def pf5(s, d):
    k = F.col("c_custkey") % 4
    return table(s, d, "customer").select("c_custkey", clean.truth(F.when(k == 0, " TRUE").when(k == 1, "no").when(k == 2, "1")).alias("v"))


@query("pf6_kyc_level", f"{w.EVENTS} SELECT user_id, kyc_level FROM users")
def pf6(s, d):
    return w.users(s, d).select("user_id", clean.kyc_level(F.col("level1_finished_at"), F.col("level2_finished_at")).alias("kyc_level"))


@query("pf7_kyc_level_text", "SELECT c_custkey, CASE c_custkey%4 WHEN 3 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS kyc_level FROM customer")
def pf7(s, d):
    k = F.col("c_custkey") % 4
    return table(s, d, "customer").select("c_custkey", clean.kyc_level_text(F.when(k.isin(1, 3), "2024-01-01").otherwise("NaT"), F.when(k >= 2, "2024-01-02").otherwise("None")).alias("kyc_level"))


@query("pf8_filters", "SELECT event_id FROM events WHERE event_type IN ('click','view') AND value BETWEEN 10 AND 20 AND props IS NOT NULL")
def pf8(s, d):
    return table(s, d, "events").where(F.col("event_type").isin("click", "view") & F.col("value").between(10, 20) & F.col("props").isNotNull()).select("event_id")


@query("pf9_loops_removed", f"WITH {w.RELATIONS} SELECT DISTINCT least(src,dst) AS a, greatest(src,dst) AS b FROM relations WHERE src<>dst AND src>0 AND dst>0")
def pf9(s, d):
    return w.relations(s, d).where("src <> dst AND src > 0 AND dst > 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


@query("pf10_length", "SELECT c_custkey FROM customer WHERE length(c_mktsegment)>8")
def pf10(s, d):
    return table(s, d, "customer").where(F.length("c_mktsegment") > 8).select("c_custkey")


@query("pf11_fill", f"{w.EVENTS}, t AS (SELECT user_id, count(*) AS n FROM twd WHERE amount>95 GROUP BY 1) SELECT user_id, coalesce(n,0) AS n, 4 AS min_hops, 'isolated' AS level FROM users LEFT JOIN t USING(user_id)")
def pf11(s, d):
    t = w.twd(s, d).where("amount > 95").groupBy("user_id").agg(F.count("*").alias("n"))
    wide = w.users(s, d).select("user_id").join(t, "user_id", "left").select("user_id", "n", F.lit(None).cast("int").alias("min_hops"), F.lit(None).cast("string").alias("level"))
    return wide.fillna({"n": 0, "min_hops": 4, "level": "isolated"})


@query("pf12_ensure_columns", "SELECT c_custkey, c_acctbal, 0 AS missing FROM customer")
def pf12(s, d):
    return clean.ensure(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "missing"])


@query("pf13_rename_unify", f"{w.EVENTS} SELECT user_id, created_at, 'swap' AS source_table FROM swaps UNION ALL SELECT user_id, created_at, 'trade' FROM trades")
def pf13(s, d):
    a = w.swaps(s, d).select("user_id", "created_at", F.lit("swap").alias("source_table"))
    return a.unionByName(w.trades(s, d).withColumnRenamed("created_at", "updated_at").withColumnRenamed("updated_at", "created_at").select("user_id", "created_at", F.lit("trade").alias("source_table")))


@query("pf14_account_age", f"{w.EVENTS} SELECT user_id, CASE WHEN confirmed_at IS NULL THEN -1 ELSE CAST(floor(epoch(TIMESTAMP '2026-03-26'-confirmed_at)/86400) AS BIGINT) END AS age FROM users")
def pf14(s, d):
    return w.users(s, d).select("user_id", clean.account_age_days(F.col("confirmed_at")).alias("age"))


@query("pf15_derived_ratios", f"{w.EVENTS}, t AS (SELECT user_id, count(*) FILTER (kind=0) AS d, count(*) FILTER (kind=1) AS w FROM twd GROUP BY 1) SELECT user_id, CAST(d>0 AND w=0 AS INT) AS deposit_only_flag, round(d/(d+w+1),6) AS twd_deposit_ratio FROM t")
def pf15(s, d):
    t = w.twd(s, d).groupBy("user_id").agg(F.count_if(F.col("kind") == 0).alias("d"), F.count_if(F.col("kind") == 1).alias("w"))
    return t.select("user_id", ((F.col("d") > 0) & (F.col("w") == 0)).cast("int").alias("deposit_only_flag"), F.round(F.col("d") / (F.col("d") + F.col("w") + 1), 6).alias("twd_deposit_ratio"))


@query("pf16_safe_divide", f"WITH {HOPS} SELECT id, round(bal/CASE WHEN hops=0 THEN 1 ELSE hops END,6) AS a, round(bal/nullif(hops,0),6) AS b FROM h")
def pf16(s, d):
    return _hops(s, d).select("id", F.round(clean.over(F.col("bal"), F.col("hops")), 6).alias("a"), F.round(clean.ratio(F.col("bal"), F.col("hops")), 6).alias("b"))


@query("pf17_hop_risk_level", f"WITH {HOPS} SELECT id, CASE hops WHEN 0 THEN 'blacklist' WHEN 1 THEN 'direct' WHEN 2 THEN 'indirect_2' WHEN 3 THEN 'indirect_3' ELSE 'isolated' END AS level FROM h")
def pf17(s, d):
    return _hops(s, d).select("id", risk.hop_risk_level(F.col("hops")).alias("level"))


@query("pf18_weighted_label", f"WITH {HOPS} SELECT id, CASE WHEN hops<=2 AND ip>3 AND fast THEN 'HIGH_WEIGHTED' WHEN hops=0 THEN 'BLACKLIST' WHEN hops=1 THEN 'HIGH' WHEN hops IN (2,3) THEN 'MEDIUM' ELSE 'LOW' END AS label FROM h")
def pf18(s, d):
    return _hops(s, d).select("id", risk.weighted_label(F.col("hops"), F.col("ip"), F.col("fast")).alias("label"))


@query("pf19_mule_score", f"WITH {HOPS} SELECT id, CAST(fast AS INT)+CAST(ip>3 AS INT)+CAST(bal>5000 AS INT)+CAST(hops IN (1,2) AS INT) AS score FROM h")
def pf19(s, d):
    return _hops(s, d).select("id", risk.mule_score(F.col("fast"), F.col("ip") > 3, F.col("bal") > 5000, F.col("hops")).alias("score"))


@query("pf20_asymmetry_flag", "SELECT o_orderkey, coalesce((o_custkey%3=0 AND o_totalprice>100000) OR (o_custkey%3=1 AND o_totalprice>300000),false) AS flag, CASE WHEN o_custkey%3=0 AND o_totalprice>100000 THEN 'L0 volume '||printf('%.2f',o_totalprice) WHEN o_custkey%3=1 AND o_totalprice>300000 THEN 'L1 volume '||printf('%.2f',o_totalprice) END AS reason FROM orders")
def pf20(s, d):
    a = (F.pmod("o_custkey", F.lit(3)), F.col("o_totalprice"), F.lit(0.0), 1e5, 3e5)
    return table(s, d, "orders").select("o_orderkey", risk.asymmetry_flag(*a).alias("flag"), risk.asymmetry_reason(*a).alias("reason"))


TIER = "CASE WHEN p>0.90 THEN 'EXTREME' WHEN p>=0.65 AND p<=0.75 THEN 'BOUNDARY' WHEN p>0.75 THEN 'HIGH' WHEN p>=0.5 THEN 'MEDIUM' ELSE 'LOW' END"


@query("pf21_tier_routing", f"WITH {w.SCORED} SELECT doc_id, {TIER} AS tier FROM scored")
def pf21(s, d):
    return w.scored(s, d).select("doc_id", risk.tier(F.col("p")).alias("tier"))


@query("pf22_coarse_level", f"WITH {w.SCORED} SELECT doc_id, CASE WHEN p>=0.75 THEN 'HIGH' WHEN p>=0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM scored")
def pf22(s, d):
    return w.scored(s, d).select("doc_id", risk.coarse_level(F.col("p")).alias("level"))


@query("pf23_display_level", f"WITH {w.SCORED} SELECT doc_id, CASE WHEN p>=0.5 THEN 'very high' WHEN p>=0.24 THEN 'high' WHEN p>=0.12 THEN 'medium' ELSE 'low' END AS level FROM scored")
def pf23(s, d):
    return w.scored(s, d).select("doc_id", risk.display_level(F.col("p"), 0.24).alias("level"))


@query("pf24_policy_lookup", f"WITH {w.SCORED}, t AS (SELECT doc_id, {TIER} AS tier FROM scored) SELECT doc_id, tier, CASE tier WHEN 'EXTREME' THEN 'FREEZE_ACCOUNT' WHEN 'HIGH' THEN 'LOCK_ACCOUNT' WHEN 'BOUNDARY' THEN 'ENHANCED_KYC' ELSE 'WATCH_ONLY' END AS primary_action, CAST(CASE tier WHEN 'EXTREME' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'BOUNDARY' THEN 3 ELSE 4 END AS INT) AS execution_priority, CASE tier WHEN 'EXTREME' THEN 4 WHEN 'HIGH' THEN 4 WHEN 'BOUNDARY' THEN 4 ELSE 2 END AS n_steps FROM t")
def pf24(s, d):
    t = risk.with_actions(w.scored(s, d).select("doc_id", risk.tier(F.col("p")).alias("tier")), "event")
    return t.select("doc_id", "tier", "primary_action", "execution_priority", F.size("steps").alias("n_steps"))


@query("pf25_forced_override", f"WITH {w.SCORED}, t AS (SELECT doc_id, {TIER} AS tier FROM scored) SELECT doc_id, CASE tier WHEN 'EXTREME' THEN 'FREEZE_ACCOUNT' ELSE 'proposed' END AS primary_action, CAST(CASE tier WHEN 'EXTREME' THEN 1 ELSE 9 END AS INT) AS execution_priority FROM t")
def pf25(s, d):
    t = w.scored(s, d).select("doc_id", risk.tier(F.col("p")).alias("tier"), F.lit("proposed").alias("primary_action"), F.lit(False).alias("auto_executable"), F.lit(9).alias("execution_priority"), F.lit(None).cast("int").alias("str_deadline_hours"), F.lit(None).cast("int").alias("freeze_duration_days"))
    return risk.forced_freeze(t).select("doc_id", "primary_action", "execution_priority")


@query("pf26_threshold_decision", f"WITH {w.SCORED} SELECT doc_id, CAST(p>=0.24 AS INT) AS status FROM scored")
def pf26(s, d):
    return w.scored(s, d).select("doc_id", (F.col("p") >= 0.24).cast("int").alias("status"))


@query("pf27_bins", f"WITH {w.SCORED} SELECT CASE WHEN p<=0 THEN NULL WHEN p<=0.3 THEN '(0, 0.3]' WHEN p<=0.5 THEN '(0.3, 0.5]' WHEN p<=0.65 THEN '(0.5, 0.65]' WHEN p<=0.75 THEN '(0.65, 0.75]' WHEN p<=0.9 THEN '(0.75, 0.9]' ELSE '(0.9, 1]' END AS bin, count(*) AS n FROM scored GROUP BY 1")
def pf27(s, d):
    return w.scored(s, d).groupBy(risk.probability_bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"))


@query("pf28_cold_start", f"{w.EVENTS}, b AS (SELECT user_id, count(*) FILTER (kind=0) AS n FROM twd WHERE user_id%3<>0 GROUP BY 1), h AS (SELECT user_id, CAST(user_id%4 AS INT) AS hops FROM users WHERE user_id%2=0) SELECT coalesce(b.user_id,h.user_id) AS user_id, CAST(coalesce(n,0) AS DOUBLE) AS twd_deposit_count, CAST(coalesce(hops,4) AS DOUBLE) AS min_hops_to_blacklist, 9999.0::DOUBLE AS min_retention_minutes FROM b FULL JOIN h ON b.user_id=h.user_id")
def pf28(s, d):
    b = w.twd(s, d).where("user_id % 3 <> 0").groupBy("user_id").agg(F.count_if(F.col("kind") == 0).alias("twd_deposit_count"))
    h = w.users(s, d).where("user_id % 2 = 0").select("user_id", F.pmod("user_id", F.lit(4)).alias("min_hops_to_blacklist"))
    return risk.cold_start(b, h).select("user_id", "twd_deposit_count", "min_hops_to_blacklist", "min_retention_minutes")


@query("pf29_ip_verdicts", f"WITH {HOPS} SELECT id, CASE WHEN hops>5 THEN 'many places' ELSE 'normal' END AS ip_spread, CASE WHEN ip>10 THEN 'cluster' WHEN ip>3 THEN 'group' WHEN ip>1 THEN 'pair' ELSE 'alone' END AS ip_sharing, CASE WHEN bal<10 THEN 'pass-through' WHEN bal<30 THEN 'short' ELSE 'normal' END AS retention FROM h")
def pf29(s, d):
    v = risk.ip_verdicts(F.col("hops"), F.col("ip"), F.col("bal"))
    return _hops(s, d).select("id", *[c.alias(n) for n, c in v.items()])


@query("pf30_cold_wallet", f"WITH {HOPS} SELECT id, coalesce(ip/nullif(ip+hops,0)>=0.7 AND ip>=3,false) AS alert FROM h")
def pf30(s, d):
    return _hops(s, d).select("id", risk.cold_wallet_alert(F.col("ip"), F.col("hops")).alias("alert"))


@query("pf31_clip", "SELECT c_custkey, least(1e9,greatest(0.0,c_acctbal))::DOUBLE AS total_twd_volume FROM customer")
def pf31(s, d):
    return risk.clipped(table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("total_twd_volume")))


@query("v1_submission_problems", f"{w.EVENTS}, sub AS (SELECT user_id, CAST(user_id%3 AS INT) AS status FROM users WHERE user_id%5<>0 UNION ALL SELECT user_id, 0 FROM users WHERE user_id%50=1 UNION ALL SELECT user_id+100000, 1 FROM users WHERE user_id%40=2) SELECT 'duplicate id' AS problem, 'error' AS severity, count(*) AS n FROM (SELECT user_id FROM sub GROUP BY 1 HAVING count(*)>1) HAVING count(*)>0 UNION ALL SELECT 'status outside 0 and 1','error',count(*) FROM sub WHERE status NOT IN (0,1) HAVING count(*)>0 UNION ALL SELECT 'missing id','error',count(*) FROM users WHERE user_id NOT IN (SELECT user_id FROM sub) HAVING count(*)>0 UNION ALL SELECT 'extra id','warning',count(*) FROM (SELECT DISTINCT user_id FROM sub WHERE user_id NOT IN (SELECT user_id FROM users)) HAVING count(*)>0")
def v1(s, d):
    u = w.users(s, d).select("user_id")
    sub = u.where("user_id % 5 <> 0").select("user_id", F.pmod("user_id", F.lit(3)).cast("int").alias("status"))
    sub = sub.union(u.where("user_id % 50 = 1").select("user_id", F.lit(0))).union(u.where("user_id % 40 = 2").select(F.col("user_id") + 100000, F.lit(1)))
    return validate.submission_problems(sub, u)


@query("v2_tables_present", "SELECT 'orders' AS name, true AS present UNION ALL SELECT 'nothing', false")
def v2(s, d):
    return validate.tables_present(s, d, ["orders", "nothing"])


@query("v3_flag_rate", "SELECT count(*) AS total, count(*) FILTER (toxic=1) AS flagged, round(count(*) FILTER (toxic=1)/count(*),6) AS rate FROM labels")
def v3(s, d):
    return validate.flag_rate(table(s, d, "labels"), "toxic").withColumn("rate", F.round("rate", 6))


@query("v4_threshold_what_if", f"WITH {w.SCORED}, t AS (SELECT unnest([30,40,50,60,70,80,90]) AS t) SELECT t/100 AS threshold, count(*) FILTER (p*100>=t-1e-9) AS flagged FROM scored, t GROUP BY 1")
def v4(s, d):
    return evaluate.sweep(w.scored(s, d), 3000, 9000, 1000).select("threshold", (F.col("tp") + F.col("fp")).alias("flagged"))


@query("v5_user_drilldown", f"{w.EVENTS}, l AS (SELECT * FROM twd WHERE user_id=8 ORDER BY created_at DESC, event_id DESC LIMIT 10) SELECT event_id, amount, hour(created_at)>=22 OR hour(created_at)<=6 AS night, round(amount/(SELECT CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)/count(*) FROM twd),6) AS to_mean FROM l")
def v5(s, d):
    t = w.twd(s, d)
    mean = t.agg((F.sum(F.col("amount").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("m"))
    last = t.where("user_id = 8").orderBy(F.desc("created_at"), F.desc("event_id")).limit(10)
    # one row of the mean
    return last.join(F.broadcast(mean)).select("event_id", "amount", events.is_night(F.col("created_at")).alias("night"), F.round(F.col("amount") / F.col("m"), 6).alias("to_mean"))


@query("v6_error_listing", f"WITH {w.SCORED} SELECT doc_id, CASE WHEN p>=0.5 THEN 'FP' ELSE 'FN' END AS kind FROM scored WHERE (p>=0.5 AND y=0) OR (p<0.5 AND y=1)")
def v6(s, d):
    return validate.errors(w.scored(s, d), 0.5).select("doc_id", "kind")
