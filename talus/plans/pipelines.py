"""Feature pipelines end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.functions import risk
from talus.operators import features
from talus.plans import world as w
from talus.plans.catalog import query
from talus.plans.graphs import RELN

PAIRS = "pr AS (SELECT t.user_id, t.created_at AS a, min(c.created_at) AS b FROM twd t LEFT JOIN crypto c ON c.user_id=t.user_id AND c.kind=1 AND c.created_at>t.created_at WHERE t.kind=0 GROUP BY 1,2), ret AS (SELECT u.user_id, round(min(epoch_us(b)-epoch_us(a))/6e7,6) AS min_retention_minutes, count(DISTINCT CASE WHEN b IS NOT NULL THEN a END) AS retention_event_count, coalesce(min(epoch_us(b)-epoch_us(a))/6e7<10,false) AS high_speed_risk FROM (SELECT DISTINCT user_id FROM twd) u LEFT JOIN pr USING(user_id) GROUP BY 1)"
VOLUME = "vol AS (SELECT user_id, CAST(sum(v) AS DOUBLE) AS v FROM (SELECT user_id, CAST(amount AS DECIMAL(18,2)) AS v FROM twd UNION ALL SELECT user_id, CAST(amount*2 AS DECIMAL(18,2)) FROM crypto UNION ALL SELECT user_id, CAST(amount*3 AS DECIMAL(18,2)) FROM trades) GROUP BY 1), uv AS (SELECT user_id, kyc_level, coalesce(v,0) AS total_twd_volume FROM users LEFT JOIN vol USING(user_id)), asy AS (SELECT user_id, kyc_level, total_twd_volume, (total_twd_volume-avg(total_twd_volume) OVER (PARTITION BY kyc_level))/nullif(stddev_samp(total_twd_volume) OVER (PARTITION BY kyc_level),0) AS z FROM uv)"
FLAG = "coalesce((kyc_level=0 AND total_twd_volume>100000) OR (kyc_level=1 AND total_twd_volume>1000000),false) OR coalesce(abs(z)>3,false)"
UEDGES = "um AS (SELECT DISTINCT user_id, source_ip||'/'||strftime(date_trunc('hour',created_at),'%Y-%m-%d %H') AS k FROM ev), uedges AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM um a JOIN um b USING(k) WHERE a.user_id<>b.user_id)"


def _hops(s, d):
    """Hops over users that share an address within an hour."""
    k = F.concat_ws("/", "source_ip", F.date_format(F.date_trunc("hour", "created_at"), "yyyy-MM-dd HH"))
    return features.key_hops(w.events(s, d).withColumn("k", k), "k", w.event_seeds(s, d))


@query("f1_retention_time", f"{w.EVENTS}, {PAIRS} SELECT * FROM ret")
def f1(s, d):
    return features.retention(w.twd(s, d), w.crypto(s, d)).withColumn("min_retention_minutes", F.round("min_retention_minutes", 6))


@query("f2_ip_anomaly", f"{w.EVENTS} SELECT user_id, count(DISTINCT source_ip) AS unique_ip_count, 'fallback' AS ip_source, count(DISTINCT source_ip)>3 AS ip_anomaly FROM (SELECT user_id, source_ip FROM twd UNION ALL SELECT user_id, source_ip FROM crypto) GROUP BY 1")
def f2(s, d):
    return features.ip_anomaly([w.twd(s, d), w.crypto(s, d)])


@query("f3_volume_asymmetry", f"{w.EVENTS}, {VOLUME} SELECT user_id, kyc_level, round(total_twd_volume,2) AS total_twd_volume, round(z,4) AS volume_zscore, {FLAG} AS asymmetry_flag FROM asy")
def f3(s, d):
    v = features.volume_asymmetry(w.users(s, d), w.twd(s, d), w.crypto(s, d), w.trades(s, d))
    return v.select("user_id", "kyc_level", F.round("total_twd_volume", 2).alias("total_twd_volume"), F.round("volume_zscore", 4).alias("volume_zscore"), "asymmetry_flag")


HOPS = f"WITH RECURSIVE {w.EV}, {w.TWD}, {w.CRYPTO}, {w.TRADES}, {w.USERS}, {UEDGES}, {w.ESEEDS}, uwalk(node,hops) AS (SELECT node, 0 FROM eseeds WHERE node IN (SELECT src FROM uedges) UNION SELECT e.dst, x.hops+1 FROM uwalk x JOIN uedges e ON e.src=x.node WHERE x.hops<3), ud AS (SELECT node, min(hops) AS hops FROM uwalk GROUP BY 1), unb AS (SELECT src AS node, count(DISTINCT dst) AS n FROM uedges WHERE dst IN (SELECT node FROM eseeds) GROUP BY 1), uh AS (SELECT DISTINCT src AS user_id, coalesce(ud.hops,4) AS h, coalesce(unb.n,0) AS n FROM uedges LEFT JOIN ud ON src=ud.node LEFT JOIN unb ON src=unb.node)"


@query("f4_graph_hops", f"{HOPS} SELECT user_id, h AS min_hops_to_blacklist, h=1 AS is_direct_neighbor, n AS blacklist_neighbor_count, h<=3 AS in_blacklist_network FROM uh")
def f4(s, d):
    return _hops(s, d).drop("hop_risk_level")


MULE = f"{HOPS}, {PAIRS}, {VOLUME}, ipa AS (SELECT user_id, count(DISTINCT source_ip) AS u FROM (SELECT user_id, source_ip FROM twd UNION ALL SELECT user_id, source_ip FROM crypto) GROUP BY 1), mule AS (SELECT asy.user_id, kyc_level, total_twd_volume, z, {FLAG} AS asym, min_retention_minutes, coalesce(retention_event_count,0) AS rc, coalesce(high_speed_risk,false) AS hs, coalesce(u,0) AS u, coalesce(u>3,false) AS ipf, coalesce(h,4) AS h, coalesce(n,0) AS n FROM asy LEFT JOIN ret USING(user_id) LEFT JOIN ipa USING(user_id) LEFT JOIN uh USING(user_id))"


@query("f5_mule_features", f"{MULE} SELECT user_id, kyc_level, min_retention_minutes, rc AS retention_event_count, hs AS high_speed_risk, u AS unique_ip_count, ipf AS ip_anomaly, asym AS asymmetry_flag, h AS min_hops_to_blacklist, n AS blacklist_neighbor_count, CAST(hs AS INT)+CAST(ipf AS INT)+CAST(asym AS INT)+CAST(h IN (1,2) AS INT) AS mule_risk_score FROM mule")
def f5(s, d):
    m = features.mule_features(w.users(s, d), w.twd(s, d), w.crypto(s, d), w.trades(s, d), _hops(s, d))
    return m.select("user_id", "kyc_level", F.round("min_retention_minutes", 6).alias("min_retention_minutes"), "retention_event_count", "high_speed_risk", "unique_ip_count", "ip_anomaly", "asymmetry_flag", "min_hops_to_blacklist", "blacklist_neighbor_count", "mule_risk_score")


@query("f6_canonical_features", f"{MULE}, cn AS (SELECT user_id, count(*) FILTER (t='t' AND kind=0) AS a, count(*) FILTER (t='t' AND kind=1) AS b, count(*) FILTER (t='c' AND kind=0) AS c, count(*) FILTER (t='c' AND kind=1) AS e FROM (SELECT user_id, 't' AS t, kind FROM twd UNION ALL SELECT user_id, 'c', kind FROM crypto) GROUP BY 1), nt AS (SELECT user_id, avg(CAST(hour(created_at)>=22 OR hour(created_at)<=6 AS INT)) AS r FROM twd GROUP BY 1) SELECT user_id, kyc_level::DOUBLE AS kyc_level, min_retention_minutes, rc::DOUBLE AS retention_event_count, u::DOUBLE AS unique_ip_count, round(total_twd_volume,2) AS total_twd_volume, h::DOUBLE AS min_hops_to_blacklist, coalesce(a,0)::DOUBLE AS twd_deposit_count, coalesce(b,0)::DOUBLE AS twd_withdraw_count, coalesce(c,0)::DOUBLE AS crypto_deposit_count, coalesce(e,0)::DOUBLE AS crypto_withdraw_count, round(coalesce(r,0),6) AS night_tx_ratio FROM mule LEFT JOIN cn USING(user_id) LEFT JOIN nt USING(user_id)")
def f6(s, d):
    t, c = w.twd(s, d), w.crypto(s, d)
    m = features.mule_features(w.users(s, d), t, c, w.trades(s, d), _hops(s, d))
    keep = ("kyc_level", "retention_event_count", "unique_ip_count", "min_hops_to_blacklist", "twd_deposit_count", "twd_withdraw_count", "crypto_deposit_count", "crypto_withdraw_count")
    return features.canonical(m, t, c).select("user_id", *keep, F.round("min_retention_minutes", 6).alias("min_retention_minutes"), F.round("total_twd_volume", 2).alias("total_twd_volume"), F.round("night_tx_ratio", 6).alias("night_tx_ratio"))


BEHAVIOUR = f"""{w.EVENTS}, {w.RELATIONS}, {w.ESEEDS}, {RELN}, tg AS (SELECT *, date_diff('microsecond', lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, kind, amount), created_at)/1e6 AS gap FROM twd),
t AS (SELECT user_id, count(*) FILTER (kind=0) AS td, count(*) FILTER (kind=1) AS tw, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS vol, count(*) FILTER (gap<60) AS fast, count(DISTINCT source_ip) AS ips, count(*) FILTER (hour(created_at)>=22 OR hour(created_at)<=5)/count(*) AS night FROM tg GROUP BY 1),
pi AS (SELECT source_ip, count(DISTINCT user_id) AS u FROM twd GROUP BY 1), sh AS (SELECT user_id, max(u) AS mx, count(*) FILTER (u>1) AS an FROM twd JOIN pi USING(source_ip) GROUP BY 1),
c AS (SELECT user_id, count(*) FILTER (kind=0) AS cd, count(*) FILTER (kind=1) AS cw, count(DISTINCT currency) AS cc, (CAST(floor(epoch(max(created_at))) AS BIGINT)-CAST(floor(epoch(min(created_at))) AS BIGINT))/60 AS span FROM crypto GROUP BY 1),
sw AS (SELECT user_id, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS v, count(*) FILTER (kind=0) AS b FROM swaps GROUP BY 1), tr AS (SELECT user_id, count(*) AS n FROM trades GROUP BY 1)"""


@query("f7_behaviour_features", f"{BEHAVIOUR} SELECT u.user_id, CASE WHEN confirmed_at IS NULL THEN -1 ELSE CAST(floor(epoch(TIMESTAMP '2026-03-26'-confirmed_at)/86400) AS BIGINT) END AS age, kyc_level, coalesce(td,0) AS twd_deposit_count, coalesce(tw,0) AS twd_withdraw_count, round(coalesce(vol,0),2) AS total_twd_volume, round(coalesce(night,0),6) AS night_tx_ratio, coalesce(fast,0) AS high_speed_risk, coalesce(ips,0) AS unique_ip_count, coalesce(mx,0) AS max_ip_shared_users, coalesce(an,0) AS ip_anomaly, coalesce(cd,0) AS crypto_deposit_count, coalesce(cw,0) AS crypto_withdraw_count, coalesce(cc,0) AS crypto_currency_count, round(coalesce(span,0),6) AS min_retention_minutes, coalesce(tr.n,0) AS usdt_tx_count, coalesce(sw.n,0) AS swap_count, round(coalesce(sw.v,0),2) AS swap_twd_volume, round(coalesce(sw.b/sw.n,0),6) AS swap_buy_ratio, coalesce(reln.n,0) AS blacklist_neighbor_count, CAST(coalesce(reln.n,0)>0 AS INT) AS is_direct_neighbor, coalesce(cd,0)-coalesce(cw,0) AS crypto_net_flow FROM users u LEFT JOIN t USING(user_id) LEFT JOIN sh USING(user_id) LEFT JOIN c USING(user_id) LEFT JOIN sw USING(user_id) LEFT JOIN tr USING(user_id) LEFT JOIN reln ON reln.node=u.user_id")
def f7(s, d):
    b = features.behaviour(w.users(s, d), w.twd(s, d), w.crypto(s, d), w.trades(s, d), w.swaps(s, d), w.relations(s, d), w.event_seeds(s, d))
    plain = ("user_id", "age", "kyc_level", "twd_deposit_count", "twd_withdraw_count", "high_speed_risk", "unique_ip_count", "max_ip_shared_users", "ip_anomaly", "crypto_deposit_count", "crypto_withdraw_count", "crypto_currency_count", "usdt_tx_count", "swap_count", "blacklist_neighbor_count", "is_direct_neighbor", "crypto_net_flow")
    return b.select(*plain, *[F.round(c, n).alias(c) for c, n in (("total_twd_volume", 2), ("night_tx_ratio", 6), ("min_retention_minutes", 6), ("swap_twd_volume", 2), ("swap_buy_ratio", 6))])


@query("f8_base_features", f"{BEHAVIOUR} SELECT u.user_id, kyc_level, coalesce(td,0) AS twd_deposit_count, coalesce(tw,0) AS twd_withdraw_count, coalesce(ips,0)>5 AS ip_anomaly, coalesce(cd,0) AS crypto_deposit_count FROM users u LEFT JOIN t USING(user_id) LEFT JOIN c USING(user_id)")
def f8(s, d):
    b = features.behaviour(w.users(s, d), w.twd(s, d), w.crypto(s, d), w.trades(s, d), w.swaps(s, d), w.relations(s, d), w.event_seeds(s, d))
    return b.select("user_id", "kyc_level", "twd_deposit_count", "twd_withdraw_count", (F.col("unique_ip_count") > 5).alias("ip_anomaly"), "crypto_deposit_count")


@query("f9_ip_features", f"{w.EVENTS}, m AS (SELECT DISTINCT user_id, source_ip FROM twd), c AS (SELECT source_ip, count(*) AS n FROM m GROUP BY 1), f AS (SELECT DISTINCT user_id FROM twd WHERE (event_id%2000)<600) SELECT user_id, max(n) AS ip_shared_user_count, user_id IN (SELECT user_id FROM f) AS has_high_speed_risk FROM m JOIN c USING(source_ip) GROUP BY 1")
def f9(s, d):
    done = F.timestamp_seconds(F.unix_timestamp(F.col("created_at").cast("timestamp")) + F.col("event_id") % 2000)
    return features.ip_features(w.twd(s, d).withColumn("completed_at", done))


@query("f10_behaviour_ingest", f"{MULE}, cn AS (SELECT user_id, count(*) FILTER (t='t' AND kind=0) AS a, count(*) FILTER (t='t' AND kind=1) AS b, count(*) FILTER (t='c' AND kind=1) AS e FROM (SELECT user_id, 't' AS t, kind FROM twd UNION ALL SELECT user_id, 'c', kind FROM crypto) GROUP BY 1) SELECT user_id, CAST(hs AS INT)+CAST(ipf AS INT)+CAST(asym AS INT)+CAST(h IN (1,2) AS INT) AS mule_risk_score, coalesce(a,0) AS twd_deposit_count, coalesce(b,0) AS twd_withdraw_count, coalesce(e,0) AS crypto_withdraw_count, '2026-03-26' AS event_time FROM mule LEFT JOIN cn USING(user_id)")
def f10(s, d):
    t, c = w.twd(s, d), w.crypto(s, d)
    m = features.mule_features(w.users(s, d), t, c, w.trades(s, d), _hops(s, d)).select("user_id", "mule_risk_score")
    return features.behaviour_ingest(m, t, c, F.lit("2026-03-26"))


@query("f11_user_context", f"{w.EVENTS}, b AS (SELECT user_id, CAST(count(DISTINCT source_ip) AS DOUBLE) AS u FROM twd WHERE user_id%4<>0 GROUP BY 1), h AS (SELECT user_id, CAST(user_id%4 AS DOUBLE) AS k FROM users WHERE user_id%5=0) SELECT coalesce(b.user_id,h.user_id) AS user_id, coalesce(u,1.0) AS unique_ip_count, coalesce(k,4.0) AS min_hops_to_blacklist, false AS is_cold_start FROM b FULL JOIN h ON b.user_id=h.user_id")
def f11(s, d):
    b = w.twd(s, d).where("user_id % 4 <> 0").groupBy("user_id").agg(F.count_distinct("source_ip").alias("unique_ip_count"))
    h = w.users(s, d).where("user_id % 5 = 0").select("user_id", F.pmod("user_id", F.lit(4)).alias("min_hops_to_blacklist"))
    return features.user_context(b, h).select("user_id", "unique_ip_count", "min_hops_to_blacklist", "is_cold_start")


def flagship(s, d):
    """Retention, night share and address count per user: scan, JSON, filter, window, aggregate and join."""
    t = w.twd(s, d)
    ips = t.groupBy("user_id").agg(F.count_distinct("source_ip").alias("unique_ip_count"))
    return features.retention(t, w.crypto(s, d)).join(features.night_ratio(t), "user_id").join(ips, "user_id")
