"""The engine's tables as views of the synthetic ones, and the same views as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators import graph
from talus.runtime import table


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ip = F.concat(F.lit("ip"), F.get_json_object("props", "$.k"))
    return e.select("event_id", (F.col("user_id") + 1).alias("user_id"), F.col("ts").alias("created_at"), "event_type", F.col("value").alias("amount"), ip.alias("source_ip"))


def twd(spark: SparkSession, d: str) -> DataFrame:
    """Deposits are signups, withdrawals are clicks."""
    e = events(spark, d).where(F.col("event_type").isin("signup", "click"))
    return e.select("event_id", "user_id", "created_at", F.when(F.col("event_type") == "signup", 0).otherwise(1).alias("kind"), "amount", "source_ip")


def crypto(spark: SparkSession, d: str) -> DataFrame:
    """Withdrawals are purchases, deposits are views."""
    e = events(spark, d).where(F.col("event_type").isin("purchase", "view"))
    return e.select("event_id", "user_id", "created_at", F.when(F.col("event_type") == "view", 0).otherwise(1).alias("kind"), "amount", F.lit(2.0).alias("twd_srate"), F.concat(F.lit("c"), F.pmod("event_id", F.lit(3)).cast("string")).alias("currency"), "source_ip")


def trades(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("event_type = 'error' AND event_id % 2 = 1")
    return e.select("user_id", "created_at", "amount", F.lit(3.0).alias("twd_srate"), "source_ip")


def swaps(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("event_type = 'error' AND event_id % 2 = 0")
    return e.select("user_id", "created_at", F.when(F.col("event_id") % 4 == 0, 0).otherwise(1).alias("kind"), "amount")


def users(spark: SparkSession, d: str) -> DataFrame:
    u = events(spark, d).select("user_id").distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n).cast("timestamp")
    m = F.pmod("user_id", F.lit(3))
    return u.select("user_id", F.when(m >= 1, day(1)).alias("level1_finished_at"), F.when(m == 2, day(2)).alias("level2_finished_at"), F.when(F.col("user_id") % 7 != 0, day(F.col("user_id").cast("int"))).alias("confirmed_at"), F.concat(F.lit("s"), F.pmod("user_id", F.lit(4)).cast("string")).alias("user_source"))


def shared_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the part and week that they bought it in."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    week = F.concat_ws("/", F.col("l_partkey").cast("string"), F.date_format(F.date_trunc("week", "l_shipdate"), "yyyy-MM-dd"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") + 1).alias("user_id"), week.alias("k")).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetric(graph.shared_key_edges(shared_weeks(spark, d), "k"))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal < -950").select((F.col("c_custkey") + 1).alias("node"))


def relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_custkey") + 1).alias("src"), (F.pmod(F.col("o_custkey") * 7 + F.col("o_orderkey"), F.lit(150)) + 1).alias("dst"))


def event_seeds(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("user_id % 17 = 0").select(F.col("user_id").alias("node")).distinct()


def scored(spark: SparkSession, d: str) -> DataFrame:
    p = F.pmod(F.col("doc_id") * 37, F.lit(101)) / 101
    q = F.pmod(F.col("doc_id") * 53, F.lit(103)) / 103
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"), p.alias("p"), q.alias("q"))


EV = "ev AS (SELECT event_id, user_id+1 AS user_id, ts AS created_at, event_type, value AS amount, 'ip'||json_extract_string(props,'$.k') AS source_ip FROM events)"
TWD = "twd AS (SELECT event_id, user_id, created_at, CASE WHEN event_type='signup' THEN 0 ELSE 1 END AS kind, amount, source_ip FROM ev WHERE event_type IN ('signup','click'))"
CRYPTO = "crypto AS (SELECT event_id, user_id, created_at, CASE WHEN event_type='view' THEN 0 ELSE 1 END AS kind, amount, 2.0::DOUBLE AS twd_srate, 'c'||(event_id%3) AS currency, source_ip FROM ev WHERE event_type IN ('purchase','view'))"
TRADES = "trades AS (SELECT user_id, created_at, amount, 3.0::DOUBLE AS twd_srate, source_ip FROM ev WHERE event_type='error' AND event_id%2=1)"
SWAPS = "swaps AS (SELECT user_id, created_at, CASE WHEN event_id%4=0 THEN 0 ELSE 1 END AS kind, amount FROM ev WHERE event_type='error' AND event_id%2=0)"
USERS = "users AS (SELECT DISTINCT user_id, user_id%3 AS m, CASE WHEN user_id%3=2 THEN 2 WHEN user_id%3=1 THEN 1 ELSE 0 END AS kyc_level, CASE WHEN user_id%7<>0 THEN CAST(DATE '2024-01-01' + CAST(user_id AS INT) AS TIMESTAMP) END AS confirmed_at, 's'||(user_id%4) AS user_source FROM ev)"
WEEKS = "weeks AS (SELECT DISTINCT o_custkey+1 AS user_id, l_partkey||'/'||strftime(date_trunc('week', l_shipdate),'%Y-%m-%d') AS k FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"
EDGES = f"{WEEKS}, edges AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM weeks a JOIN weeks b USING(k) WHERE a.user_id<>b.user_id)"
SEEDS = "seeds AS (SELECT c_custkey+1 AS node FROM customer WHERE c_acctbal < -950)"
RELATIONS = "relations AS (SELECT o_custkey+1 AS src, (o_custkey*7+o_orderkey)%150+1 AS dst FROM orders)"
ESEEDS = "eseeds AS (SELECT DISTINCT user_id AS node FROM ev WHERE user_id%17=0)"
SCORED = "scored AS (SELECT doc_id, quality AS y, ((doc_id*37)%101)/101.0::DOUBLE AS p, ((doc_id*53)%103)/103.0::DOUBLE AS q FROM labels)"
WALK = "walk(node,hops) AS (SELECT node, 0 FROM seeds UNION SELECT e.dst, w.hops+1 FROM walk w JOIN edges e ON e.src=w.node WHERE w.hops<3), dist AS (SELECT node, CAST(min(hops) AS INT) AS hops FROM walk GROUP BY node)"
EVENTS = f"WITH {EV}, {TWD}, {CRYPTO}, {TRADES}, {SWAPS}, {USERS}"
