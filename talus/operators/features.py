"""Per-user feature pipelines: DataFrame in, DataFrame out. Tables are (user_id, created_at, kind, amount, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import clean, risk
from talus.operators import graph
from talus.operators.events import gaps, gaps_split, has_hot_key, is_night, next_after, next_after_split, zscore
from talus.runtime import stage


def retention(twd: DataFrame, crypto: DataFrame, minutes: float = 10) -> DataFrame:
    """Time from a deposit (twd, kind 0) to the next crypto withdrawal (kind 1), per user of twd.

    Users without a pair have a null minimum, no events and no risk.
    """
    a = twd.where("kind = 0").select("user_id", "created_at", F.lit(True).alias("deposit"))
    b = crypto.where("kind = 1").select("user_id", "created_at", F.lit(False).alias("deposit"))
    both = a.union(b)
    follow = next_after_split if has_hot_key(both, "user_id") else next_after  # the same rows either way
    pairs = follow(both, "user_id", "created_at", F.col("deposit"), ~F.col("deposit"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    pairs = pairs.withColumn("m", (micros("next_end") - micros("created_at")) / 6e7)
    per = pairs.groupBy("user_id").agg(F.min("m").alias("min_retention_minutes"), F.count_distinct(F.when(F.col("next_end").isNotNull(), F.col("created_at"))).alias("retention_event_count"))
    out = twd.select("user_id").distinct().join(per, "user_id", "left")
    return out.select("user_id", "min_retention_minutes", F.coalesce("retention_event_count", F.lit(0)).alias("retention_event_count"), F.coalesce(F.col("min_retention_minutes") < minutes, F.lit(False)).alias("high_speed_risk"))


def ip_anomaly(tables: list[DataFrame], login: DataFrame | None = None, threshold: int = 3) -> DataFrame:
    """Distinct addresses per user: of the login log if there is one, else of all tables."""
    source = "login" if login is not None else "fallback"
    rows = [login] if login is not None else tables
    ips = reduce(DataFrame.union, [t.select("user_id", "source_ip") for t in rows])
    per = ips.groupBy("user_id").agg(F.count_distinct("source_ip").alias("unique_ip_count"))
    return per.select("user_id", "unique_ip_count", F.lit(source).alias("ip_source"), (F.col("unique_ip_count") > threshold).alias("ip_anomaly"))


def volume_asymmetry(users: DataFrame, twd: DataFrame, crypto: DataFrame, trades: DataFrame, swaps: DataFrame | None = None, l1: float = 1e6, l0: float = 1e5) -> DataFrame:
    """Total volume per user against what the KYC level allows and the level's own spread. Swap volume counts."""
    parts = [twd.select("user_id", F.abs("amount").alias("v")), crypto.select("user_id", F.abs(F.col("amount") * F.coalesce("twd_srate", F.lit(1.0))).alias("v")), trades.select("user_id", F.abs(F.col("amount") * F.coalesce("twd_srate", F.lit(1.0))).alias("v"))]
    if swaps is not None:
        parts.append(swaps.select("user_id", F.abs("amount").alias("v")))
    total = reduce(DataFrame.union, parts).groupBy("user_id").agg(F.sum(F.coalesce("v", F.lit(0.0))).alias("total_twd_volume"))
    base = users.select("user_id", clean.kyc_level(F.col("level1_finished_at"), F.col("level2_finished_at")).alias("kyc_level")).join(total, "user_id", "left")
    base = zscore(base.withColumn("total_twd_volume", F.coalesce("total_twd_volume", F.lit(0.0))), "kyc_level", "total_twd_volume", "volume_zscore")
    args = (F.col("kyc_level"), F.col("total_twd_volume"), F.col("volume_zscore"), l0, l1)
    return base.select("*", risk.asymmetry_flag(*args).alias("asymmetry_flag"), risk.asymmetry_reason(*args).alias("asymmetry_reason"))


def graph_hops(edges: DataFrame, seeds: DataFrame, max_hops: int = 3) -> DataFrame:
    """Hop columns of every node with an edge; only seeds with edges are searched from."""
    edges = stage(edges.select("src", "dst"), "edges")
    nodes = edges.select(F.col("src").alias("node")).distinct()
    return _hop_columns(nodes, graph.distances(edges, seeds, max_hops, keep_isolated_seeds=False, written=True), graph.neighbour_counts(edges, seeds), max_hops)


def key_hops(members: DataFrame, key: str, seeds: DataFrame, max_hops: int = 3) -> DataFrame:
    """graph_hops of the users (user_id) that share a key value, without the pairs of a value's users."""
    m = graph.key_members(members, key)
    return _hop_columns(m.select("node").distinct(), graph.key_distances(m, seeds, max_hops), graph.key_neighbour_counts(m, seeds), max_hops)


def _hop_columns(nodes: DataFrame, hops: DataFrame, near: DataFrame, max_hops: int) -> DataFrame:
    joined = nodes.join(hops, "node", "left").join(near, "node", "left")
    d = F.coalesce("hops", F.lit(max_hops + 1))
    return joined.select(F.col("node").alias("user_id"), d.alias("min_hops_to_blacklist"), (d == 1).alias("is_direct_neighbor"), F.coalesce("n", F.lit(0)).alias("blacklist_neighbor_count"), (d <= max_hops).alias("in_blacklist_network"), risk.hop_risk_level(d).alias("hop_risk_level"))


def mule_features(users: DataFrame, twd: DataFrame, crypto: DataFrame, trades: DataFrame, hops: DataFrame, max_hops: int = 3) -> DataFrame:
    """Retention, addresses, asymmetry and hops (of graph_hops or key_hops) of every user, with the four-flag score."""
    joined = (
        volume_asymmetry(users, twd, crypto, trades)
        .join(retention(twd, crypto), "user_id", "left").join(ip_anomaly([twd, crypto]), "user_id", "left").join(hops, "user_id", "left")
        .fillna({"retention_event_count": 0, "unique_ip_count": 0, "blacklist_neighbor_count": 0, "min_hops_to_blacklist": max_hops + 1, "hop_risk_level": "isolated"})
    )
    flags = ("high_speed_risk", "ip_anomaly", "is_direct_neighbor", "in_blacklist_network")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})
    return joined.withColumn("mule_risk_score", risk.mule_score(F.col("high_speed_risk"), F.col("ip_anomaly"), F.col("asymmetry_flag"), F.col("min_hops_to_blacklist")))


def counts_by_kind(twd: DataFrame, crypto: DataFrame) -> DataFrame:
    """The four transfer counts per user in one pass over both tables."""
    both = twd.select("user_id", F.lit("twd").alias("t"), "kind").union(crypto.select("user_id", F.lit("crypto").alias("t"), "kind"))
    cell = lambda t, k: F.count_if((F.col("t") == t) & (F.col("kind") == k))
    return both.groupBy("user_id").agg(cell("twd", 0).alias("twd_deposit_count"), cell("twd", 1).alias("twd_withdraw_count"), cell("crypto", 0).alias("crypto_deposit_count"), cell("crypto", 1).alias("crypto_withdraw_count"))


def night_ratio(twd: DataFrame, last_hour: int = 6) -> DataFrame:
    return twd.groupBy("user_id").agg(F.avg(is_night(F.col("created_at"), last_hour).cast("int")).alias("night_tx_ratio"))


def canonical(mule: DataFrame, twd: DataFrame, crypto: DataFrame) -> DataFrame:
    """user_id and the canonical features in their order; a missing retention stays null."""
    out = mule.join(counts_by_kind(twd, crypto), "user_id", "left").join(night_ratio(twd), "user_id", "left")
    out = clean.ensure(out, list(risk.CANONICAL))
    zero = [c for c in risk.CANONICAL if c != "min_retention_minutes"]
    return out.select("user_id", *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in zero else F.col(c).cast("double")).alias(c) for c in risk.CANONICAL])


def _amount(when: Column | None = None) -> Column:
    a = F.coalesce("amount", F.lit(0.0))
    return F.when(when, a).otherwise(0.0) if when is not None else a


def behaviour(users: DataFrame, twd: DataFrame, crypto: DataFrame, trades: DataFrame, swaps: DataFrame, relations: DataFrame, seeds: DataFrame, as_of: str = "2026-03-26", last_hour: int = 5) -> DataFrame:
    """The behavioural set of 32 features, one row per user of users."""
    age = users.select("user_id", clean.account_age_days(F.col("confirmed_at"), as_of).alias("age"), clean.kyc_level(F.col("level1_finished_at"), F.col("level2_finished_at")).alias("kyc_level"), F.col("user_source"))
    paced = (gaps_split if has_hot_key(twd, "user_id") else gaps)(twd, "user_id", "created_at", "kind", "amount")  # the same rows either way
    t = paced.groupBy("user_id").agg(
        F.count_if(F.col("kind") == 0).alias("twd_deposit_count"), F.count_if(F.col("kind") == 1).alias("twd_withdraw_count"), F.sum(_amount()).alias("total_twd_volume"), F.avg("amount").alias("avg_twd_amount"),
        F.count_if(is_night(F.col("created_at"), last_hour)).alias("__night"), F.count("*").alias("__n"), F.count_if(F.col("gap_seconds") < 60).alias("high_speed_risk"), F.count_distinct("source_ip").alias("unique_ip_count"),
    ).withColumn("night_tx_ratio", clean.over(F.col("__night"), F.col("__n"))).drop("__night", "__n")
    per_ip = twd.where("source_ip IS NOT NULL").groupBy("source_ip").agg(F.count_distinct("user_id").alias("u"))
    shared = twd.join(per_ip, "source_ip").groupBy("user_id").agg(F.max("u").alias("max_ip_shared_users"), F.count_if(F.col("u") > 1).alias("ip_anomaly"))
    seconds = F.unix_timestamp(F.max("created_at").cast("timestamp")) - F.unix_timestamp(F.min("created_at").cast("timestamp"))
    c = crypto.groupBy("user_id").agg(F.count_if(F.col("kind") == 0).alias("crypto_deposit_count"), F.count_if(F.col("kind") == 1).alias("crypto_withdraw_count"), F.count_distinct("currency").alias("crypto_currency_count"), (seconds / 60).alias("min_retention_minutes"), F.count("*").alias("retention_event_count"))
    flow = twd.groupBy("user_id").agg(F.sum(_amount(F.col("kind") == 0)).alias("__d"), F.sum(_amount(F.col("kind") == 1)).alias("__w"))
    flow = flow.select("user_id", (clean.over(F.col("__w"), F.col("__d")) > 3).cast("int").alias("asymmetry_flag"))
    u = trades.groupBy("user_id").agg(F.count("*").alias("usdt_tx_count"))
    s = swaps.groupBy("user_id").agg(F.count("*").alias("swap_count"), F.sum(_amount()).alias("swap_twd_volume"), F.count_if(F.col("kind") == 0).alias("swap_buy_count"), F.count_if(F.col("kind") == 1).alias("swap_sell_count"))
    s = s.withColumn("swap_buy_ratio", clean.over(F.col("swap_buy_count"), F.col("swap_count")))
    groups = twd.select(F.col("source_ip").alias("key"), "user_id").union(crypto.select(F.concat(F.lit("c/"), F.col("source_ip")).alias("key"), "user_id"))
    near = graph.relation_counts(relations, groups, seeds).select(F.col("node").alias("user_id"), F.col("n").alias("blacklist_neighbor_count"))
    out = reduce(lambda a, b: a.join(b, "user_id", "left"), (t, shared, c, flow, u, s, near), age)
    out = out.fillna(0, [k for k in out.columns if k not in ("user_id", "user_source")])
    d, w = F.col("twd_deposit_count"), F.col("twd_withdraw_count")
    return out.withColumns({
        "is_direct_neighbor": (F.col("blacklist_neighbor_count") > 0).cast("int"), "deposit_only_flag": ((d > 0) & (w == 0)).cast("int"), "twd_deposit_ratio": d / (d + w + 1),
        "crypto_net_flow": F.col("crypto_deposit_count") - F.col("crypto_withdraw_count"), "tx_per_day": (d + w + F.col("crypto_deposit_count") + F.col("crypto_withdraw_count")) / F.greatest(F.col("age"), F.lit(1)),
        "total_volume": F.col("total_twd_volume") + F.col("swap_twd_volume"), "swap_to_twd_ratio": F.col("swap_twd_volume") / (F.col("total_twd_volume") + 1),
    })


def ip_features(rows: DataFrame, seconds: int = 600) -> DataFrame:
    """Per user with an address: the most users that share one of its addresses, and whether a transfer completed fast.

    rows: user_id, source_ip, created_at, completed_at.
    """
    m = rows.where("source_ip IS NOT NULL").select("user_id", "source_ip").distinct()
    shared = m.join(m.groupBy("source_ip").agg(F.count("*").alias("n")), "source_ip").groupBy("user_id").agg(F.max("n").alias("ip_shared_user_count"))
    duration = F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    fast = rows.where(duration < seconds).select("user_id", F.lit(True).alias("has_high_speed_risk")).distinct()
    return shared.join(fast, "user_id", "left").select("user_id", "ip_shared_user_count", F.coalesce("has_high_speed_risk", F.lit(False)).alias("has_high_speed_risk"))


def behaviour_ingest(mule: DataFrame, twd: DataFrame, crypto: DataFrame, as_of: Column) -> DataFrame:
    """Mule features joined with their counts, zero-filled, stamped."""
    counts = counts_by_kind(twd, crypto).select("user_id", "crypto_withdraw_count", "twd_deposit_count", "twd_withdraw_count")
    return mule.join(counts, "user_id", "left").fillna(0).withColumn("event_time", as_of)


def user_context(behaviour_rows: DataFrame, hop_rows: DataFrame) -> DataFrame:
    return risk.cold_start(behaviour_rows, hop_rows)


def pipeline_label_table(train: DataFrame, predict: DataFrame, features: DataFrame) -> DataFrame:
    """All ids of both label tables with their features, zero-filled; status is null for those to predict."""
    ids = train.select("user_id", F.col("status").cast("int").alias("status")).unionByName(predict.select("user_id", F.lit(None).cast("int").alias("status")))
    return ids.join(features, "user_id", "left").fillna(0, [c for c in features.columns if c != "user_id"])
